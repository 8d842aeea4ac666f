"""Services and pipeline rules per environment with cloud accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import blank_to_null
from .common import first_by_pos, missing_from, paired
from .placement import find_scope

# A service every such environment has, and the long form of one service name.
FIXED_SERVICE = ("Databricks", 5)
SERVICE_ALIASES = {"FX": "Foreign Exchange(FX)"}


def _cloudy(environments: DataFrame, scopes: DataFrame) -> DataFrame:
    cloudy = environments.filter(blank_to_null("CloudAccounts").isNotNull()).select(F.col("Name").alias("env_name"))
    return find_scope(cloudy, "env_name", scopes).withColumnRenamed("scope_id", "target")


def wanted_cloud_services(subdomains: DataFrame) -> DataFrame:
    """(name, tier) that every environment with cloud accounts has: each subdomain and the fixed service."""
    fixed = subdomains.sparkSession.createDataFrame([FIXED_SERVICE], "name string, tier int")
    return subdomains.select(F.col("Name").alias("name"), F.col("Tier").cast("int").alias("tier")).unionByName(fixed)


def cloud_service_gaps(environments: DataFrame, subdomains: DataFrame, scopes: DataFrame, actual: DataFrame) -> DataFrame:
    """(env_name, target, wanted, present, missing) per environment with cloud accounts, counted without listing what is absent.

    An environment lacks ``wanted_cloud_services`` less the stored services of its scope; names compare ignoring case.
    """
    wanted = wanted_cloud_services(subdomains).groupBy(F.lower("name").alias("_n")).agg(F.count(F.lit(1)).alias("n"))
    stored = actual.select(F.col("applicationId").alias("target"), F.lower("name").alias("_n")).distinct()
    present = stored.join(wanted, "_n").groupBy("target").agg(F.sum("n").alias("present"))
    total = wanted.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    gaps = _cloudy(environments, scopes).join(present, "target", "left").select(
        "env_name", "target", total.alias("wanted"), F.coalesce("present", F.lit(0)).alias("present"))
    return gaps.withColumn("missing", F.col("wanted") - F.col("present"))


def missing_cloud_services(environments: DataFrame, subdomains: DataFrame, scopes: DataFrame, actual: DataFrame) -> DataFrame:
    """(environment, service, tier) to create: each subdomain and the fixed service, where absent, row by row.

    The wanted set is environments x subdomains by definition (``cloud_service_gaps`` counts it).  Names compare ignoring case.
    """
    pairs = paired(_cloudy(environments, scopes), wanted_cloud_services(subdomains))
    return missing_from(pairs, actual, [(F.lower("name"), F.lower("name")), (F.col("target"), F.col("applicationId"))]).select(
        "env_name", F.col("name").alias("service"), "tier")


def service_alias(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    out = c
    for short, long in SERVICE_ALIASES.items():
        out = F.when(F.lower(c) == short.lower(), long).otherwise(out)
    return out


def pipeline_rule_tables(environments: DataFrame, repositories: DataFrame, tag_name: str = "pipeline") -> tuple[DataFrame, DataFrame]:
    """(rules, accounts): one rule per subdomain and build definition, and the environments with cloud accounts that each rule holds for."""
    rules = repositories.select(service_alias("Subdomain").alias("service"), F.concat(F.lit(tag_name + " "), "BuildDefinitionName").alias("rule_name"),
                                F.lit(tag_name).alias("tag_key"), F.col("BuildDefinitionName").alias("tag_value"))
    accounts = environments.filter(blank_to_null("CloudAccounts").isNotNull()).select(
        F.col("Name").alias("env_name"), F.col("CloudAccounts").alias("provider_accounts"))
    return rules, accounts


def pipeline_rules(environments: DataFrame, repositories: DataFrame, tag_name: str = "pipeline") -> DataFrame:
    """One rule per environment with cloud accounts, subdomain and build definition, row by row."""
    return paired(*pipeline_rule_tables(environments, repositories, tag_name))


def domains(repositories: DataFrame) -> DataFrame:
    """Distinct domains with the position they first appear at."""
    return repositories.groupBy("Domain").agg(F.min("pos").alias("first_pos"))


def subdomains(repositories: DataFrame) -> DataFrame:
    """One row per subdomain; its first row gives domain and tier."""
    rows = repositories.select(F.col("Subdomain").alias("Name"), "Domain", "Tier", "pos")
    return first_by_pos(rows, ["Name"])


def subdomain_owners(repositories: DataFrame) -> DataFrame:
    """Distinct teams of each subdomain, with the position they first appear at."""
    return repositories.groupBy("Subdomain", "Team").agg(F.min("pos").alias("first_pos"))


def by_subdomain(repositories: DataFrame) -> DataFrame:
    """Repositories in subdomain order, input order inside; a range-partitioned sort, no group is collected."""
    return repositories.orderBy("Subdomain", "pos")
