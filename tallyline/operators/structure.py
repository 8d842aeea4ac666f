"""From grouping plan to declared structure: routing, rules, teams."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.tags import tag_value
from ..functions.text import blank_to_null
from .common import top_per_group

# Types that become components of applications.
APPLICATION_TYPES = ["WEB", "WEBSITE_API", "REPOSITORY", "SOURCE_CODE", "BUILD", "FOSS", "SAST"]
# Prefixes of group names, the first that fits is removed for a search.
NAME_PREFIXES = ["INFRA-", "CLOUD-", "CONTAINER-", "CODE-", "CIDR-"]


@dataclass(frozen=True)
class StructureDefaults:
    owner: str = "admin@company.com"
    tier: int = 5
    status: str = "Autogenerated"
    application_types: Sequence[str] = tuple(APPLICATION_TYPES)
    # asset type -> (environment type, service type)
    environment_types: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    copy_team: bool = False


def group_filter(primary_tag: str | None) -> Column:
    """One filter per group by its grouping method, unused members null."""
    method, primary = F.col("method"), F.col("primary_value")
    name = blank_to_null("component_name")
    stripped = name
    for prefix in reversed(NAME_PREFIXES):
        stripped = F.when(F.startswith(name, F.lit(prefix)), F.substring(name, len(prefix) + 1, 1_000_000)).otherwise(stripped)
    by_tag = (method == "tag") & primary.isNotNull() & F.lit(primary_tag is not None)
    by_cidr = (method == "cidr") & blank_to_null("cidr").isNotNull()
    by_hosts = (method == "hostname") & (F.size("sample_names") > 0)
    by_repo = (method == "repository") & blank_to_null("group_key").isNotNull()
    by_account = (method == "cloud_provider") & blank_to_null("account").isNotNull()
    by_image = (method == "image_name") & blank_to_null("name_pattern").isNotNull()
    by_type = (method == "type") & blank_to_null("first_type").isNotNull()
    known = F.coalesce(by_tag | by_cidr | by_hosts | by_repo | by_account | by_image | by_type, F.lit(False))
    return F.struct(
        F.when(by_tag, F.concat(F.lit(f"{primary_tag}: "), primary)).alias("Tag"),
        F.when(by_cidr, F.col("cidr")).alias("Cidr"),
        F.when(by_hosts, F.slice("sample_names", 1, 10)).alias("Hostnames"),
        F.when(by_repo, F.col("group_key")).alias("RepositoryName"),
        F.when(by_account, F.array("account")).alias("ProviderAccountId"),
        F.when(by_image, F.col("name_pattern")).when(~known, stripped).alias("SearchName"),
        F.when(by_account | by_type, F.col("first_type")).when(by_image, "CONTAINER").alias("AssetType"))


def component_rows(plan: DataFrame, defaults: StructureDefaults, primary_tag: str | None) -> DataFrame:
    """Application side: one row per component, keyed by application name."""
    team = F.when(F.lit(defaults.copy_team), F.col("secondary_value"))
    return (plan.filter(F.col("first_type").isin(list(defaults.application_types)))
            .select("application_name", "component_name", F.lit(defaults.status).alias("status"),
                    F.lit("Release").alias("component_type"), team.alias("team"),
                    group_filter(primary_tag).alias("rule"), "group_key", "first_pos"))


def application_rows(components: DataFrame, defaults: StructureDefaults) -> DataFrame:
    """The parents of ``component_rows``, one per application name."""
    return components.groupBy("application_name").agg(F.count(F.lit(1)).alias("components")).select(
        "application_name", F.lit(defaults.owner).alias("owner"), F.lit(defaults.tier).alias("tier"),
        F.lit(defaults.status).alias("status"), "components")


def service_rows(plan: DataFrame, defaults: StructureDefaults, primary_tag: str | None) -> DataFrame:
    """Environment side: one row per service of the routed types."""
    pairs = [F.lit(x) for kind, (env, svc) in defaults.environment_types.items()
             for x in (kind, env + "\u0001" + svc)]
    if not pairs:
        return plan.filter(F.lit(False)).select(
            F.col("application_name").alias("environment_name"), F.col("component_name").alias("service_name"),
            F.lit("").alias("environment_type"), F.lit("").alias("service_type"), F.lit(defaults.tier).alias("tier"),
            F.lit(None).cast("string").alias("team"), group_filter(primary_tag).alias("rule"), "group_key", "first_pos")
    route = F.try_element_at(F.create_map(*pairs), F.col("first_type"))
    team = F.when(F.lit(defaults.copy_team), F.col("secondary_value"))
    return (plan.withColumn("_route", route).filter(F.col("_route").isNotNull())
            .select(F.col("application_name").alias("environment_name"), F.col("component_name").alias("service_name"),
                    F.substring_index("_route", "\u0001", 1).alias("environment_type"),
                    F.substring_index("_route", "\u0001", -1).alias("service_type"),
                    F.lit(defaults.tier).alias("tier"), team.alias("team"),
                    group_filter(primary_tag).alias("rule"), "group_key", "first_pos"))


def environment_rows(services: DataFrame, defaults: StructureDefaults) -> DataFrame:
    """The parents of ``service_rows``; type of the first service."""
    return services.groupBy("environment_name").agg(
        F.min_by("environment_type", "first_pos").alias("environment_type"),
        F.count(F.lit(1)).alias("services")).select(
        "environment_name", "environment_type", F.lit(defaults.status).alias("status"),
        F.lit(defaults.owner).alias("owner"), F.lit(defaults.tier).alias("tier"), "services")


def structure_teams(components: DataFrame, services: DataFrame) -> DataFrame:
    """Distinct teams of both sides."""
    return (components.select("team").union(services.select("team"))
            .filter(blank_to_null("team").isNotNull()).distinct())


def group_teams(members: DataFrame, team_keys: Sequence[str] = ("Team", "team"), sample: int = 10) -> DataFrame:
    """Teams of each group: the secondary value if set, else team tags of its first assets.

    ``members`` has group_key, pos, tags and secondary_value (of the group's last asset).
    """
    given = members.groupBy("group_key").agg(F.max_by("secondary_value", "pos").alias("v")).filter(
        blank_to_null("v").isNotNull()).select("group_key", F.col("v").alias("team"))
    rest = members.join(given.select("group_key"), "group_key", "left_anti")
    head = top_per_group(rest.select("group_key", "pos", *[tag_value("tags", k).alias(f"_t{i}") for i, k in enumerate(team_keys)]),
                         ["group_key"], [F.asc("pos")], sample)
    found = head.select("group_key", F.explode(F.array(*[f"_t{i}" for i in range(len(team_keys))])).alias("team"))
    return given.unionByName(found.filter(F.col("team").isNotNull()).distinct())


def tag_rules(plan: DataFrame, primary_tag: str, secondary_tag: str | None) -> DataFrame:
    """One rule for the primary tag, one for the secondary unless it is ``NoTeam``."""
    def rule(key: str, value: Column) -> Column:
        return F.struct(F.concat(F.lit("AUTO-RULE-"), "component_name", F.lit(f"-{key}")).alias("rule_name"),
                        F.lit(key).alias("tag_key"), value.alias("tag_value"))
    rules = [rule(primary_tag, F.col("primary_value"))]
    if secondary_tag:
        rules.append(rule(secondary_tag, F.when(F.col("secondary_value") != "NoTeam", F.col("secondary_value"))))
    return (plan.filter(F.col("method") == "tag")
            .select("application_name", "component_name", F.explode(F.array(*rules)).alias("r"))
            .select("application_name", "component_name", "r.*")
            .filter(blank_to_null("tag_value").isNotNull()))
