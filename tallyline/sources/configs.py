"""Declared configuration: files as JSON text, flattened to one row per entity.

A root row is (file, file_pos, raw, m) with ``m`` the top-level map of the file.  Invalid
rows load too; validation is a separate result (``operators.quality``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.integrations import loaded
from ..functions.people import name_to_address
from ..functions.repositories import last_two_parts
from ..functions.scales import criticality
from ..functions.text import blank_to_null, first_present
from ..operators.common import dealt, first_by_pos
from ..operators.quality import _texts, item_map, load_rules, text_of, variant_class
from ..schemas import INTEGRATION

# Spellings of the two main sections.
APPLICATION_SECTIONS = ("DeploymentGroups", "Deployment Groups")
ENVIRONMENT_SECTIONS = ("Environment Groups", "EnvironmentGroups")
# Filter fields copied from components and services, texts and lists.
TEXT_FIELDS = ["SearchName", "Cidr", "AssetType"]
LIST_FIELDS = ["Fqdn", "Netbios", "OsNames", "Hostnames", "ProviderAccountId", "ProviderAccountName", "ResourceGroup"]


def read_config_files(spark: SparkSession, path: str, source: str = "local") -> DataFrame:
    """One row per configuration file (JSON text), tagged with its source."""
    rows = spark.read.option("wholetext", True).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.lit(source).alias("source"), F.col("value").alias("raw"))


def union_sources(primary: DataFrame, *others: DataFrame) -> DataFrame:
    """The primary list first, then the remote ones; ``file_pos`` keeps that order."""
    out = primary.withColumn("source_no", F.lit(0))
    for i, other in enumerate(others, 1):
        out = out.unionByName(other.withColumn("source_no", F.lit(i)))
    return out


def roots(files: DataFrame, raw: str = "raw") -> DataFrame:
    """Files with their top-level maps.  Parsing and what follows cost far more than reading, so files are dealt out over tasks."""
    return dealt(files).withColumn("m", item_map(raw))


def section(*names: str) -> Column:
    return first_present("m", *names)


def entries(rows: DataFrame, value: Column, *keep: Column | str) -> DataFrame:
    """One row per dict of a variant list: kept columns, ``pos`` inside the list, map ``d``."""
    items = F.try_variant_get(value, "$", "array<variant>")
    spread = rows.select(*keep, F.posexplode(items).alias("pos", "v"))
    return spread.select(*spread.columns[:len(keep)], "pos", F.try_variant_get("v", "$", "map<string,variant>").alias("d"))


def _text(key: str, d: str = "d") -> Column:
    return text_of(F.col(d), key)


def _list(key: str, d: str = "d") -> Column:
    return _texts(F.col(d), key)


def _tier(d: str = "d") -> Column:
    """Tier 5 when the key is absent."""
    given = F.try_variant_get(F.try_element_at(d, F.lit("Tier")), "$", "int")
    return F.when(F.map_contains_key(d, "Tier"), given).otherwise(F.lit(5))


def _integration(kind: str, d: str = "d") -> Column:
    key = {"ticketing": "Ticketing", "messaging": "Messaging"}[kind]
    v = F.try_element_at(d, F.lit(key))
    listed = F.when(variant_class(v) == "list", F.try_variant_get(v, "$", f"array<{INTEGRATION}>"))
    return loaded(listed, kind)


def _labels(key: str, d: str = "d") -> Column:
    return _texts(F.col(d), key)


def declared_applications(root: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Applications with their defaults.  One without ``Components`` is left out unless ``keep_empty``."""
    rows = entries(root, section(*APPLICATION_SECTIONS), "file")
    if not keep_empty:
        rows = rows.filter(F.map_contains_key("d", "Components"))
    return rows.select(
        "file", F.col("pos").alias("app_pos"), _text("AppName").alias("app_name"), _list("BU").alias("BU"), _text("Status").alias("Status"),
        F.coalesce(_list("TeamNames"), F.array().cast("array<string>")).alias("TeamNames"),
        F.lower(_text("Responsable")).alias("Responsable"), _tier().alias("Tier"), criticality(_tier()).alias("Criticality"),
        _text("Deployment_set").alias("deployment_set"), _integration("ticketing").alias("Ticketing"),
        _integration("messaging").alias("Messaging"), _labels("Tag_label").alias("Tag_label"), _labels("Tags_label").alias("Tags_label"),
        F.try_element_at("d", F.lit("Components")).alias("components_value"))


def declared_components(applications: DataFrame) -> DataFrame:
    """Components of applications, inheriting teams (when the key is absent), ticketing and messaging (when unset)."""
    rows = entries(applications, F.col("components_value"), "file", "app_pos", "app_name", F.col("TeamNames").alias("app_teams"),
                   F.col("Ticketing").alias("app_ticketing"), F.col("Messaging").alias("app_messaging"))
    return rows.select(
        "file", "app_pos", "app_name", F.col("pos").alias("component_pos"), _text("ComponentName").alias("component"),
        _text("Status").alias("Status"), _text("Type").alias("Type"),
        F.coalesce(_integration("ticketing"), "app_ticketing").alias("Ticketing"),
        F.coalesce(_integration("messaging"), "app_messaging").alias("Messaging"),
        F.when(F.map_contains_key("d", "TeamNames"), _list("TeamNames")).otherwise(F.col("app_teams")).alias("TeamNames"),
        _text("Deployment_set").alias("deployment_set"), _tier().alias("Tier"), criticality(_tier()).alias("Criticality"),
        _text("Domain").alias("Domain"), _text("SubDomain").alias("SubDomain"), _list("RepositoryName").alias("RepositoryName"),
        _list("Tags").alias("Tags"), _labels("Tag_label").alias("Tag_label"), _labels("Tags_label").alias("Tags_label"),
        *[_text(f).alias(f) for f in TEXT_FIELDS], *[_list(f).alias(f) for f in LIST_FIELDS],
        load_rules("d").alias("rules"))


def declared_environments(root: DataFrame) -> DataFrame:
    """Environments with their defaults; those without services stay."""
    rows = entries(root, section(*ENVIRONMENT_SECTIONS), "file")
    owner = F.coalesce(blank_to_null(_text("Responsable")), _text("Responsible"), F.lit(""))
    return rows.select(
        "file", F.col("pos").alias("env_pos"), _text("Name").alias("env_name"), _text("Type").alias("Type"),
        _tier().alias("Tier"), criticality(_tier()).alias("Criticality"), _text("Status").alias("Status"),
        F.lower(owner).alias("Responsable"), _list("BU").alias("BU"), _text("TeamName").alias("TeamName"),
        _integration("ticketing").alias("Ticketing"), _integration("messaging").alias("Messaging"),
        F.try_element_at("d", F.lit("Services")).alias("services_value"))


def declared_services(environments: DataFrame) -> DataFrame:
    """Services of environments, inheriting the team when the key is absent."""
    rows = entries(environments, F.col("services_value"), "file", "env_pos", "env_name", F.col("TeamName").alias("env_team"))
    return rows.select(
        "file", "env_pos", "env_name", F.col("pos").alias("service_pos"), _text("Service").alias("service"), _text("Type").alias("Type"),
        _tier().alias("Tier"), F.when(F.map_contains_key("d", "TeamName"), _text("TeamName")).otherwise(F.col("env_team")).alias("TeamName"),
        _integration("ticketing").alias("Ticketing"), _integration("messaging").alias("Messaging"),
        _text("Deployment_set").alias("deployment_set"), _text("Deployment_tag").alias("deployment_tag"),
        _list("RepositoryName").alias("RepositoryName"), _list("Tag").alias("Tag"), _list("Tag_rule").alias("Tag_rule"),
        _list("Tags_rule").alias("Tags_rule"), _labels("Tag_label").alias("Tag_label"), _labels("Tags_label").alias("Tags_label"),
        *[_text(f).alias(f) for f in TEXT_FIELDS], *[_list(f).alias(f) for f in LIST_FIELDS],
        load_rules("d").alias("rules"))


def declared_repositories(root: DataFrame, only_group: int | None = None) -> DataFrame:
    """Repositories of build definitions; a definition may name one or several.

    ``only_group`` keeps one deployment group by its place (the older form reads the second).
    """
    groups = entries(root, section(*APPLICATION_SECTIONS), "file")
    if only_group is not None:
        groups = groups.filter(F.col("pos") == only_group)
    groups = groups.withColumnRenamed("pos", "group_pos")
    rows = entries(groups, F.try_element_at("d", F.lit("BuildDefinitions")), "file", "group_pos")
    spread = rows.select("file", "group_pos", F.col("pos").alias("row_pos"), "d",
                         F.posexplode(_list("RepositoryName")).alias("name_pos", "name"))
    return spread.select("file", "group_pos", "row_pos", "name_pos", last_two_parts("name").alias("RepositoryName"),
                         _text("Domain").alias("Domain"), _tier().alias("Tier"), _text("SubDomain").alias("Subdomain"),
                         _text("TeamName").alias("Team"), _text("BuildDefinitionName").alias("BuildDefinitionName"))


def all_access_accounts(root: DataFrame) -> DataFrame:
    """The accounts with access everywhere, none when the key is absent."""
    listed = F.try_variant_get(F.try_element_at("m", F.lit("AllAccessAccounts")), "$", "array<string>")
    return root.select("file", F.explode(listed).alias("email"))


def creates_users(root: DataFrame) -> DataFrame:
    """Per file, whether users are created for applications (only for the value true)."""
    flag = F.try_element_at("m", F.lit("CreateUsersForApplications"))
    return root.select("file", F.coalesce(
        (variant_class(flag) == "boolean") & F.try_variant_get(flag, "$", "boolean"), F.lit(False)).alias("create_users"))


def declared_teams(files: DataFrame, raw: str = "raw") -> DataFrame:
    """Team files, one team each: of several files with one name the first by ``file_pos`` wins."""
    rows = files.select("file", "file_pos", item_map(raw).alias("d"))
    members = F.try_variant_get(F.try_element_at("d", F.lit("TeamMembers")), "$", "array<map<string,variant>>")
    read = lambda x: F.struct(*[text_of(x, k).alias(a) for k, a in (
        ("Name", "name"), ("EmailAddress", "email"), ("EmployeeRole", "employee_role"), ("EmployeeType", "employee_type"),
        ("Tag_label", "tag_label"))])
    teams = rows.select(_text("TeamName").alias("TeamName"), "file", "file_pos", F.transform(members, read).alias("TeamMembers"))
    return first_by_pos(teams, ["TeamName"], "file_pos")


def declared_members(teams: DataFrame) -> DataFrame:
    return teams.select(F.col("TeamName").alias("team"), "file_pos", F.posexplode("TeamMembers").alias("pos", "x")).select(
        "team", "file_pos", "pos", "x.*")


def declared_hives(files: DataFrame, raw: str = "raw") -> DataFrame:
    """One row per team of a hive: team, lead, products.  Names become addresses unless the file holds addresses."""
    root = files.select("file", "file_pos", item_map(raw).alias("d"))
    custom = F.coalesce(F.try_variant_get(F.try_element_at("d", F.lit("CustomEmail")), "$", "boolean"), F.lit(False))
    root = root.withColumn("custom", custom).withColumn("domain", _text("CompanyEmailDomain"))
    hives = entries(root, F.try_element_at("d", F.lit("Hives")), "file_pos", "custom", "domain").withColumnRenamed("pos", "hive_pos")
    teams = entries(hives, F.try_element_at("d", F.lit("Teams")), "file_pos", "hive_pos", "custom", "domain")
    mail = lambda c: F.when(F.col("custom"), c).otherwise(name_to_address(c, F.col("domain")))
    product = blank_to_null(_text("Product"))
    return teams.select("file_pos", "hive_pos", F.col("pos").alias("team_pos"), _text("Name").alias("team"), mail(_text("Lead")).alias("lead"),
                        F.coalesce(F.transform(F.split(product, " and "), mail), F.array().cast("array<string>")).alias("product"))
