"""Create and patch rows for applications, environments, services and repositories: projections, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.integrations import target_of
from ..functions.repositories import last_two_parts
from ..functions.scales import criticality
from ..functions.tags import component_tags, label_tag, label_tags, no_tags, tag
from ..functions.text import blank_to_null, business_units


def _some_tags(*tags: Column) -> Column:
    return F.filter(F.array(*tags), lambda t: t["value"].isNotNull())


def _team_tags(c: str) -> Column:
    return F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t: tag(F.lit("pteam"), t))


def create_environments(envs: DataFrame) -> DataFrame:
    """Needs Name, Type, Tier, Responsable, BU, Status, TeamName, Tag_label, Tags_label, Ticketing, Messaging.

    Ticketing and messaging need only their target here.
    """
    return envs.select(
        F.col("Name").alias("name"), F.lit("ENVIRONMENT").alias("type"), F.col("Type").alias("sub_type"),
        criticality("Tier").alias("criticality"), F.lower("Responsable").alias("owner"),
        business_units("BU").alias("business_units"),
        F.concat(_some_tags(tag(F.lit("status"), blank_to_null("Status")), tag(F.lit("pteam"), blank_to_null("TeamName"))),
                 label_tags("Tags_label", "Tag_label")).alias("tags"),
        target_of("Ticketing", "ticketing", need_name=False).alias("ticketing"),
        target_of("Messaging", "messaging", need_name=False).alias("messaging"))


def patch_environments(envs: DataFrame) -> DataFrame:
    """Units, ticketing, messaging of existing environments (scope_id); no row when nothing is set."""
    rows = envs.select(F.col("Name").alias("name"), "scope_id", business_units("BU").alias("business_units"),
                       target_of("Ticketing", "ticketing").alias("ticketing"),
                       target_of("Messaging", "messaging").alias("messaging"))
    return rows.filter((F.size("business_units") > 0) | F.col("ticketing").isNotNull() | F.col("messaging").isNotNull())


def create_applications(apps: DataFrame) -> DataFrame:
    """Needs AppName, Tier, Responsable, BU, TeamNames, Tag_label, Tags_label, Ticketing, Messaging."""
    return apps.select(
        F.col("AppName").alias("name"), F.lit("APPLICATION").alias("type"), criticality(F.coalesce("Tier", F.lit(5))).alias("criticality"),
        F.lower("Responsable").alias("owner"), business_units("BU").alias("business_units"),
        F.concat(_team_tags("TeamNames"), label_tags("Tag_label", "Tags_label")).alias("tags"),
        target_of("Ticketing", "ticketing").alias("ticketing"), target_of("Messaging", "messaging").alias("messaging"))


def patch_applications(apps: DataFrame) -> DataFrame:
    """Criticality, owner, units, ticketing, messaging of existing applications (scope_id)."""
    return apps.filter(F.col("scope_id").isNotNull()).select(
        F.col("AppName").alias("name"), "scope_id", criticality(F.coalesce("Tier", F.lit(5))).alias("criticality"),
        F.lower("Responsable").alias("owner"), business_units("BU").alias("business_units"),
        target_of("Ticketing", "ticketing").alias("ticketing"), target_of("Messaging", "messaging").alias("messaging"))


def create_components(components: DataFrame) -> DataFrame:
    """Needs app_name, component, Status, Type, TeamNames, Domain, SubDomain, Tag_label, Tags_label, Tier."""
    return components.select(
        "app_name", "component", criticality(F.coalesce("Tier", F.lit(5))).alias("criticality"),
        component_tags(status=F.col("Status"), kind=F.col("Type"), teams=F.col("TeamNames"), domain=F.col("Domain"),
                       subdomain=F.col("SubDomain"), labels=label_tags("Tag_label", "Tags_label")).alias("tags"))


def patch_components(components: DataFrame) -> DataFrame:
    """As ``create_components`` without status and type; criticality as it was loaded."""
    return components.select(
        "app_name", "component", criticality(F.coalesce("Tier", F.lit(5))).alias("criticality"),
        component_tags(teams=F.col("TeamNames"), domain=F.col("Domain"), subdomain=F.col("SubDomain"),
                       labels=label_tags("Tag_label", "Tags_label")).alias("tags"))


def _service_settings() -> list[Column]:
    return [target_of("Ticketing", "ticketing", accept_old_name=True, need_name=False).alias("ticketing"),
            target_of("Messaging", "messaging", accept_old_name=True, need_name=False).alias("messaging")]


def create_services(services: DataFrame) -> DataFrame:
    """Needs env_name, service, Tier, TeamName, Tag_label, Tags_label, Ticketing, Messaging."""
    return services.select(
        "env_name", "service", criticality(F.coalesce("Tier", F.lit(5))).alias("criticality"),
        F.concat(F.array(tag(F.lit("pteam"), F.col("TeamName"))), label_tags("Tag_label", "Tags_label")).alias("tags"),
        *_service_settings())


def patch_services(services: DataFrame) -> DataFrame:
    """Ticketing, messaging and labels of existing services (entity_id); no row when nothing is set."""
    rows = services.select(
        "env_name", "service", "entity_id", label_tags("Tag_label", "Tags_label").alias("tags"),
        target_of("Ticketing", "ticketing", accept_old_name=True, need_name=False).alias("ticketing"),
        target_of("Messaging", "messaging", accept_old_name=True).alias("messaging"))
    return rows.filter((F.size("tags") > 0) | F.col("ticketing").isNotNull() | F.col("messaging").isNotNull())


def repository_components(repositories: DataFrame) -> DataFrame:
    """Needs RepositoryName, Domain, Tier, Subdomain, Team: one component per repository under its subdomain."""
    name = last_two_parts("RepositoryName")
    return repositories.select(
        F.col("Subdomain").alias("app_name"), name.alias("component"), criticality("Tier").alias("criticality"),
        F.array(tag(F.lit("pteam"), F.col("Team")), tag(F.lit("domain"), F.col("Domain")),
                tag(F.lit("subdomain"), F.col("Subdomain"))).alias("tags"),
        F.array(name).alias("repository_filter"))


def application_tag_rows(apps: DataFrame, label: str = "label") -> DataFrame:
    """One tag row per application id and label text."""
    return apps.select("app_id", label_tag(label).alias("t")).select("app_id", "t.*")


def finding_rules(rows: DataFrame) -> DataFrame:
    """Rule of (application, component): tag ``subdomain`` = application and repository = component."""
    return rows.select(
        "application", "component", F.concat("application", F.lit(" "), "component").alias("rule_name"),
        F.lit("subdomain").alias("tag_key"), F.col("application").alias("tag_value"), F.array("component").alias("repository"))
