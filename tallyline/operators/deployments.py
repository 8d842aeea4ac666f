"""Matching applications and components with the services they are deployed to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import blank_to_null
from .clustering import long_enough, similar_pairs


def _folded(name: str) -> Column:
    return F.lower(blank_to_null(name))


def known_services(services: DataFrame, scopes: DataFrame, actual: DataFrame) -> DataFrame:
    """Adds ``usable``: the service exists in its environment, or the environment is not in the snapshot.

    Names are compared as written.
    """
    envs = scopes.filter(F.col("type") == "ENVIRONMENT").select(F.col("name").alias("_e"), F.col("id").alias("_id")).distinct()
    present = (actual.join(envs, actual["applicationId"] == F.col("_id"))
               .select(F.col("_e").alias("_pe"), F.col("name").alias("_pn")).distinct())
    env_names = envs.select("_e").distinct()
    return (services.join(env_names, services["env_name"] == F.col("_e"), "left")
            .join(present, (services["env_name"] == F.col("_pe")) & (services["service"] == F.col("_pn")), "left")
            .withColumn("usable", F.col("_e").isNull() | F.col("_pn").isNotNull()).drop("_e", "_pe", "_pn"))


def existing_applications(applications: DataFrame, scopes: DataFrame) -> DataFrame:
    names = scopes.filter(F.col("type") == "APPLICATION").select(F.col("name").alias("app_name")).distinct()
    return applications.join(names, "app_name", "left_semi")


def link_groups(applications: DataFrame, services: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links as tables keyed by deployment set: (groups, members, selectors).

    members: the rows of ``applications`` that ask for a set, with ``set_key``; selectors: per set the services it selects
    (service, env_name, link_by, selector), by their set first, else by their tag; groups: per set its members, selectors and links,
    which are members times selectors.  Nothing is multiplied: ``links_of`` lists the links of chosen members.
    """
    members = applications.withColumn("set_key", _folded("deployment_set")).filter(F.col("set_key").isNotNull())
    keyed = services.select("service", "env_name", F.col("deployment_tag").alias("_raw"), _folded("deployment_set").alias("_s"), _folded("deployment_tag").alias("_t"))
    both = F.array(F.struct(F.col("_s").alias("set_key"), F.lit("name").alias("link_by"), F.col("service").alias("selector")),
                   F.struct(F.when(~F.col("_s").eqNullSafe(F.col("_t")), F.col("_t")).alias("set_key"), F.lit("tag").alias("link_by"), F.col("_raw").alias("selector")))
    selectors = (keyed.select("service", "env_name", F.explode(both).alias("k"))
                 .select("k.set_key", "service", "env_name", "k.link_by", "k.selector").filter("set_key is not null"))
    asked = members.groupBy("set_key").agg(F.count(F.lit(1)).alias("members"))
    offered = selectors.groupBy("set_key").agg(F.count(F.lit(1)).alias("selectors"))
    groups = asked.join(offered, "set_key", "left").select("set_key", "members", F.coalesce("selectors", F.lit(0)).alias("selectors"))
    return groups.withColumn("links", F.col("members") * F.col("selectors")), members, selectors


def links_of(members: DataFrame, selectors: DataFrame, parts: int = 32) -> DataFrame:
    """Links of the given members, one row each.

    A set has members times selectors, so few short rows can have very many links: the members of a set are dealt
    over parts, its selectors go to each, and both sides keep that many tasks whatever they measure in bytes.
    """
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["set_key", "_part"]
    asked = members.withColumn("_part", F.pmod(F.xxhash64(*members.columns), F.lit(parts)).cast("int"))
    offered = selectors.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return asked.repartition(tasks, *keys).join(offered.repartition(tasks, *keys).hint("merge"), keys).drop(*keys)


def deployment_links(applications: DataFrame, services: DataFrame) -> DataFrame:
    """Links of (app_name, deployment_set) with usable (service, env_name, deployment_set, deployment_tag).

    The set decides first and links by name; otherwise the tag links by tag.  All links of ``link_groups``, one row each.
    """
    _, members, selectors = link_groups(applications, services)
    return links_of(members, selectors)


def missing_service_errors(applications: DataFrame, services: DataFrame) -> DataFrame:
    """Services absent from a known environment, with the number of applications that would ask for them."""
    asking = applications.filter(blank_to_null("deployment_set").isNotNull()).agg(F.count(F.lit(1))).scalar()
    return services.filter(~F.col("usable")).select("service", "env_name", asking.alias("asked_by"))


def mismatch_counts(applications: DataFrame, services: DataFrame) -> DataFrame:
    """Per deployment set: applications, their links, and pairs that match neither set nor tag.

    The pairs are a product by definition, so they are counted: usable services less
    matches, per set.  ``mismatched_services`` lists them for one set.
    """
    total = services.agg(F.count(F.lit(1))).scalar()
    sets = applications.select(_folded("deployment_set").alias("_set"), "deployment_set").filter(F.col("_set").isNotNull())
    per_set = sets.groupBy("deployment_set", "_set").agg(F.count(F.lit(1)).alias("applications"))
    keys = F.array_distinct(F.filter(F.array(_folded("deployment_set"), _folded("deployment_tag")), lambda x: x.isNotNull()))
    hits = services.select(F.explode(keys).alias("_key")).groupBy("_key").agg(F.count(F.lit(1)).alias("_hits"))
    matched = F.coalesce("_hits", F.lit(0))
    return (per_set.join(hits, F.col("_set") == F.col("_key"), "left")
            .select("deployment_set", "applications", (F.col("applications") * matched).alias("links"),
                    (F.col("applications") * (F.coalesce(total, F.lit(0)) - matched)).alias("mismatches")))


def mismatched_services(services: DataFrame, deployment_set: str) -> DataFrame:
    """Usable services that match one deployment set neither by set nor by tag."""
    wanted = F.lit(deployment_set.lower())
    hit = F.coalesce(_folded("deployment_set") == wanted, F.lit(False)) | F.coalesce(_folded("deployment_tag") == wanted, F.lit(False))
    return services.filter(~hit)


def _stored_components(scopes: DataFrame, actual: DataFrame) -> DataFrame:
    """(app_name, component) pairs of the snapshot, names as written."""
    apps = scopes.filter(F.col("type") == "APPLICATION").select(F.col("name").alias("app_name"), F.col("id").alias("_id"))
    return apps.join(actual, F.col("_id") == actual["applicationId"]).select("app_name", actual["name"].alias("component")).distinct()


def absent_components(components: DataFrame, scopes: DataFrame, actual: DataFrame) -> DataFrame:
    """Errors: named components of an application of the snapshot that the snapshot lacks, with or without a set.

    Components of an application that is absent itself give no error.
    """
    named = existing_applications(components.filter(blank_to_null("component").isNotNull()), scopes)
    return named.join(_stored_components(scopes, actual), ["app_name", "component"], "left_anti").select(
        "component_id", "app_name", "component", F.lit("component not found in its application").alias("error"))


def component_link_groups(components: DataFrame, services: DataFrame, scopes: DataFrame, actual: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``link_groups`` of components (component_id, app_name, component, deployment_set) that the snapshot holds in their application.

    Tags select ignoring case; ``inherits`` marks members of a set without selectors.
    """
    present = components.join(_stored_components(scopes, actual), ["app_name", "component"], "left_semi")
    groups, members, selectors = link_groups(present, services)
    marked = members.join(groups.select("set_key", (F.col("selectors") == 0).alias("inherits")), "set_key")
    folded = F.when(F.col("link_by") == "tag", F.lower("selector")).otherwise(F.col("selector"))
    return groups, marked, selectors.withColumn("selector", folded)


def component_links(components: DataFrame, services: DataFrame, scopes: DataFrame, actual: DataFrame) -> DataFrame:
    """All links of ``component_link_groups``, one row each.

    Only components that the snapshot holds in their application are linked; ``absent_components`` lists the
    others.  Components without a match carry one row ``link_by = inherit``; those without a set are left out.
    """
    _, members, selectors = component_link_groups(components, services, scopes, actual)
    cols = ["component_id", "app_name", "component", "link_by", "selector", "env_name"]
    alone = members.filter("inherits").select(
        "component_id", "app_name", "component", F.lit("inherit").alias("link_by"),
        F.lit(None).cast("string").alias("selector"), F.lit(None).cast("string").alias("env_name"))
    return links_of(members, selectors).select(*cols).unionByName(alone)


def auto_links(applications: DataFrame, services: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Applications and services of one name (ignoring case), or with a ratio above the threshold as written.

    At the default threshold only equality can fire.
    """
    same = applications.select("app_name").join(
        services.select("service", "env_name"), F.lower("app_name") == F.lower("service"))
    if threshold >= 1.0:
        return same
    near = similar_pairs(applications.filter(long_enough("app_name", threshold)).select(F.col("app_name").alias("name")),
                         services.filter(long_enough("service", threshold)).select(F.col("service").alias("name")),
                         threshold, strict=True).filter(F.lower("name") != F.lower("other"))
    more = (near.select(F.col("name").alias("app_name"), F.col("other").alias("service"))
            .join(applications.select("app_name"), "app_name").join(services.select("service", "env_name"), "service"))
    return same.unionByName(more.select("app_name", "service", "env_name"))
