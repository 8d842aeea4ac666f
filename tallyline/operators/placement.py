"""Where declared components and services exist: placement, lookups, upsert splits, audits.

Actual rows are reduced to one row per lookup key before any join, so a name that
occurs in very many scopes is matched once per declared row and never multiplied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scales import location_class, percent
from .clustering import long_enough, more_step_pairs, one_step_pairs
from .common import missing_from


def scope_ids(scopes: DataFrame, kind: str | None = "ENVIRONMENT") -> DataFrame:
    """name -> id of scopes of a type; of equal names the first by position."""
    rows = scopes.filter(F.col("type") == kind) if kind else scopes
    return rows.groupBy("name").agg(F.min_by("id", "pos").alias("scope_id"))


def find_scope(names: DataFrame, name: str, scopes: DataFrame, kind: str | None = "ENVIRONMENT") -> DataFrame:
    """Adds ``scope_id`` (null when unknown); exact names, typed."""
    ids = scope_ids(scopes, kind).withColumnRenamed("name", "_n")
    return names.join(ids, names[name] == ids["_n"], "left").drop("_n")


def place(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """Placement of declared (name, target) among actual (id, name, applicationId, pos).

    The same name in the target, ignoring case: update its rules (of several the last
    id); only elsewhere: create beside it; nowhere: create.
    """
    key = F.lower("name")
    here = actual.groupBy(key.alias("_k"), F.col("applicationId").alias("_s")).agg(
        F.max_by("id", "pos").alias("entity_id"), F.count(F.lit(1)).alias("_here"))
    anywhere = actual.groupBy(key.alias("_a")).agg(F.count(F.lit(1)).alias("_all"))
    joined = (declared
              .join(here, (F.lower(declared["name"]) == F.col("_k")) & (declared["target"] == F.col("_s")), "left")
              .join(anywhere, F.lower(declared["name"]) == F.col("_a"), "left"))
    exists = F.col("entity_id").isNotNull()
    elsewhere = F.coalesce("_all", F.lit(0)) - F.coalesce("_here", F.lit(0)) > 0
    return joined.select(
        *[declared[c] for c in declared.columns], exists.alias("entity_exists"), "entity_id",
        F.when(exists, "update_rules").otherwise("create").alias("action_required"),
        F.when(exists, "same_scope").when(elsewhere, "cross_scope").otherwise("none").alias("conflict_type"))


def other_scopes(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """How many other scopes' entities hold each declared name (ignoring case)."""
    counts = actual.groupBy(F.lower("name").alias("_k")).agg(F.count(F.lit(1)).alias("_all"))
    own = actual.groupBy(F.lower("name").alias("_o"), F.col("applicationId").alias("_s")).agg(F.count(F.lit(1)).alias("_own"))
    return (declared.join(counts, F.lower(declared["name"]) == F.col("_k"), "left")
            .join(own, (F.lower(declared["name"]) == F.col("_o")) & (declared["target"] == F.col("_s")), "left")
            .select(*[declared[c] for c in declared.columns],
                    (F.coalesce("_all", F.lit(0)) - F.coalesce("_own", F.lit(0))).alias("other_entities")))


def name_holders(declared: DataFrame, actual: DataFrame, scopes: DataFrame) -> DataFrame:
    """The holders behind ``other_scopes``: each actual entity whose name is declared, once, with its scope.

    Listing them per declared row would repeat a common name's holders for every
    declaration; join this table on the name and drop the own scope to read one of them.
    """
    wanted = declared.select(F.lower("name").alias("name_key")).distinct()
    held = actual.withColumn("name_key", F.lower("name")).join(wanted, "name_key", "left_semi")
    ids = scopes.groupBy("id").agg(F.min_by("name", "pos").alias("scope_name"))
    named = held.join(ids, held["applicationId"] == ids["id"], "left").drop(ids["id"])
    return named.select("name_key", F.col("id").alias("entity_id"), F.col("applicationId").alias("scope_id"),
                        F.coalesce("scope_name", F.concat(F.lit("env-"), F.substring("applicationId", 1, 8))).alias("scope_name"))


def existing(declared: DataFrame, actual: DataFrame, ignore_case: bool = True) -> DataFrame:
    """Declared (name, target) rows that exist in their target scope."""
    fold = F.lower if ignore_case else (lambda c: c)
    keys = actual.select(fold(F.col("name")).alias("_k"), F.col("applicationId").alias("_s"))
    return declared.join(keys, (fold(declared["name"]) == F.col("_k")) & (declared["target"] == F.col("_s")), "left_semi")


def absent(declared: DataFrame, actual: DataFrame, ignore_case: bool = True) -> DataFrame:
    """Declared (name, target) rows that do not exist in their target scope."""
    fold = F.lower if ignore_case else (lambda c: c)
    return missing_from(declared, actual, [(fold(F.col("name")), fold(F.col("name"))),
                                           (F.col("target"), F.col("applicationId"))])


def near_names(left: DataFrame, right: DataFrame, threshold: float, scope: str) -> DataFrame:
    """Pairs (scope, name, other, ratio) of different names of one scope with a ratio above the threshold."""
    more = more_step_pairs(left, right, threshold, scope).filter(F.col("name") != F.col("other"))
    return one_step_pairs(left, right, threshold, scope).unionByName(more)


def find_service(declared: DataFrame, actual: DataFrame, threshold: float = 0.99) -> DataFrame:
    """Cascade lookup of (name, target, env_name): equal ignoring case, then the closest name with a
    ratio above the threshold, then ``name-environment``.  Adds ``entity_id``, ``found_by``, ``ratio``."""
    folded = actual.select(F.lower("name").alias("_name"), F.col("applicationId").alias("_scope"), "id", "pos")
    by_name = folded.groupBy("_name", "_scope").agg(F.min_by("id", "pos").alias("_id"), F.min("pos").alias("_pos"))
    rows = declared.withColumn("_dn", F.lower("name")).withColumn(
        "_suffixed", F.lower(F.concat("name", F.lit("-"), "env_name")))
    exact = by_name.select(F.col("_name").alias("_dn"), F.col("_scope").alias("target"), F.col("_id").alias("_exact"))
    rows = rows.join(exact, ["_dn", "target"], "left")
    # Equal names are settled above, so only names long enough for a near miss are compared.
    open_rows = rows.filter(F.col("_exact").isNull() & long_enough("_dn", threshold)).select("_dn", "target").distinct()
    near = near_names(open_rows.select(F.col("_dn").alias("name"), F.col("target").alias("scope")),
                      by_name.filter(long_enough("_name", threshold)).select(F.col("_name").alias("name"), F.col("_scope").alias("scope")),
                      threshold, "scope")
    best = (near.join(by_name, (near["other"] == by_name["_name"]) & (near["scope"] == by_name["_scope"]))
            .groupBy(F.col("name").alias("_dn"), F.col("scope").alias("target"))
            .agg(F.max_by(F.struct(F.col("_id").alias("id"), "ratio"), F.struct("ratio", -F.col("_pos"))).alias("_best")))
    suffix = by_name.select(F.col("_name").alias("_suffixed"), F.col("_scope").alias("target"), F.col("_id").alias("_suffix"))
    rows = rows.join(best, ["_dn", "target"], "left").join(suffix, ["_suffixed", "target"], "left")
    how = (F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_best").isNotNull(), "similar")
           .when(F.col("_suffix").isNotNull(), "suffixed").otherwise("none"))
    return rows.select(*[F.col(c) for c in declared.columns],
                       F.coalesce("_exact", "_best.id", "_suffix").alias("entity_id"), how.alias("found_by"),
                       F.when(how == "exact", F.lit(1.0)).when(how == "similar", F.col("_best.ratio")).alias("ratio"))


def find_application(names: DataFrame, name: str, scopes: DataFrame, kind: str = "APPLICATION") -> DataFrame:
    """Adds ``scope_id``: exact name first, then ignoring case; first by position."""
    typed = scopes.filter(F.col("type") == kind)
    exact = typed.groupBy(F.col("name").alias("_e")).agg(F.min_by("id", "pos").alias("_eid"))
    folded = typed.groupBy(F.lower("name").alias("_f")).agg(F.min_by("id", "pos").alias("_fid"))
    return (names.join(exact, names[name] == F.col("_e"), "left")
            .join(folded, F.lower(names[name]) == F.col("_f"), "left")
            .select(*[names[c] for c in names.columns], F.coalesce("_eid", "_fid").alias("scope_id"),
                    F.when(F.col("_eid").isNotNull(), "exact").when(F.col("_fid").isNotNull(), "folded")
                    .otherwise("none").alias("found_by")))


def upsert(names: DataFrame, name: str, scopes: DataFrame, kind: str) -> DataFrame:
    """Adds ``scope_id`` and ``action`` (create or update); exact name and type."""
    return find_scope(names, name, scopes, kind).withColumn(
        "action", F.when(F.col("scope_id").isNull(), "create").otherwise("update"))


def service_sync(services: DataFrame, scopes: DataFrame, actual: DataFrame, checked: bool = True) -> DataFrame:
    """Services (name, env_name) of environments that exist: create or update rules.

    ``checked`` tells apart names held by other scopes; the plain form only looks inside.
    """
    scoped = find_scope(services, "env_name", scopes).filter(F.col("scope_id").isNotNull()).withColumnRenamed("scope_id", "target")
    if checked:
        return place(scoped, actual).withColumnRenamed("action_required", "action")
    keys = actual.groupBy(F.lower("name").alias("_k"), F.col("applicationId").alias("_s")).agg(F.max_by("id", "pos").alias("entity_id"))
    return (scoped.join(keys, (F.lower(scoped["name"]) == F.col("_k")) & (scoped["target"] == F.col("_s")), "left").drop("_k", "_s")
            .withColumn("action", F.when(F.col("entity_id").isNull(), "create").otherwise("update_rules")))


def verify_names(expected: DataFrame, keys: list[str], actual: DataFrame) -> DataFrame:
    """Adds ``status`` present or absent by equality on ``keys`` (both sides use the same names)."""
    seen = actual.select(*keys).distinct().withColumn("_seen", F.lit(True))
    return expected.join(seen, keys, "left").withColumn(
        "status", F.when(F.col("_seen"), "present").otherwise("absent")).drop("_seen")


def third_party_missing(scopes: DataFrame, actual: DataFrame, services: DataFrame | list[str] = ("Salesforce",),
                        environment: str = "Thirdparty") -> DataFrame:
    """Fixed services (a list, or a table with ``name``) missing from the third-party environment; nothing when it does not exist."""
    if not isinstance(services, DataFrame):
        services = scopes.sparkSession.createDataFrame([(s,) for s in services], "name string")
    wanted = services.select("name", F.lit(environment).alias("env_name"), F.lit(5).alias("tier"))
    scoped = find_scope(wanted, "env_name", scopes).filter(F.col("scope_id").isNotNull()).withColumnRenamed("scope_id", "target")
    return absent(scoped, actual, ignore_case=True)


def filter_audit(actual: DataFrame, fetched: DataFrame, scope_id: str) -> DataFrame:
    """Rows fetched for one scope against the whole: total, in scope, wrong scope, consistency."""
    whole = actual.agg(F.count(F.lit(1)).alias("total"),
                       F.count_if(F.coalesce(F.col("applicationId") == scope_id, F.lit(False))).alias("in_scope"))
    part = fetched.agg(F.count(F.lit(1)).alias("fetched"),
                       F.count_if(~F.coalesce(F.col("applicationId") == scope_id, F.lit(False))).alias("wrong_scope"))
    return whole.crossJoin(part).withColumn("consistent", F.col("in_scope") == F.col("fetched"))  # one row each


def scope_breakdown(actual: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` scopes with most entities."""
    counts = actual.groupBy(F.coalesce("applicationId", F.lit("Unknown")).alias("scope_id")).agg(
        F.count(F.lit(1)).alias("entities"))
    return counts.orderBy(F.desc("entities"), "scope_id").limit(k)


def locations(actual: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Instances of each name (ignoring case) by location class."""
    rows = actual.withColumn("name_key", F.lower("name"))
    if names is not None:
        rows = rows.join(names.select(F.lower("name").alias("name_key")).distinct(), "name_key", "left_semi")
    return rows.groupBy("name_key", location_class(F.coalesce("applicationId", F.lit("Unknown"))).alias("location_type")).agg(
        F.count(F.lit(1)).alias("instances"))


def duplicates_inside(actual: DataFrame) -> DataFrame:
    """Names held more than once inside one scope, with the number of scopes that hold the name at all."""
    inside = actual.groupBy("applicationId", F.lower("name").alias("name_key")).agg(F.count(F.lit(1)).alias("copies"))
    spread = inside.groupBy("name_key").agg(F.count(F.lit(1)).alias("scopes"))
    return inside.filter("copies > 1").join(spread, "name_key")


def held_by_both(actual: DataFrame, first_scope: str, second_scope: str) -> DataFrame:
    """Per name: whether each of two scopes holds it, and what follows for creating it in both."""
    def holds(scope: str) -> Column:
        return F.max(F.coalesce(F.col("applicationId") == scope, F.lit(False)))
    return (actual.groupBy(F.lower("name").alias("name_key"))
            .agg(holds(first_scope).alias("in_first"), holds(second_scope).alias("in_second"))
            .filter("in_first or in_second").withColumn("cross_allowed", F.lit(True)))


def verification_report(looked_up: DataFrame) -> DataFrame:
    """Totals over ``find_service`` rows; the rate of nothing to verify is 100."""
    return (looked_up.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("entity_id").isNotNull()).alias("found"))
            .select("total", "found", (F.col("total") - F.col("found")).alias("failed"),
                    percent(F.col("found"), F.col("total"), 100.0).alias("success_rate")))


def name_collisions(applications: DataFrame, environments: DataFrame) -> DataFrame:
    """Environment names that are application names too, within one file."""
    apps = applications.select("file", F.col("name")).filter(F.col("name").isNotNull()).distinct()
    return environments.join(apps, ["file", "name"], "left_semi")
