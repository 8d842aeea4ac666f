"""Tag profiling and the choice of grouping tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scales import percent
from ..functions.text import strip
from .common import top_per_group

# Bookkeeping keys that never become grouping tags by frequency.
BOOKKEEPING_KEYS = ["scanner_name", "import_date", "import_type", "lastScanDateTime"]


def tag_rows(assets: DataFrame) -> DataFrame:
    """One row per tag with both sides non-empty after stripping, with its place of appearance.

    ``opens`` marks the first tag of its key inside the asset.
    """
    # The plain array is spread and the tests follow, so the array is not rewritten before it is spread.
    keys = F.transform("tags", lambda t: F.when(strip(t["value"]) != "", strip(t["key"])))
    spread = assets.select("pos", keys.alias("_keys"), F.posexplode("tags").alias("idx", "_t"))
    named = spread.select("pos", "idx", "_keys", strip(F.col("_t.key")).alias("key"), strip(F.col("_t.value")).alias("value"))
    return named.filter((F.col("key") != "") & (F.col("value") != "")).select(
        "pos", "idx", "key", "value", (F.array_position("_keys", F.col("key")) == F.col("idx") + 1).alias("opens"))


def _value_counts(assets: DataFrame) -> DataFrame:
    # Position and place inside the asset as one number, so that raw rows are hashed and not sorted.
    seen = F.col("pos").cast("decimal(20,0)") * F.lit(2**31) + F.col("idx")
    return tag_rows(assets).groupBy("key", "value").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("opens").alias("opened"), F.min(seen.cast("decimal(38,0)")).alias("first_seen"))


def tag_profile(assets: DataFrame) -> DataFrame:
    """Per key: occurrences, coverage over all assets, distinct values, first appearance.

    A key repeated inside one asset counts each time, so coverage can pass 100 %;
    ``distinct_coverage_percent`` counts each asset once.  One pass over the tags, counted in
    two levels, (key, value) then key, so one frequent key is spread over its values.
    """
    total = assets.agg(F.count(F.lit(1))).scalar()
    by_key = _value_counts(assets).groupBy("key").agg(
        F.sum("n").alias("asset_count"), F.sum("opened").alias("distinct_assets"),
        F.count(F.lit(1)).alias("unique_values"), F.min("first_seen").alias("first_seen"))
    return by_key.select(
        "key", "asset_count", percent(F.col("asset_count"), total).alias("coverage_percent"),
        percent(F.col("distinct_assets"), total).alias("distinct_coverage_percent"), "unique_values", "first_seen")


def sort_by_coverage(profile: DataFrame) -> DataFrame:
    """Coverage descending, ties by first appearance."""
    return profile.orderBy(F.desc("asset_count"), F.asc("first_seen"))


def top_keys(profile: DataFrame, k: int = 20) -> DataFrame:
    """The first ``k`` keys with their rank."""
    head = sort_by_coverage(profile).limit(k)
    return head.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("asset_count"), F.asc("first_seen"))))


def top_values(assets: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` most frequent values of each key, ties by first appearance."""
    return top_per_group(_value_counts(assets), ["key"], [F.desc("n"), F.asc("first_seen")], k)


def asset_totals(assets: DataFrame) -> DataFrame:
    """Assets with and without tags, the percentage, and the number of distinct keys."""
    keys = tag_rows(assets).select("key").distinct().agg(F.count(F.lit(1))).scalar()
    return (assets.agg(F.count(F.lit(1)).alias("total_assets"),
                       F.count_if(F.coalesce(F.size("tags") > 0, F.lit(False))).alias("assets_with_tags"))
            .select("total_assets", "assets_with_tags",
                    (F.col("total_assets") - F.col("assets_with_tags")).alias("assets_without_tags"),
                    percent(F.col("assets_with_tags"), F.col("total_assets")).alias("tag_coverage_percent"),
                    F.coalesce(keys, F.lit(0)).alias("total_unique_tag_keys")))


def recommend_tags(profile: DataFrame, primary: Sequence[str] = (), secondary: Sequence[str] = (),
                   min_count: int = 10, use_frequency: bool = True, limit: int = 10) -> DataFrame:
    """Grouping tags in order: configured primary, configured secondary, then by frequency.

    The limit stops only the frequency part, and only after one key was added: a
    configured list of ten or more still gains one.
    """
    spark = profile.sparkSession
    listed = [*primary, *[k for k in secondary if k not in primary]]
    frequent = profile.filter(F.col("asset_count") >= min_count)
    configured = spark.createDataFrame([(k, i) for i, k in enumerate(listed)], "key string, place int")
    chosen = configured.join(frequent, "key", "left_semi")
    ranked = chosen.select("key", "place", F.lit(0).alias("part"))
    if use_frequency:
        spare = (frequent.filter(~F.col("key").isin(BOOKKEEPING_KEYS))
                 .join(configured, "key", "left_anti")
                 .orderBy(F.desc("asset_count"), F.asc("first_seen")).limit(limit)
                 .select("key", F.row_number().over(
                     Window.orderBy(F.desc("asset_count"), F.asc("first_seen"))).alias("place")))
        taken = F.coalesce(chosen.agg(F.count(F.lit(1))).scalar(), F.lit(0))
        spare = spare.filter(F.col("place") <= F.greatest(F.lit(1), F.lit(limit) - taken))
        ranked = ranked.unionByName(spare.select("key", "place", F.lit(1).alias("part")))
    # The configured list plus at most ``limit`` keys: a handful of rows.
    return ranked.select("key", F.row_number().over(Window.orderBy("part", "place")).alias("rank"))


def choose_tags(recommended: DataFrame, strategy: str = "application_first") -> tuple[str | None, str | None]:
    """Primary and secondary tag; the secondary only for the three strategies that use one."""
    head = [r["key"] for r in recommended.filter("rank <= 2").orderBy("rank").collect()]
    primary = head[0] if head else None
    two_level = strategy in ("application_first", "team_first", "hybrid")
    return primary, head[1] if two_level and len(head) > 1 else None
