"""Reports on operation records and declared files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scales import operation_kind, percent, rate_band, validity_band
from .common import number_rows, top_per_group

# Categories that show more items.
MAIN_CATEGORIES = ["environments", "applications", "services", "components", "deployments"]


def with_kind(log: DataFrame) -> DataFrame:
    """Adds ``operation_type`` where the record does not carry one."""
    derived = operation_kind("operation", "success")
    kind = F.coalesce("operation_type", derived) if "operation_type" in log.columns else derived
    return log.withColumn("operation_type", kind)


def _counters() -> list[Column]:
    done = lambda kind: F.count_if(F.col("success") & (F.col("operation_type") == kind))
    return [F.count(F.lit(1)).alias("processed"), done("create").alias("created"), done("update").alias("updated"),
            done("skip").alias("already_existing"), F.count_if(~F.col("success")).alias("errored"),
            F.count_if("success").alias("successful")]


def category_statistics(log: DataFrame) -> DataFrame:
    """Counters and success rate per category."""
    return (with_kind(log).groupBy("category").agg(*_counters())
            .withColumn("success_rate", percent(F.col("successful"), F.col("processed"))))


def overall_statistics(log: DataFrame) -> DataFrame:
    """Counters per category and over all (category null), with rate and band."""
    return (with_kind(log).rollup("category").agg(*_counters())
            .withColumn("success_rate", percent(F.col("successful"), F.col("processed")))
            .withColumn("band", rate_band(F.col("success_rate"))))


def breakdown(log: DataFrame, main_items: int = 10, other_items: int = 5) -> DataFrame:
    """Per category, operation and outcome: how many, and the first items."""
    keys = ["category", "operation", "success"]
    counts = log.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"))
    head = top_per_group(log.select(*keys, "item", "pos"), keys, [F.asc("pos")], max(main_items, other_items))
    shown = F.when(F.col("category").isin(MAIN_CATEGORIES), main_items).otherwise(other_items)
    items = (head.filter(F.col("rank") <= shown).groupBy(*keys)
             .agg(F.array_sort(F.collect_list(F.struct("pos", "item"))).alias("_i"))
             .select(*keys, F.transform("_i", lambda x: x["item"]).alias("items")))
    return _join_null_safe(counts, items, keys)


def _join_null_safe(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Equi join that also pairs null keys; the columns of ``df`` first."""
    right = other.withColumnsRenamed({k: f"_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [df[k].eqNullSafe(right[f"_{k}"]) for k in keys])
    return df.join(right, cond).drop(*[f"_{k}" for k in keys])


def errors_by_file(log: DataFrame, k: int = 3) -> DataFrame:
    """First errors of each file with the number of all of them; records need an operation and an error text."""
    failed = log.filter(F.col("error").isNotNull() & F.col("operation").isNotNull())
    counts = failed.groupBy("file").agg(F.count(F.lit(1)).alias("errors"))
    head = top_per_group(failed.select("file", "operation", "item", "error", "pos"), ["file"], [F.asc("pos")], k)
    return _join_null_safe(head, counts, ["file"])


def systematic_sample(rows: DataFrame, every: int, pos: str = "pos") -> DataFrame:
    """Every ``every``-th row in ``pos`` order."""
    return number_rows(rows, pos).filter(F.col("row_no") % every == 0)


def file_summary(files: DataFrame) -> DataFrame:
    """Entity counts per file from nested declarations (file, applications, environments, repositories, teams)."""
    def n(c: str) -> Column:
        return F.coalesce(F.size(c), F.lit(0))
    def inner(c: str, field: str) -> Column:
        return F.aggregate(F.coalesce(F.transform(c, lambda x: F.coalesce(F.size(x[field]), F.lit(0))), F.array().cast("array<int>")),
                           F.lit(0), lambda a, b: a + F.greatest(b, F.lit(0)))
    return files.select(
        "file", n("applications").alias("applications"), inner("applications", "Components").alias("components"),
        n("environments").alias("environments"), inner("environments", "Services").alias("services"),
        n("repositories").alias("repositories"), n("teams").alias("teams"))


def total_file_summary(summaries: DataFrame) -> DataFrame:
    """Parts of one file (a declaration may be stored in several rows) added up."""
    names = ["applications", "components", "environments", "services", "repositories", "teams"]
    return summaries.groupBy("file").agg(*[F.sum(c).cast("bigint").alias(c) for c in names])


def validity_counts(items: DataFrame) -> DataFrame:
    """Valid and invalid items per entity kind; ``items`` has kind and valid."""
    return items.groupBy("kind").agg(F.count(F.lit(1)).alias("total"), F.count_if("valid").alias("valid"),
                                     F.count_if(~F.col("valid")).alias("invalid"))


def validity_rates(items: DataFrame) -> DataFrame:
    """Rates per kind and over all (kind null), with their band."""
    rolled = items.rollup("kind").agg(F.count(F.lit(1)).alias("total"), F.count_if("valid").alias("valid"))
    return (rolled.withColumn("rate", percent(F.col("valid"), F.col("total")))
            .withColumn("band", validity_band(F.col("rate"))))
