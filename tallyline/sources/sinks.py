"""Writing plans and structures.

Nested documents would put a whole application into one row, so parents and children
are written as tables; folders carry the nesting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

def write_plan(plan: DataFrame, path: str, fmt: str = "parquet") -> None:
    plan.write.mode("overwrite").format(fmt).save(path)


def write_structure(path: str, fmt: str = "json", **tables: DataFrame) -> None:
    """One folder per table: applications, components, environments, services."""
    for name, table in tables.items():
        table.write.mode("overwrite").format(fmt).save(f"{path}/{name}")


def auto_component_rows(suggestions: DataFrame, prefix: str = "auto-") -> DataFrame:
    """Suggested components under application and environment, named with ``prefix``; of a repeated name the later one stays.

    Needs environment_name, component_name, team, asset_count, type, pos and optionally application_name.
    """
    app = F.coalesce("application_name", "environment_name") if "application_name" in suggestions.columns else F.col("environment_name")
    rows = suggestions.select(app.alias("application"), F.col("environment_name").alias("environment"),
                              F.concat(F.lit(prefix), "component_name").alias("component"),
                              F.col("component_name").alias("original_name"), "team", "asset_count",
                              F.col("type").alias("asset_type"), "pos")
    keys = ["application", "environment", "component"]
    rest = ["original_name", "team", "asset_count", "asset_type"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "pos").alias("r")).select(*keys, "r.*")


def write_auto_components(rows: DataFrame, path: str) -> None:
    """Plain columns in ranges of (application, environment): a reader of one pair skips the other files, and the
    number of files follows the data, not the number of pairs."""
    rows.repartitionByRange("application", "environment").sortWithinPartitions("application", "environment").write.mode("overwrite").parquet(path)
