"""Snapshots and listings saved as JSON, read with explicit schemas.

Each reader has a form over files and a form over a column of JSON text, so pages
landed in a table are read the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import (ACTUAL_COMPONENT, ACTUAL_SCOPE, ASSET, ASSET_STRUCT, TEAM, TEAM_MEMBER, USER, page_of)


def assets_from_file(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Asset files with one object per line, which Spark splits at will.

    ``lines=False`` reads one JSON array per file; such a file is parsed by one task, whatever its size.
    """
    return spark.read.schema(ASSET).option("multiLine", not lines).json(path)


def assets_from_text(rows: DataFrame, column: str = "raw") -> DataFrame:
    """The same from a column holding a JSON array of assets."""
    parsed = rows.select(F.explode(F.from_json(column, f"array<{ASSET_STRUCT}>")).alias("a"))
    return parsed.select("a.*")


def pages_from_files(spark: SparkSession, path: str, row_schema: str) -> DataFrame:
    return spark.read.schema(page_of(row_schema)).option("multiLine", True).json(path)


def pages_from_text(rows: DataFrame, row_schema: str, column: str = "raw") -> DataFrame:
    ddl = ", ".join(page_of(row_schema).split(", ")) if isinstance(row_schema, str) else row_schema
    return rows.select(F.from_json(column, ddl).alias("p")).select("p.*")


def page_rows(pages: DataFrame) -> DataFrame:
    """The rows of saved pages."""
    return pages.select(F.explode("content").alias("r")).select("r.*")


def assets_from_pages(pages: DataFrame, only_unassigned: bool = False) -> DataFrame:
    """Assets of saved pages; optionally those assigned to no application."""
    rows = page_rows(pages)
    return rows.filter(F.col("applicationId").isNull()) if only_unassigned else rows


def asset_names(assets: DataFrame, scope_id: str, kind: str) -> DataFrame:
    """Names of assets of one scope and type; both tests and the one column reach the scan."""
    return assets.filter((F.col("applicationId") == scope_id) & (F.col("type") == kind)).select(F.col("assetName").alias("name"))


def fetch_audit(pages: DataFrame) -> DataFrame:
    """Rows fetched against the total the pages declare."""
    return (pages.agg(F.sum(F.greatest(F.size("content"), F.lit(0))).cast("bigint").alias("fetched"),
                      F.max("totalElements").alias("declared"))
            .withColumn("missing", F.col("declared") - F.col("fetched"))
            .withColumn("complete", F.col("missing") == 0))


def in_scope(components: DataFrame, scope_id: str) -> DataFrame:
    """Components of one scope."""
    return components.filter(F.col("applicationId") == scope_id)


def actual_components(spark: SparkSession, path: str) -> DataFrame:
    return page_rows(pages_from_files(spark, path, ACTUAL_COMPONENT))


def actual_scopes(spark: SparkSession, path: str) -> DataFrame:
    return page_rows(pages_from_files(spark, path, ACTUAL_SCOPE))


def actual_users(spark: SparkSession, path: str) -> DataFrame:
    return page_rows(pages_from_files(spark, path, USER))


def actual_teams(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TEAM).option("multiLine", True).json(path)


def actual_team_members(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TEAM_MEMBER).option("multiLine", True).json(path)
