"""The validation job: every declared item of every file, with counts and rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.common import dealt
from ..operators.quality import error_rows, item_map, section_findings, validate
from ..operators.report import validity_counts, validity_rates
from ..sources.configs import APPLICATION_SECTIONS, ENVIRONMENT_SECTIONS, entries, section


def declared_items(files: DataFrame) -> DataFrame:
    """(file, kind, name, raw) of every application, component, environment and service as declared."""
    root = dealt(files.select("file", "raw")).select("file", item_map("raw").alias("m"))
    def part(rows: DataFrame, kind: str, key: str) -> DataFrame:
        name = F.try_variant_get(F.try_element_at("d", F.lit(key)), "$", "string")
        return rows.select("file", F.lit(kind).alias("kind"), name.alias("name"), F.to_json("d").alias("raw"))
    apps = entries(root, section(*APPLICATION_SECTIONS), "file")
    envs = entries(root, section(*ENVIRONMENT_SECTIONS), "file")
    components = entries(apps.drop("pos"), F.try_element_at("d", F.lit("Components")), "file")
    services = entries(envs.drop("pos"), F.try_element_at("d", F.lit("Services")), "file")
    return (part(apps, "application", "AppName").unionByName(part(components, "component", "ComponentName"))
            .unionByName(part(envs, "environment", "Name")).unionByName(part(services, "service", "Service")))


def checked_items(files: DataFrame) -> DataFrame:
    """Every declared item with stage, errors and validity; each kind has its own table of rules."""
    items = declared_items(files)
    parts = [validate(items.filter(F.col("kind") == kind), kind) for kind in ("application", "component", "environment", "service")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def check_files(files: DataFrame) -> dict[str, DataFrame]:
    """Findings on sections, errors per item, counts and rates per kind.  ``files`` has file and raw."""
    checked = checked_items(files)
    return {"sections": section_findings(files), "errors": error_rows(checked, "file", "kind", "name"),
            "counts": validity_counts(checked), "rates": validity_rates(checked)}
