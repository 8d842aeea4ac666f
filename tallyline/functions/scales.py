"""Criticality, location class, operation kinds, rates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col


def criticality(tier: Column | str, variant: str = "standard") -> Column:
    """Tier 1..10 to criticality 10..1, anything else 5.  ``short``: tier 0..4 to 10..6, anything else 5."""
    tier = col(tier)
    if variant == "standard":
        return F.when(tier.between(1, 10), F.lit(11) - tier).otherwise(F.lit(5)).cast("int")
    if variant == "short":
        return F.when(tier.between(0, 4), F.lit(10) - tier).otherwise(F.lit(5)).cast("int")
    raise ValueError(f"unknown variant {variant!r}")


def location_class(scope_id: Column | str) -> Column:
    """Ids longer than 30 characters with four dashes or more belong to environments."""
    scope_id = col(scope_id)
    dashes = F.length(scope_id) - F.length(F.replace(scope_id, F.lit("-")))
    return F.when((F.length(scope_id) > 30) & (dashes >= 4), "Environment").otherwise("Application")


def operation_kind(operation: Column | str, success: Column | str) -> Column:
    text = F.lower(col(operation))
    return (F.when(text.rlike("skip|existing|already"), "skip")
            .when(text.rlike("update|modify|change"), "update")
            .when(text.rlike("create|add|new"), "create")
            .when(~col(success), "error")
            .otherwise("create"))


def percent(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole > 0, part * 100.0 / whole).otherwise(F.lit(empty))


def rate_band(rate: Column) -> Column:
    return F.when(rate >= 80, "good").when(rate >= 50, "fair").otherwise("poor")


def validity_band(rate: Column) -> Column:
    return F.when(rate == 100, "all").when(rate >= 80, "most").otherwise("low")
