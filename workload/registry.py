"""Registered queries: name -> (Spark callable, check SQL or None)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .inputs import Inputs, check_sql

_QUERIES: dict[str, tuple[Callable[[Inputs], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn: Callable[[Inputs], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = (fn, sql)
        return fn
    return wrap


def load() -> None:
    for part in ("function", "source", "grouping", "placement", "people", "rule", "checks", "report"):
        importlib.import_module(f".{part}_queries", __package__)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return {name: (lambda spark, sf_dir, fn=fn: fn(Inputs(spark, sf_dir))) for name, (fn, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    load()
    return {name: check_sql(sql) for name, (_, sql) in _QUERIES.items() if sql is not None}
