"""Ticketing and messaging settings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col, blank_to_null

_FIELDS = {"ticketing": ("TIntegrationName", "Backlog"), "messaging": ("MIntegrationName", "Channel")}


def loaded(settings: Column | str, kind: str) -> Column:
    """The list itself when its first entry names a target and an integration (either spelling), else null."""
    settings = col(settings)
    own, target = _FIELDS[kind]
    first = F.get(settings, F.lit(0))
    named = F.coalesce(blank_to_null(first[own]), blank_to_null(first["IntegrationName"])).isNotNull()
    return F.when(named & blank_to_null(first[target]).isNotNull(), settings)


def target_of(settings: Column | str, kind: str, accept_old_name: bool = False, need_name: bool = True) -> Column:
    """``struct<integration,target>`` of the first entry, null when it cannot be used.

    ``need_name=False`` asks only for a target, as creating an environment does.
    """
    own, target = _FIELDS[kind]
    first = F.get(col(settings), F.lit(0))
    name = blank_to_null(first[own])
    if accept_old_name:
        name = F.coalesce(name, blank_to_null(first["IntegrationName"]))
    goal = blank_to_null(first[target])
    usable = goal.isNotNull() & (name.isNotNull() if need_name else F.lit(True))
    return F.when(usable, F.struct(name.alias("integration"), goal.alias("target")))
