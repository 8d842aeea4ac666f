"""Component suggestions from frequent asset names."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.tags import tag_value
from .clustering import complete_link_groups

# Types suggestions are made for.
SUGGESTED_TYPES = ["CONTAINER", "CLOUD"]


def name_group_sizes(assets: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Sizes of name groups per (applicationId, type): group name, size, first position.

    ``assets`` has applicationId, type, name, pos.  At threshold 1 a group is a name, so
    one aggregate does it; below, complete link inside each (scope, type) pair.
    """
    counted = assets.groupBy("applicationId", "type", "name").agg(
        F.count(F.lit(1)).alias("asset_count"), F.min("pos").alias("first_pos"))
    if threshold >= 1.0:
        return counted
    keyed = counted.withColumn("scope", F.to_json(F.struct("applicationId", "type")))
    groups = complete_link_groups(keyed.select("scope", "name", F.col("first_pos").alias("pos")), threshold, scope="scope")
    return (keyed.join(groups.select("scope", "name", "group_no"), ["scope", "name"])
            .groupBy("applicationId", "type", "group_no").agg(
                F.min_by("name", "first_pos").alias("name"), F.sum("asset_count").alias("asset_count"),
                F.min("first_pos").alias("first_pos")).drop("group_no"))


def component_suggestions(groups: DataFrame, environments: DataFrame, components: DataFrame,
                          more_than: int = 5) -> DataFrame:
    """Groups of more than ``more_than`` assets whose name is no component yet, once per type.

    Of several environments with the same group the first in scope order makes the
    suggestion.  ``environments`` has id, name, tags, pos; its ``pteam`` tag gives the team.
    """
    scopes = environments.select(F.col("id").alias("applicationId"), F.col("name").alias("environment_name"),
                                 F.try_element_at(F.filter("tags", lambda t: t["key"] == "pteam"), F.lit(1))["value"].alias("team"),
                                 F.col("pos").alias("scope_pos"))
    big = groups.filter((F.col("asset_count") > more_than) & F.col("type").isin(SUGGESTED_TYPES))
    fresh = big.join(components.select("name").distinct(), "name", "left_anti").join(scopes, "applicationId")
    order = F.struct("scope_pos", "first_pos")
    return (fresh.groupBy("type", "name").agg(
        F.min_by(F.struct("environment_name", "team", "asset_count"), order).alias("s"))
        .select("type", F.col("name").alias("component_name"), "s.*"))
