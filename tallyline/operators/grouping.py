"""Grouping assets: by tag, and by type-specific fallbacks for untagged ones.

Assignment is one projection per asset (``assign``); only name similarity needs more.
Everything about a group (size, first type, metadata of its first or last asset) is a
partial aggregate, so a group holding a third of all assets costs one row per task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.naming import GROUP_SEPARATOR, application_name, component_name
from ..functions.network import network24
from ..functions.tags import has_tag, tag_value
from ..functions.text import blank_to_null
from ..session import cut_lineage
from .clustering import leader_groups
from .common import top_per_group

# Types grouped by repository.
SOFTWARE_TYPES = ["REPOSITORY", "SOURCE_CODE", "BUILD", "FOSS", "SAST"]


@dataclass(frozen=True)
class GroupingOptions:
    primary_tag: str | None = None
    secondary_tag: str | None = None
    use_networks: bool = True
    host_threshold: float = 0.8
    container_threshold: float = 0.85
    include_region: bool = True
    min_assets: int = 2
    template: str = "application_with_team"
    prefix: str = ""
    suffix: str = ""


def asset_type(c: str = "type") -> Column:
    return F.coalesce(F.col(c), F.lit("UNKNOWN"))


def with_tag_group(assets: DataFrame, primary: str, secondary: str | None = None) -> DataFrame:
    """Adds ``primary_value``, ``secondary_value`` and ``tag_group``; null group = untagged.

    The last of a repeated key wins, an empty primary value means untagged, an absent
    secondary tag reads ``NoTeam`` in the key (a present one without value reads ``None``).
    """
    value = blank_to_null(tag_value("tags", primary))
    out = assets.withColumn("primary_value", value)
    if secondary is None:
        return out.withColumn("secondary_value", F.lit(None).cast("string")).withColumn("tag_group", F.col("primary_value"))
    second = tag_value("tags", secondary)
    shown = F.when(has_tag("tags", secondary), F.coalesce(second, F.lit("None"))).otherwise(F.lit("NoTeam"))
    return (out.withColumn("secondary_value", second)
            .withColumn("tag_group", F.concat("primary_value", F.lit(GROUP_SEPARATOR), shown)))


def group_by_tags(assets: DataFrame, primary: str, secondary: str | None = None) -> DataFrame:
    """One row per tag group; metadata of a group come from its last asset."""
    tagged = with_tag_group(assets, primary, secondary).filter(F.col("tag_group").isNotNull())
    # Raw rows are only counted, by everything that is reported; the winning values are picked among those few rows.
    counted = tagged.groupBy(F.col("tag_group").alias("group_key"), "primary_value", "secondary_value", asset_type().alias("asset_type")).agg(
        F.count(F.lit(1)).alias("n"), F.max("pos").alias("last"))
    return counted.groupBy("group_key").agg(
        F.sum("n").alias("asset_count"), F.max_by(F.struct("primary_value", "secondary_value", "asset_type"), "last").alias("m")
    ).select("group_key", "asset_count", F.lit("tag").alias("method"), F.lit(primary).alias("primary_tag"),
             "m.primary_value", F.lit(secondary).cast("string").alias("secondary_tag"), "m.secondary_value", "m.asset_type")


def untagged(assets: DataFrame, primary: str, secondary: str | None = None) -> DataFrame:
    return with_tag_group(assets, primary, secondary).filter(F.col("tag_group").isNull())


def untagged_by_type(assets: DataFrame) -> DataFrame:
    """Number of assets per type, absent type ``UNKNOWN``."""
    return assets.groupBy(asset_type().alias("asset_type")).agg(F.count(F.lit(1)).alias("asset_count"))


def host_name() -> Column:
    return F.coalesce(blank_to_null("hostname"), blank_to_null("assetName"))


def image_name() -> Column:
    return F.coalesce(blank_to_null("imageName"), F.col("assetName"), F.lit(""))


def network_of(assets: DataFrame) -> DataFrame:
    """Adds ``network``: the /24 of a valid address, else null."""
    return assets.withColumn("network", network24("ip"))


def infra_networks(assets: DataFrame) -> DataFrame:
    """Network groups of infrastructure assets: ``CIDR-`` + network, with their size."""
    return (network_of(assets).filter(F.col("network").isNotNull())
            .groupBy(F.concat(F.lit("CIDR-"), "network").alias("group_key"), "network")
            .agg(F.count(F.lit(1)).alias("asset_count")))


def similar_name_groups(assets: DataFrame, name: Column, threshold: float, prefix: str, width: int,
                        min_assets: int) -> tuple[DataFrame, DataFrame]:
    """Leader groups of assets by name: (members, groups).

    ``members``: every asset with its leader.  ``groups``: leaders with enough assets,
    key = prefix + first ``width`` characters, first ten names.  Groups under the minimum
    are dropped; of two groups with one key the later replaces the earlier.
    """
    named = assets.withColumn("_name", name)
    leaders = leader_groups(named.select(F.col("_name").alias("name"), "pos"), threshold)
    members = named.join(leaders.select(F.col("name").alias("_name"), "leader", "leader_pos"), "_name")
    sizes = members.groupBy("leader", "leader_pos").agg(F.count(F.lit(1)).alias("asset_count"))
    kept = sizes.filter(F.col("asset_count") >= min_assets).withColumn(
        "group_key", F.concat(F.lit(prefix), F.substring("leader", 1, width)))
    last = kept.groupBy("group_key").agg(
        F.max_by(F.struct("leader", "leader_pos", "asset_count"), "leader_pos").alias("g")).select("group_key", "g.*")
    samples = (top_per_group(members.select("leader_pos", "_name", "pos"), ["leader_pos"], [F.asc("pos")], 10)
               .groupBy("leader_pos").agg(F.array_sort(F.collect_list(F.struct("pos", "_name"))).alias("s"))
               .select("leader_pos", F.transform("s", lambda x: x["_name"]).alias("sample_names")))
    return members, last.join(samples, "leader_pos")


def host_groups(assets: DataFrame, threshold: float = 0.8, min_assets: int = 2,
                use_networks: bool = True) -> tuple[DataFrame, DataFrame]:
    """Name groups of infrastructure assets without a usable address."""
    rest = network_of(assets).filter(F.col("network").isNull()) if use_networks else assets
    return similar_name_groups(rest.filter(host_name().isNotNull()), host_name(), threshold, "INFRA-", 30, min_assets)


def container_groups(assets: DataFrame, threshold: float = 0.85, min_assets: int = 2) -> tuple[DataFrame, DataFrame]:
    """Image-name groups of containers."""
    return similar_name_groups(assets, image_name(), threshold, "CONTAINER-", 40, min_assets)


def repository_key() -> Column:
    return F.coalesce(blank_to_null("repository"),
                      F.concat(F.lit("CODE-"), F.coalesce("assetName", F.lit("unknown"))))


def software_by_repository(assets: DataFrame) -> DataFrame:
    """Repository groups; an asset without repository forms its own by name.  Type of the first asset."""
    counted = assets.groupBy(repository_key().alias("group_key"), F.coalesce("type", F.lit("REPOSITORY")).alias("asset_type")).agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    return counted.groupBy("group_key").agg(F.sum("n").alias("asset_count"), F.min_by("asset_type", "first").alias("asset_type"))


def cloud_key(include_region: bool = True) -> Column:
    parts = [F.coalesce("cloudProvider", F.lit("UNKNOWN")), F.coalesce("account", F.lit("no-account"))]
    if include_region:
        parts.append(F.coalesce("region", F.lit("no-region")))
    return F.concat_ws("-", *parts)


def cloud_by_account(assets: DataFrame, include_region: bool = True) -> DataFrame:
    """Provider-account(-region) groups; account and region of the first asset."""
    counted = assets.groupBy(cloud_key(include_region).alias("group_key"), F.coalesce("cloudProvider", F.lit("UNKNOWN")).alias("cloud_provider"),
                             F.coalesce("account", F.lit("no-account")).alias("account"), "region").agg(
        F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    return counted.groupBy("group_key").agg(F.sum("n").alias("asset_count"), F.min_by(
        F.struct("cloud_provider", "account", "region"), "first").alias("m")).select("group_key", "asset_count", "m.*")


def assign(assets: DataFrame, options: GroupingOptions) -> DataFrame:
    """Every asset with the group instance it falls into; no shuffle.

    ``phase`` 0 = tagged, 1 = fallback.  ``step`` orders the fallbacks of one type.
    ``group_key`` stays null where name similarity decides (hosts, containers).
    """
    if options.primary_tag:
        rows = with_tag_group(assets, options.primary_tag, options.secondary_tag)
    else:
        rows = assets.select("*", *[F.lit(None).cast("string").alias(c)
                                    for c in ("primary_value", "secondary_value", "tag_group")])
    rows = rows.withColumn("network", network24("ip") if options.use_networks else F.lit(None).cast("string"))
    kind = asset_type()
    tagged, infra = F.col("tag_group").isNotNull(), kind == "INFRA"
    software = kind.isin(SOFTWARE_TYPES)
    method = (F.when(tagged, "tag")
              .when(infra & F.col("network").isNotNull(), "cidr")
              .when(infra & host_name().isNotNull(), "hostname")
              .when(infra, "type")
              .when(software, "repository")
              .when(kind == "CONTAINER", "image_name")
              .when(kind == "CLOUD", "cloud_provider")
              .otherwise("type"))
    key = (F.when(tagged, F.col("tag_group"))
           .when(infra & F.col("network").isNotNull(), F.concat(F.lit("CIDR-"), "network"))
           .when(infra & host_name().isNull(), "INFRA-Ungrouped")
           .when(software, repository_key())
           .when(kind == "CLOUD", cloud_key(options.include_region))
           .when(~kind.isin("INFRA", "CONTAINER"), F.concat(kind, F.lit("-Unassigned"))))
    step = (F.when(F.col("method") == "hostname", 1)
            .when((F.col("method") == "type") & (kind == "INFRA"), 2).otherwise(0))
    return (rows.withColumn("method", method).withColumn("group_key", key)
            .withColumn("phase", F.when(tagged, 0).otherwise(1)).withColumn("step", step))


def name_decided(assigned: DataFrame, options: GroupingOptions) -> DataFrame:
    """Groups by name similarity among assigned assets, in the shape ``all_groups`` uses."""
    named = cut_lineage(assigned.filter(F.col("method").isin("hostname", "image_name")).select(
        "pos", "type", "method", F.when(F.col("method") == "hostname", host_name()).otherwise(image_name()).alias("decided_by")))
    parts = []
    for method, threshold, prefix, width in (("hostname", options.host_threshold, "INFRA-", 30),
                                             ("image_name", options.container_threshold, "CONTAINER-", 40)):
        rows = named.filter(F.col("method") == method)
        members, groups = similar_name_groups(rows, F.col("decided_by"), threshold, prefix, width, options.min_assets)
        first = members.groupBy("leader_pos").agg(F.min("pos").alias("first_pos"),
                                                  F.min_by(asset_type(), "pos").alias("first_type"))
        parts.append(groups.join(first, "leader_pos").select(
            "group_key", "asset_count", "first_type", "first_pos", "leader_pos",
            F.col("leader").alias("name_pattern"), "sample_names"))
    return parts[0].withColumn("method", F.lit("hostname")).withColumn("step", F.lit(1)).unionByName(
        parts[1].withColumn("method", F.lit("image_name")).withColumn("step", F.lit(0)))


def counted_assets(assigned: DataFrame) -> DataFrame:
    """Assets counted by group and by everything that a group reports of its first or last asset: asset_count, first_pos, last_pos.

    The one pass over the assets.  It aggregates numbers only, so raw rows are neither sorted nor carried; network and account
    count only where they make the group, and the rows that are left are few.
    """
    kind = asset_type()
    return cut_lineage(assigned.groupBy(
        "group_key", "method", "phase", "step", kind.alias("type"), "primary_value", "secondary_value",
        F.when(F.col("method") == "cidr", F.col("network")).alias("cidr"),
        F.when(F.col("method") == "cloud_provider", F.coalesce("account", F.lit("no-account"))).alias("account")).agg(
        F.count(F.lit(1)).alias("asset_count"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")))


def _keyed_instances(counted: DataFrame) -> DataFrame:
    instances = counted.filter(F.col("group_key").isNotNull()).groupBy(
        "group_key", "method", "phase", "step", F.when(F.col("phase") == 1, F.col("type")).alias("fallback_type")).agg(
        F.sum("asset_count").alias("asset_count"), F.min_by(F.struct("type", "cidr", "account"), "first_pos").alias("f"),
        F.max_by(F.when(F.col("phase") == 0, F.struct("primary_value", "secondary_value")), "last_pos").alias("m"), F.min("first_pos").alias("first_pos"))
    return instances.select(
        "group_key", "method", "phase", "step", "fallback_type", "asset_count", "first_pos", F.col("f.type").alias("first_type"),
        "m.primary_value", "m.secondary_value", "f.cidr", "f.account",
        F.lit(None).cast("bigint").alias("leader_pos"), F.lit(None).cast("string").alias("name_pattern"),
        F.lit(None).cast("array<string>").alias("sample_names"))


def fallback_starts(counted: DataFrame) -> DataFrame:
    """Position of the first untagged asset of each type."""
    return counted.filter("phase = 1").groupBy(F.col("type").alias("fallback_type")).agg(F.min("first_pos").alias("type_pos"))


def keyed_groups(assets: DataFrame, options: GroupingOptions) -> DataFrame:
    """Groups of every path but name similarity, from one counted pass over the assets."""
    counted = counted_assets(assign(assets, options))
    return keep_later(_keyed_instances(counted), fallback_starts(counted))


def all_groups(assets: DataFrame, options: GroupingOptions) -> DataFrame:
    """One row per group over all paths.  Of groups with one key the later made replaces the earlier:
    fallbacks replace tag groups, and among fallbacks the type that appeared later wins."""
    assigned = assign(assets, options)
    counted = counted_assets(assigned)
    named = name_decided(assigned, options)
    instances = _keyed_instances(counted).unionByName(named.select(
        "group_key", "method", F.lit(1).alias("phase"), "step", F.col("first_type").alias("fallback_type"),
        "asset_count", "first_pos", "first_type", "leader_pos", "name_pattern", "sample_names"),
        allowMissingColumns=True)
    return keep_later(instances, fallback_starts(counted))


def keep_later(instances: DataFrame, starts: DataFrame) -> DataFrame:
    """Override union of group maps (one winner per key); ``starts`` gives the fallback types their order (fallback_type, type_pos)."""
    ordered = instances.join(starts, "fallback_type", "left")
    rank = F.struct("phase", F.coalesce("type_pos", F.lit(-1)).alias("t"), "step",
                    F.coalesce("leader_pos", F.lit(-1)).alias("l"))
    rest = [c for c in instances.columns if c != "group_key"]
    return (ordered.groupBy("group_key").agg(F.max_by(F.struct(*rest), rank).alias("g"))
            .select("group_key", "g.*"))


def grouping_plan(groups: DataFrame, options: GroupingOptions) -> DataFrame:
    """Groups of the minimum size with application and component names."""
    return (groups.filter(F.col("asset_count") >= options.min_assets)
            .withColumn("application_name", application_name("group_key", "primary_value"))
            .withColumn("component_name", component_name(
                "group_key", "primary_value", "secondary_value", options.template, options.prefix, options.suffix)))


def member_rows(assets: DataFrame, options: GroupingOptions) -> DataFrame:
    """Long form (asset_id, pos, group_key, method) of assets whose group needs no name similarity."""
    return assign(assets, options).filter(F.col("group_key").isNotNull()).select("asset_id", "pos", "group_key", "method")
