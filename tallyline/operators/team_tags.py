"""Stale and missing tags of existing entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.repositories import last_two_parts


def expected_teams(repositories: DataFrame, overrides: DataFrame) -> DataFrame:
    """(name, teams, expected_team, subdomain): the distinct teams of each repository name with their subdomains; ``teams`` counts the
    rows of the name.  ``overrides`` (Key, Value, pos) replaces a repository's subdomain."""
    replaced = overrides.groupBy("Key").agg(F.max_by("Value", "pos").alias("Value"))
    rows = (repositories.join(replaced, repositories["RepositoryName"] == replaced["Key"], "left")
            .select(last_two_parts("RepositoryName").alias("name"), F.col("Team").alias("expected_team"),
                    F.coalesce("Value", "Subdomain").alias("subdomain")).distinct())
    counts = rows.groupBy("name").agg(F.count("expected_team").alias("teams"))
    return counts.join(rows, "name")


def stale_tags(components: DataFrame, expected: DataFrame) -> DataFrame:
    """``pteam`` tags of components named like a repository with another team: one row per tag, with the number of
    expected rows it differs from.

    A tag is looked up twice, by name for the number of rows and by name and team for those it agrees with; the teams
    themselves stay in ``expected`` (of ``expected_teams``).
    """
    tags = components.select(F.col("id").alias("component_id"), F.col("name").alias("component_name"), F.explode("tags").alias("t")).filter(
        F.col("t.key") == "pteam").select("component_id", "component_name", F.col("t.id").alias("tag_id"), F.col("t.value").alias("old_team"))
    known = expected.groupBy(F.col("name").alias("component_name")).agg(F.first("teams").alias("teams"))
    agreeing = expected.groupBy(F.col("name").alias("component_name"), F.col("expected_team").alias("old_team")).agg(F.count(F.lit(1)).alias("same"))
    found = tags.filter("old_team is not null").join(known, "component_name").join(agreeing, ["component_name", "old_team"], "left")
    return found.select("component_id", "component_name", "tag_id", "old_team", (F.col("teams") - F.coalesce("same", F.lit(0))).alias("differing")).filter(
        "differing > 0")


def stale_team_tags(components: DataFrame, repositories: DataFrame, overrides: DataFrame) -> DataFrame:
    """``pteam`` tags to remove from components named like a repository whose team differs: ``stale_tags`` with a row for
    each differing team and its subdomain."""
    repos = expected_teams(repositories, overrides).select(F.col("name").alias("_name"), "expected_team", "subdomain")
    tags = components.select("id", F.col("name").alias("_name"), F.explode("tags").alias("t")).filter(F.col("t.key") == "pteam")
    return (tags.join(repos, "_name").filter(F.col("t.value") != F.col("expected_team"))
            .select(F.col("id").alias("component_id"), F.col("_name").alias("component_name"), F.col("t.id").alias("tag_id"),
                    F.col("t.value").alias("old_team"), "expected_team", "subdomain"))


def team_tag_changes(declared: DataFrame, actual: DataFrame, keys: list[str], add: bool = True) -> DataFrame:
    """Team tags to remove (stored, not declared) and, for applications, to add (declared, not stored).

    Both sides share ``keys``; declared has TeamNames, actual has id and tags.
    """
    joined = declared.select(*keys, "TeamNames").join(actual.select(*keys, "id", "tags"), keys)
    # Null names count on neither side.
    teams = F.array_compact(F.coalesce("TeamNames", F.array().cast("array<string>")))
    stored = F.array_compact(F.transform(F.filter(F.coalesce("tags", F.array().cast("array<struct<id:string,key:string,value:string>>")),
                                  lambda t: t["key"] == "pteam"), lambda t: t["value"]))
    act = lambda values, name: F.transform(values, lambda v: F.struct(F.lit(name).alias("action"), v.alias("team")))
    gone = act(F.filter(stored, lambda v: ~F.array_contains(teams, v)), "remove")
    changes = gone
    if add:
        changes = F.concat(gone, act(F.filter(teams, lambda v: ~F.array_contains(stored, v)), "add"))
    return joined.select(*keys, F.col("id").alias("entity_id"), F.explode(changes).alias("c")).select(*keys, "entity_id", "c.*")
