"""Order traps of grouping, and greedy clustering against its sequential definition."""

import random

import pytest
from pyspark.sql import functions as F

from tallyline import schemas
from tallyline.functions.similarity import ratio_of
from tallyline.operators import grouping, profile, structure
from tallyline.operators.clustering import Budget, complete_link_groups, leader_groups, similar_pairs
from tallyline.operators.common import number_rows
from tallyline.plans.autogroup import autogroup

SMALL = Budget(walked_names=40, walked_pairs=60, per_token=2, candidate_rows=300, rows_per_token=0, key_pairs=40, part_edges=12)


def assets(spark, rows):
    full = [{"asset_id": str(i), "pos": i, **r} for i, r in enumerate(rows)]
    names = [f.split()[0] for f in schemas.ASSET.replace("\n", " ").split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], schemas.ASSET)


def leaders(names, t):
    found, out = [], {}
    for n in names:
        out[n] = next((x for x in found if ratio_of(n, x) >= t), n)
        if out[n] == n:
            found.append(n)
    return out


def complete(names, t):
    groups, out = [], {}
    for n in names:
        g = next((g for g in groups if all(ratio_of(n, m) >= t for m in g)), None)
        if g is None:
            groups.append(g := [])
        g.append(n)
        out[n] = g[0]
    return out


def random_names(seed, n=160):
    rnd = random.Random(seed)
    return list(dict.fromkeys("".join(rnd.choice("abc-1") for _ in range(rnd.randint(0, 13))) for _ in range(n)))


def families(seed, n=150):
    """Many families of alike names, mixed in order, beside some loners."""
    rnd = random.Random(seed)
    stems = ["".join(rnd.choice("abcdefg-") for _ in range(rnd.randint(8, 14))) for _ in range(12)]
    made = [f"{rnd.choice(stems)}{rnd.randint(0, 999):0{rnd.choice([2, 4])}d}" for _ in range(n)]
    return list(dict.fromkeys(made + random_names(seed + 1, 20)))


def listed(spark, names):
    return spark.createDataFrame(list(zip(names, range(len(names)))), "name string, pos bigint")


@pytest.mark.parametrize("budget", [SMALL, Budget()], ids=["small", "default"])
@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.8, 0.95])
def test_leader_groups_equal_sequential(spark, threshold, budget):
    for names in (random_names(int(threshold * 100)), families(int(threshold * 100))):
        got = {r["name"]: r["leader"] for r in leader_groups(listed(spark, names), threshold, budget).collect()}
        assert got == leaders(names, threshold)


@pytest.mark.parametrize("budget", [SMALL, Budget()], ids=["small", "default"])
@pytest.mark.parametrize("threshold", [0.7, 0.85])
def test_complete_link_equals_sequential(spark, threshold, budget):
    for names in (random_names(int(threshold * 1000), 110), families(int(threshold * 1000), 90)):
        got = {r["name"]: names[r["group_no"]] for r in complete_link_groups(listed(spark, names), threshold, budget=budget).collect()}
        assert got == complete(names, threshold)


def test_complete_link_lists_no_pairs_of_a_family(spark, monkeypatch):
    from tallyline.operators import clustering
    monkeypatch.setattr(clustering, "similar_pairs", lambda *a, **k: pytest.fail("pairs are listed"))
    names = [f"server-of-the-{s}-{i * 7 % 1000:03d}" for i in range(100) for s in ("north", "south")] + ["x" * 70, "x" * 69 + "y", ""]
    for budget in (Budget(part_edges=5000), Budget()):
        got = {r["name"]: names[r["group_no"]] for r in complete_link_groups(listed(spark, names), 0.85, budget=budget).collect()}
        assert got == complete(names, 0.85)


@pytest.mark.parametrize("budget", [Budget(part_edges=800, bucket_names=8, alone_names=0), Budget(part_edges=800, bucket_names=1000, alone_names=0)], ids=["buckets", "one"])
def test_complete_link_of_chunks_and_buckets(spark, budget):
    rnd = random.Random(12)
    names = [*families(5, 120), "", "x" * 70, "x" * 69 + "y", "é" * 20, "é" * 19 + "ü", *("".join(chr(0x4E00 + rnd.randrange(300)) for _ in range(6)) + "-host" for _ in range(20))]
    got = {r["name"]: names[r["group_no"]] for r in complete_link_groups(listed(spark, names), 0.7, budget=budget).collect()}
    assert got == complete(names, 0.7)


def test_the_walk_of_a_chunk_compares_no_names():
    import numpy as np
    from tallyline.operators import clustering
    names = np.array([f"server-{s}-{i * 7 % 1000:03d}" for i in range(50) for s in ("north", "south")], dtype=object)
    at = np.arange(len(names))
    near = clustering._near_later(clustering._Names(names, 0.85, at), at)
    whole = clustering._walk(near, at, [], np.zeros((0, near.shape[1]), dtype=np.uint8))
    assert [names[g] for g in whole] == list(complete(names.tolist(), 0.85).values())
    # The second half alone, with the groups of the first half told in bits.
    later = clustering._Names(np.concatenate([names[:50][np.argsort(whole[:50], kind="stable")], names[50:]]), 0.85, at[50:])
    numbers, starts = np.unique(np.sort(whole[:50]), return_index=True)
    found = list(clustering._open_groups(later, numbers, starts))
    second = clustering._walk(clustering._near_later(later, at[50:]), at[50:], [n for n, _ in found], np.array([b for _, b in found]))
    assert second.tolist() == whole[50:].tolist()


def test_complete_link_of_scopes_and_absent_values(spark):
    rows = [("a", "server-one", 0), ("b", "server-ona", 1), ("a", "server-ona", 2), (None, "server-one", 3), ("a", None, 4), ("a", "server-onx", 5)]
    df = spark.createDataFrame(rows, "scope string, name string, pos int")
    got = complete_link_groups(df, 0.8, scope="scope", budget=Budget(part_edges=1))
    assert got.columns == ["scope", "name", "pos", "group_no"]
    assert {r["pos"]: r["group_no"] for r in got.collect()} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4, 5: 0}


def test_rounds_do_not_grow_with_leaders(spark, monkeypatch):
    from tallyline.operators import clustering
    rounds = []
    plain = clustering._first_edges
    monkeypatch.setattr(clustering, "_first_edges", lambda *a: rounds.append(1) or plain(*a))
    seen = []
    for many in (4, 32):
        rnd = random.Random(many)
        stems = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14)) for _ in range(many)]
        names = [f"{s}{i:02d}" for s in stems for i in range(20)]
        rounds.clear()
        got = {r["leader"] for r in leader_groups(listed(spark, names), 0.8, SMALL).collect()}
        assert len(got) >= many
        seen.append(len(rounds))
    assert seen[1] <= seen[0] + 1


def test_a_chain_differs_between_leader_and_complete_link(spark):
    names = ["aaaaaaaaaa", "aaaaaaaabb", "aaaaaabbbb"]
    df = spark.createDataFrame(list(zip(names, range(3))), "name string, pos bigint")
    assert {r["leader"] for r in leader_groups(df, 0.8).collect()} == {names[0], names[2]}
    assert ratio_of(names[1], names[2]) >= 0.8 > ratio_of(names[0], names[2])


def test_similar_pairs_lose_none(spark):
    names = random_names(9, 120)
    df = spark.createDataFrame([(n,) for n in names], "name string")
    for budget in (SMALL, Budget()):
        rows = similar_pairs(df, df, 0.75, half=True, budget=budget).collect()
        got = {(r["name"], r["other"]) for r in rows}
        assert len(got) == len(rows) and got == {(a, b) for a in names for b in names if a < b and ratio_of(a, b) >= 0.75}


def test_last_duplicate_tag_wins_and_empty_primary_is_untagged(spark):
    df = assets(spark, [
        {"tags": [("App", "one"), ("App", "two"), ("Team", "t")]}, {"tags": [("App", ""), ("Team", "t")]}, {"tags": None}, {"tags": []},
        {"tags": [("App", "two")]}, {"tags": [("App", "two"), ("Team", None)]}])
    got = {r["group_key"]: r["asset_count"] for r in grouping.group_by_tags(df, "App", "Team").collect()}
    assert got == {"two|||t": 1, "two|||NoTeam": 1, "two|||None": 1}
    assert grouping.untagged(df, "App", "Team").count() == 3


def test_profile_counts_occurrences(spark):
    df = assets(spark, [{"tags": [("k", "a"), ("k", "b"), (" k ", " a "), ("", "x"), ("y", " ")]}, {"tags": None}])
    row = profile.tag_profile(df).collect()[0]
    assert (row["key"], row["asset_count"], row["unique_values"], row["coverage_percent"], row["distinct_coverage_percent"]) == ("k", 3, 2, 150.0, 50.0)


def test_recommendation_limits(spark):
    rows = [{"tags": [(f"k{j:02d}", "v") for j in range(14) if i <= 20 - j]} for i in range(20)]
    p = profile.tag_profile(assets(spark, rows))
    plain = [r["key"] for r in profile.recommend_tags(p, min_count=2).orderBy("rank").collect()]
    assert len(plain) == 10 and plain[0] == "k00"
    listed = [f"k{j:02d}" for j in range(11)]
    more = [r["key"] for r in profile.recommend_tags(p, listed, min_count=2).orderBy("rank").collect()]
    assert more == listed + ["k11"]


def test_fallback_replaces_tag_group_and_host_keys_collide(spark):
    hosts = [f"{'h' * 30}{c * 20}" for c in "xy"]
    df = assets(spark, [{"type": "INFRA", "tags": [("App", "WEB-Unassigned")]}, {"type": "INFRA", "tags": [("App", "WEB-Unassigned")]},
                        {"type": "WEB"}, {"type": "WEB"}, {"type": "WEB"}] +
                [{"type": "INFRA", "hostname": h} for h in (hosts[0], hosts[0], hosts[1], hosts[1])] + [{"type": "INFRA"}, {"type": "INFRA"}])
    options = grouping.GroupingOptions("App", host_threshold=0.99)
    got = {r["group_key"]: (r["method"], r["asset_count"], r["name_pattern"]) for r in grouping.all_groups(df, options).collect()}
    assert got["WEB-Unassigned"] == ("type", 3, None)
    assert got["INFRA-" + "h" * 30] == ("hostname", 2, hosts[1])
    assert got["INFRA-Ungrouped"] == ("type", 2, None)


def test_autogroup_end_to_end(spark, tmp_path):
    rows = [{"type": "REPOSITORY", "repository": "r1"}] * 3 + [{"type": "WEB", "tags": [("App", "My app"), ("Team", "T")]}] * 12
    out = autogroup(assets(spark, rows), defaults=structure.StructureDefaults(copy_team=True), primary=("App",), secondary=("Team",))
    assert (out.primary_tag, out.secondary_tag) == ("App", "Team")
    got = {(r["application_name"], r["component_name"], r["team"], r["rule"]["Tag"], r["rule"]["RepositoryName"]) for r in out.components.collect()}
    assert got == {("My-app", "My-app-T", "T", "App: My app", None), ("r1", "r1", None, None, "r1")}
    assert [r["team"] for r in out.teams.collect()] == ["T"]
    from tallyline.sources import sinks
    sinks.write_plan(out.plan, str(tmp_path / "plan"))
    sinks.write_structure(str(tmp_path / "s"), applications=out.applications, components=out.components)
    assert spark.read.parquet(str(tmp_path / "plan")).count() == 2
    assert spark.read.json(str(tmp_path / "s/components")).count() == 2


def test_number_rows_over_many_ranges(spark):
    df = spark.range(1000).select((F.col("id") * F.col("id")).alias("pos"))
    got = [(r["pos"], r["row_no"]) for r in number_rows(df, "pos", span=60, cells=5).collect()]
    assert sorted(got) == [(i * i, i + 1) for i in range(1000)]


def test_similar_suggestions_stay_inside_their_scope(spark):
    from tallyline.operators.suggestions import name_group_sizes
    data = [("e1", "CLOUD", "server-one", 0), ("e1", "CLOUD", "server-ona", 1), ("e2", "CLOUD", "server-onb", 2), ("e1", "CONTAINER", "server-onc", 3)]
    df = spark.createDataFrame(data, "applicationId string, type string, name string, pos bigint")
    got = {(r["applicationId"], r["type"], r["name"], r["asset_count"]) for r in name_group_sizes(df, 0.8).collect()}
    assert got == {("e1", "CLOUD", "server-one", 2), ("e2", "CLOUD", "server-onb", 1), ("e1", "CONTAINER", "server-onc", 1)}


def test_similar_pairs_of_a_hot_scope_are_split_and_whole(spark):
    names = families(11, 80)
    sides = [("hot" if i % 3 else f"s{i % 7}", n) for i, n in enumerate(names) if n]
    df = spark.createDataFrame(sides, "scope string, name string")
    got = {(r["scope"], r["name"], r["other"]) for r in similar_pairs(df, df, 0.8, scope="scope", budget=SMALL).collect()}
    assert got == {(s, a, b) for s, a in sides for t, b in sides if s == t and ratio_of(a, b) >= 0.8}
