"""Literal rows for placement, people, deployments, rules, checks, sources and streaming."""

import json

import pytest

from pyspark.sql import functions as F

from tallyline import schemas
from tallyline.operators import deployments, people, placement, quality, report, rules, team_tags
from tallyline.plans import check
from tallyline.sources import configs, images, readers
from tallyline.streaming import operations


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def actual(spark, data):
    return spark.createDataFrame([(i, n, s, [], p) for i, n, s, p in data], schemas.ACTUAL_COMPONENT)


def test_placement_last_id_wins_and_other_scopes(spark):
    have = actual(spark, [("1", "API", "a", 1), ("2", "api", "a", 2), ("3", "Api", "b", 3)])
    want = spark.createDataFrame([("api", "a"), ("API", "c"), ("db", "a")], "name string, target string")
    assert rows(placement.place(want, have), "name", "target", "entity_id", "action_required", "conflict_type") == [
        ("API", "c", None, "create", "cross_scope"), ("api", "a", "2", "update_rules", "same_scope"), ("db", "a", None, "create", "none")]
    assert rows(placement.other_scopes(want, have), "name", "other_entities") == [("API", 3), ("api", 1), ("db", 0)]


def test_service_cascade(spark):
    long = "service-" + "x" * 60
    have = actual(spark, [("1", "Api", "e", 1), ("2", long + "y", "e", 2), ("3", "db-prod", "e", 3), ("4", long, "other", 4)])
    want = spark.createDataFrame([("API", "e", "Prod"), (long, "e", "Prod"), ("db", "e", "Prod"), ("none", "e", "Prod")], "name string, target string, env_name string")
    assert rows(placement.find_service(want, have), "name", "entity_id", "found_by") == [
        ("API", "1", "exact"), ("db", "3", "suffixed"), ("none", None, "none"), (long, "2", "similar")]


def test_application_lookup_prefers_exact(spark):
    scopes = spark.createDataFrame([("1", "APP", "APPLICATION", None, 1), ("2", "app", "APPLICATION", None, 2), ("3", "app", "ENVIRONMENT", None, 0)], schemas.ACTUAL_SCOPE)
    want = spark.createDataFrame([("app",), ("App",), ("x",)], "n string")
    assert rows(placement.find_application(want, "n", scopes), "n", "scope_id") == [("App", "1"), ("app", "2"), ("x", None)]


def test_deployment_set_before_tag(spark):
    apps = spark.createDataFrame([("A", "S1"), ("B", None), ("C", "s2")], "app_name string, deployment_set string")
    svc = spark.createDataFrame([("x", "E", "s1", "S1"), ("y", "E", None, "s1"), ("z", "E", "other", "S2")], "service string, env_name string, deployment_set string, deployment_tag string")
    assert rows(deployments.deployment_links(apps, svc), "app_name", "service", "link_by", "selector") == [
        ("A", "x", "name", "x"), ("A", "y", "tag", "s1"), ("C", "z", "tag", "S2")]
    assert rows(deployments.mismatch_counts(apps, svc), "deployment_set", "links", "mismatches") == [("S1", 2, 1), ("s2", 1, 2)]


def test_components_absent_from_the_snapshot_are_errors(spark):
    scopes = spark.createDataFrame([("a1", "Shop", "APPLICATION", None, 1)], schemas.ACTUAL_SCOPE)
    have = actual(spark, [("1", "cart", "a1", 1), ("2", "till", "other", 2)])
    comps = spark.createDataFrame([(1, "Shop", "cart", "s"), (2, "Shop", "till", "s"), (3, "Shop", "Cart", None), (4, "Gone", "cart", "s"), (5, "Shop", "", "s")],
                                  "component_id long, app_name string, component string, deployment_set string")
    svc = spark.createDataFrame([("x", "E", "S", None)], "service string, env_name string, deployment_set string, deployment_tag string")
    assert rows(deployments.component_links(comps, svc, scopes, have), "component_id", "selector") == [(1, "x")]
    assert rows(deployments.absent_components(comps, scopes, have), "component_id", "component") == [(2, "till"), (3, "Cart")]


def test_null_filter_is_expected_and_fails(spark):
    expected = spark.createDataFrame([(1, {"a": "x"}), (2, None), (3, {}), (4, None)], "n int, filter_map map<string,string>")
    have = spark.createDataFrame([({"a": "x"},)], "filter_map map<string,string>")
    assert rows(rules.compare_rule_sets(expected, have), "n", "status", "times_expected") == [
        (1, "created", 1), (2, "failed", 2), (3, "failed", 1), (4, "failed", 2)]


def test_reports_keep_records_without_category_and_file(spark):
    log = spark.createDataFrame([(1, None, None, "create", "i", True, None), (2, "f", "apps", "create", "j", False, "bad"), (3, None, "apps", "create", "k", False, "worse")],
                                "pos long, file string, category string, operation string, item string, success boolean, error string")
    assert rows(report.breakdown(log), "category", "records", "items") == [("apps", 2, ["j", "k"]), (None, 1, ["i"])]
    assert rows(report.errors_by_file(log), "file", "item", "errors") == [("f", "j", 1), (None, "k", 1)]


def test_null_team_hides_no_stored_team(spark):
    declared = spark.createDataFrame([("A", ["T1", None])], "app_name string, TeamNames array<string>")
    have = spark.createDataFrame([("A", "1", [("i", "pteam", "T9"), ("j", "pteam", None)])], "app_name string, id string, tags array<struct<id:string,key:string,value:string>>")
    assert rows(team_tags.team_tag_changes(declared, have, ["app_name"]), "action", "team") == [("add", "T1"), ("remove", "T9")]


def test_environment_missing_from_snapshot_passes(spark):
    scopes = spark.createDataFrame([("e1", "Known", "ENVIRONMENT", None, 1)], schemas.ACTUAL_SCOPE)
    svc = spark.createDataFrame([("a", "Known"), ("b", "Known"), ("c", "Unknown")], "service string, env_name string")
    got = deployments.known_services(svc, scopes, actual(spark, [("1", "a", "e1", 1)]))
    assert rows(got, "service", "usable") == [("a", True), ("b", False), ("c", True)]


def test_auto_links_default_is_equality(spark):
    apps = spark.createDataFrame([("Shop",), ("shops",)], "app_name string")
    svc = spark.createDataFrame([("SHOP", "e"), ("shops1", "e")], "service string, env_name string")
    assert rows(deployments.auto_links(apps, svc), "app_name", "service") == [("Shop", "SHOP")]
    assert rows(deployments.auto_links(apps, svc, 0.9), "app_name", "service") == [("Shop", "SHOP"), ("shops", "shops1")]


def test_membership(spark):
    teams = spark.createDataFrame([("t1",), ("t2",)], "name string")
    declared = spark.createDataFrame([("t1",)], "TeamName string")
    members = spark.createDataFrame([("t1", "Ann@x.org"), ("t1", None)], "team string, email string").filter("email is not null")
    current = spark.createDataFrame([("t1", "ANN@x.org"), ("t1", "lead@x.org"), ("t1", "gone@x.org"), ("t2", "stay@x.org")], "team string, email string")
    hives = spark.createDataFrame([("T2", "Lead@x.org", ["po@x.org"], 1), ("other", "l2@x.org", [], 2)], "team string, lead string, product array<string>, pos bigint")
    access = spark.createDataFrame([("root@x.org",)], "email string")
    got = people.membership_changes(teams, current, declared, members, hives, access)
    assert rows(got, "team", "email", "action") == [("t1", "gone@x.org", "remove"), ("t1", "root@x.org", "add"), ("t2", "Lead@x.org", "add"), ("t2", "po@x.org", "add")]


def test_rule_set_comparison_ignores_key_order(spark):
    expected = spark.createDataFrame([(1, {"a": "1", "b": "2"}), (2, {"a": "2"}), (3, {}), (4, {"b": "2", "a": "1"})], "n int, filter_map map<string,string>")
    have = spark.createDataFrame([({"b": "2", "a": "1"},)], "filter_map map<string,string>")
    assert rows(rules.compare_rule_sets(expected, have), "n", "status", "times_expected") == [(1, "created", 2), (2, "failed", 1), (3, "failed", 1), (4, "created", 2)]


TEXT = """DeploymentGroups:
- AppName: a
  Status: x
  # Status: no
  Components:
    - ComponentName: c
      Type: r
      Type: again
    - ComponentName: d
      Type: r
  Status: y
- AppName: b
  Status: z
DeploymentGroups:
"""


def test_repeated_keys(spark):
    df = spark.createDataFrame([(1, TEXT), (2, "a: 1\nb: 2"), (3, None)], "doc_id bigint, text string")
    got = quality.repeated_keys(df)
    assert rows(got, "line", "first_line", "key", "indent") == [(11, 3, "Status", 2), (14, 1, "DeploymentGroups", 0), (8, 7, "Type", 6)]


CONFIG = {"DeploymentGroups": [
    {"AppName": "A", "ReleaseDefinitions": [], "Responsable": "O@X.org", "TeamNames": ["t"], "Components": [
        {"ComponentName": "c", "Tags": ["abc"]}, {"ComponentName": "d", "TeamNames": None}, {"ComponentName": "e", "TeamNames": ["own"], "Hostnames": "h"}]},
    {"AppName": "Empty", "ReleaseDefinitions": [], "Responsable": "O@X.org", "Components": []},
    {"AppName": "None", "ReleaseDefinitions": [], "Responsable": "O@X.org"}],
    "EnvironmentGroups": [{"Name": "E", "Type": "CLOUD", "Tier": 1, "Status": "s", "Responsible": "O@X.org", "TeamName": "et"}]}


def test_config_files_load_and_check(spark, tmp_path):
    (tmp_path / "one.json").write_text(json.dumps(CONFIG))
    files = configs.read_config_files(spark, str(tmp_path)).withColumn("file", F.lit("one"))
    apps = configs.declared_applications(configs.roots(files))
    assert [r["app_name"] for r in apps.orderBy("app_pos").collect()] == ["A", "Empty"]
    assert configs.declared_applications(configs.roots(files), keep_empty=True).count() == 3
    got = configs.declared_components(apps)
    assert rows(got, "component", "TeamNames") == [("c", ["t"]), ("d", None), ("e", ["own"])]
    envs = configs.declared_environments(configs.roots(files))
    assert rows(envs, "env_name", "Responsable", "Criticality") == [("E", "o@x.org", 10)] and configs.declared_services(envs).count() == 0
    out = check.check_files(files)
    assert rows(out["counts"], "kind", "total", "valid") == [("application", 3, 3), ("component", 3, 1), ("environment", 1, 1)]
    assert rows(out["sections"], "finding", "subject") == [("empty Components", "Empty"), ("no Components key", "None")]


def test_asset_files_and_pages(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"asset_id": "1", "tags": [{"value": "v"}], "unknown": 1}, {"asset_id": "2"}]))
    assert rows(readers.assets_from_file(spark, str(tmp_path / "a.json"), lines=False), "asset_id") == [("1",), ("2",)]
    page = {"content": [{"id": "1", "name": "n", "applicationId": "e"}], "totalElements": 3, "last": False}
    (tmp_path / "p.json").write_text(json.dumps(page))
    pages = readers.pages_from_files(spark, str(tmp_path / "p.json"), schemas.ACTUAL_COMPONENT)
    assert rows(readers.fetch_audit(pages), "fetched", "declared", "missing", "complete") == [(1, 3, 2, False)]
    assert readers.actual_components(spark, str(tmp_path / "p.json")).count() == 1


def test_cluster_dumps(spark, tmp_path):
    pod = {"metadata": {"labels": {"team": "t", "chart": "ch"}}, "spec": {"containers": [{"image": "r/x/app:1"}, {"image": "r/side"}]}}
    job = {"metadata": {"labels": {"team": "t"}}, "spec": {"jobTemplate": {"spec": {"template": {"spec": {"containers": [{"image": "r/a:1"}, {"image": "r/b:1"}]}}}}}}
    (tmp_path / "pods.json").write_text(json.dumps({"items": [pod, pod]}))
    (tmp_path / "jobs.json").write_text(json.dumps({"items": [job]}))
    got = images.cluster_images(images.dump_items(spark, str(tmp_path / "jobs.json"), images.CRON_JOB), images.dump_items(spark, str(tmp_path / "pods.json"), images.POD), "s", "1")
    assert rows(got, "image_name", "repo") == [("a", None), ("app", "ch"), ("b", None)]


def test_sample_takes_every_nth(spark):
    df = spark.range(1, 101).select(F.col("id").alias("pos"))
    assert [r["pos"] for r in report.systematic_sample(df, 10).orderBy("pos").collect()] == list(range(10, 101, 10))


def test_streaming_counters(spark, tmp_path):
    src = tmp_path / "log"
    src.mkdir()
    log = [{"ts": "2024-01-01T00:00:00Z", "category": "services", "operation": "create_x", "item": str(i), "success": i % 4 != 0, "pos": i} for i in range(8)]
    (src / "1.json").write_text("\n".join(json.dumps(r) for r in log))
    q = operations.start(operations.live_statistics(operations.read_log_stream(spark, str(src))), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out")), "category", "processed", "created", "errored", "success_rate") == [("services", 8, 6, 2, 75.0)]


def test_sync_steps_hand_their_rows_on(spark):
    from tallyline.plans import sync
    teams = spark.createDataFrame([("T1", False), ("T2", True)], "TeamName string, RecreateTeamAssociations boolean")
    actual_teams = spark.createDataFrame([("t2", "T2")], "id string, name string")
    members = spark.createDataFrame([("T2", "a@x.org", "Ann A", "", "Employee", 1)], "team string, email string, name string, employee_role string, employee_type string, pos long")
    hives = spark.createDataFrame([], "team string, lead string, product array<string>, pos long")
    access = spark.createDataFrame([], "email string")
    current = spark.createDataFrame([("T2", "old@x.org")], "team string, email string")
    users = spark.createDataFrame([], "email string")
    out = sync.people_actions(teams, members, hives, access, actual_teams, current, users)
    assert rows(out["teams"], "team") == [("T1",)]
    assert rows(out["team_rules"], "team", "reason") == [("T1", "new"), ("T2", "recreate")]
    assert rows(out["memberships"], "email", "action") == [("a@x.org", "add"), ("old@x.org", "remove")]
    assert [r["email"] for r in out["users"].collect()] == ["a@x.org"]


def test_products_are_joined_by_parts(spark):
    from tallyline.operators.common import paired
    left, right = spark.range(50).withColumnRenamed("id", "a"), spark.range(7).withColumnRenamed("id", "b")
    assert sorted((r["a"], r["b"]) for r in paired(left, right).collect()) == [(a, b) for a in range(50) for b in range(7)]
    assert paired(left, right.limit(0)).count() == 0


def test_files_of_one_partition_are_checked_by_many_tasks(spark):
    from tallyline.plans.check import declared_items
    from tallyline.sources import configs
    raw = '{"DeploymentGroups":[{"AppName":"a","Components":[{"ComponentName":"c"}]}]}'
    files = spark.createDataFrame([(f"f{i}", raw) for i in range(64)], "file string, raw string").coalesce(1)
    for rows in (configs.declared_applications(configs.roots(files)), declared_items(files).filter("kind = 'component'")):
        assert rows.count() == 64 and rows.select(F.spark_partition_id()).distinct().count() > 4


def test_links_of_one_set_are_made_by_many_tasks(spark):
    from tallyline.operators.deployments import links_of
    members = spark.createDataFrame([(i, "s") for i in range(200)], "app_no long, set_key string").coalesce(1)
    selectors = spark.createDataFrame([("s", str(i)) for i in range(5)], "set_key string, service string").coalesce(1)
    got = links_of(members, selectors)
    assert got.columns == ["app_no", "service"]
    assert got.distinct().count() == got.count() == 1000
    assert got.select(F.spark_partition_id()).distinct().count() > 4


def test_names_one_step_apart_meet_at_an_equal_half(spark):
    import random
    from tallyline.functions.similarity import ratio_of
    from tallyline.operators import clustering, placement
    rnd = random.Random(4)
    stems = ["".join(rnd.choice("abc") for _ in range(n)) for n in (52, 53, 60, 98, 99, 100, 101, 130)]
    names = list(dict.fromkeys([*stems, *(t[:i] + c + t[i:] for t in stems for i in (0, 9, 26, 30, len(t)) for c in ("a", "z")),
                                *(t[:-1] for t in stems), *(t[:5] + "zz" + t[5:] for t in stems), "", "z"]))
    table = spark.createDataFrame([("s" if i % 5 else "t", n) for i, n in enumerate(names)], "scope string, name string")
    want = {(a, b) for i, a in enumerate(names) for j, b in enumerate(names)
            if a != b and (i % 5 > 0) == (j % 5 > 0) and ratio_of(a, b) > 0.99}
    got = placement.near_names(table, table, 0.99, "scope").collect()
    assert len(got) == len(want) and {(r["name"], r["other"]) for r in got} == want
    assert all(r["ratio"] == ratio_of(r["name"], r["other"]) for r in got)
    one = clustering.one_step_pairs(table, table, 0.99, "scope").collect()
    assert one and {(r["name"], r["other"]) for r in one} <= want


def test_no_side_of_a_product_passes_the_driver_or_is_repeated_by_mistake(spark):
    from tallyline.operators.common import paired
    left, right = spark.range(5000).withColumnRenamed("id", "a"), spark.range(3).withColumnRenamed("id", "b")
    plan = paired(left, right)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    # Only the short side is repeated for the parts.
    repeated = [line for line in plan.splitlines() if "Generate explode" in line]
    assert len(repeated) == 1 and "[b#" in repeated[0]


@pytest.mark.parametrize("name", ["team_membership_changes", "team_access_gaps", "missing_cloud_services", "cloud_service_gaps", "pipeline_rules",
                                  "deployment_links", "deployment_link_sets", "component_deployments", "stale_tags"])
def test_no_nested_loop_joins(spark, name):
    from workload.registry import queries
    plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def repeats_plainly(text):
    """Line by line with a stack of open items."""
    items, seen, found = [], {}, []
    for number, line in enumerate(text.split("\n"), 1):
        body = line.lstrip()
        indent = len(line) - len(body)
        if body.startswith("- "):
            items = [x for x in items if x[0] < indent] + [(indent, number)]
        elif body and body[0] != "#" and ":" in body[1:] and body[0] != ":":
            key = body.split(":")[0].strip()
            place = (indent, max((n for depth, n in items if depth < indent), default=0), key)
            if place in seen:
                found.append((number, seen[place], key, indent))
            seen.setdefault(place, number)
    return found


def test_repeated_keys_equal_a_walk_over_the_lines(spark):
    import random
    rnd = random.Random(6)
    kinds = ["- a: x", "- b", "key: 1", "key : 2", "other:", "# c: d", ":x", "\ttab: 1", "no colon", "", "  k: v", "-x: 1", " key: 3"]
    texts = ["\n".join(" " * rnd.choice([0, 2, 2, 4, 6]) + rnd.choice(kinds) for _ in range(rnd.randint(0, 25))) for _ in range(300)]
    texts += [texts[0], "", "a: 1\na: 2", "k: v\n" * 3000]
    df = spark.createDataFrame([(i % 290, t) for i, t in enumerate(texts)] + [(1, None)], "doc_id long, text string")
    got = quality.repeated_keys(df).select("doc_id", "line", "first_line", "key", "indent").collect()
    assert sorted(tuple(r) for r in got) == sorted((i % 290, *x) for i, t in enumerate(texts) for x in repeats_plainly(t))
