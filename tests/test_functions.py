"""Literal edge rows of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from tallyline.functions import integrations, naming, network, people, repositories, scales, similarity, tags, text


def values(spark, column, rows, name="x", ddl="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {name} {ddl}")
    return [r["y"] for r in df.select("i", column.alias("y")).orderBy("i").collect()]


def test_criticality_tables(spark):
    tiers = [None, 0, 1, 4, 5, 6, 10, 11]
    assert values(spark, scales.criticality("x"), tiers, ddl="int") == [5, 5, 10, 7, 6, 5, 1, 5]
    assert values(spark, scales.criticality("x", "short"), tiers, ddl="int") == [5, 10, 9, 6, 5, 5, 5, 5]


def test_label_tag_splits(spark):
    got = values(spark, tags.label_tag("x"), ["RiskFactor:a:b:c", "RiskFactor:a", "x:", ":y", "plain", "k : v:w ", None])
    assert [None if g is None else (g["key"], g["value"]) for g in got] == [
        ("RiskFactor:a:b", "c"), ("RiskFactor", "a"), ("x", ""), ("", "y"), (None, "plain"), ("k", "v:w"), None]


@pytest.mark.parametrize("mode,expected", [
    ("values", ["=a:b", "=x:", "=plain", "=null"]), ("first_colon", ["a=b", "x=", "=plain"]),
    ("strict_pairs", ["a=b", "=plain"]), ("first_two_parts", ["a=b", "x="])])
def test_rule_tags(spark, mode, expected):
    got = values(spark, tags.tags_text(tags.rule_tags("x", mode)), [["a:b", "x:", "plain", "null"]], ddl="array<string>")
    assert got[0].split("|") == expected


def test_strict_pairs_with_nothing_left_is_null(spark):
    assert values(spark, tags.rule_tags("x", "strict_pairs"), [[":y", "x:"]], ddl="array<string>") == [None]


def test_networks(spark):
    got = values(spark, network.network24("x"), ["10.22.3.44", "999.1.1.1", "10.1.1.07", "text", None, "10.0.0.0/8", "1.2.3.4\n", "0.0.0.0"])
    assert got == ["10.22.3.0/24", None, None, None, None, None, None, "0.0.0.0/24"]
    assert values(spark, network.cidr_list("x"), [" 1.2.3.4, ,5.0.0.0/8 "]) == [["1.2.3.4/32", "5.0.0.0/8"]]


def test_paths_and_images(spark):
    assert values(spark, repositories.last_two_parts("x"), ["a/b/c", " a/b ", "solo ", "", "/x"]) == ["b/c", "a/b", "solo ", "", "/x"]
    assert values(spark, repositories.clean_repositories("x"), [["a/b/c", " ", "NULL", "ab", None], None], ddl="array<string>") == [["b/c"], []]
    p = values(spark, repositories.image_parts("x"), ["reg.io:5000/team/app:1.2", "reg.io/team/app:1"])
    assert (p[0]["registry"], p[0]["image_name"], p[0]["container_url"]) == ("reg.io:5000", "reg.io", "reg.io")
    assert (p[1]["registry"], p[1]["image_name"], p[1]["container_url"]) == ("reg.io", "app", "reg.io/team/app")


def test_people(spark):
    n = values(spark, people.address_to_names("x"), ["ann.lee@x.org", "bob@x.org", "nobody", "a.b.c@x"])
    assert [(r["first_name"], r["last_name"]) for r in n] == [("ann", "lee"), ("bob", "bob"), (None, None), ("a", "b")]
    assert values(spark, people.name_to_address("x", "x.org"), [" Ann  Lee "]) == ["ann..lee@x.org"]
    assert values(spark, people.strip_user_suffix("x"), ["Ann User", "User", "Ann User "]) == ["Ann", "User", "Ann User "]
    f = values(spark, people.full_names("x"), ["Ann van Lee", "Ann", None])
    assert (f[0]["first_name"], f[0]["last_name"]) == ("Ann", "van Lee") and f[1:] == [None, None]


def test_first_present_keeps_null(spark):
    m = F.from_json("x", "map<string,string>")
    assert values(spark, text.first_present(m, "a", "b"), ['{"a":null,"b":"2"}', '{"b":"2"}', "{}"]) == [None, "2", None]


def test_validity(spark):
    assert values(spark, F.coalesce(text.is_valid("x"), F.lit(False)), [None, " ", "NULL", "x"]) == [False, False, False, True]


def test_rule_names(spark):
    rows = [["a", "b", "c"], ["x" * 60]]
    got = values(spark, naming.rule_name(F.lit("comp"), F.lit("osNames"), "x"), rows, ddl="array<string>")
    assert got[0] == "R-OS for comp (a, b +1)" and got[1] == "R-OS for comp (" + "x" * 47 + "...)"
    assert values(spark, naming.list_literal("x"), [["a", "it's"]], ddl="array<string>") == ["['a', \"it's\"]"]


def test_integration_needs_target_and_name(spark):
    ddl = "array<struct<TIntegrationName:string,MIntegrationName:string,IntegrationName:string,Backlog:string,Channel:string>>"
    rows = [[("j", None, None, "b", None)], [(None, None, "old", "b", None)], [("j", None, None, None, None)], [], None]
    assert [v is not None for v in values(spark, integrations.loaded("x", "ticketing"), rows, ddl=ddl)] == [True, True, False, False, False]
    assert [v is not None for v in values(spark, integrations.target_of("x", "ticketing"), rows, ddl=ddl)] == [True, False, False, False, False]


def test_similarity_matches_plain_table():
    import random
    rnd = random.Random(3)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = 0
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    for _ in range(300):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 12))) for _ in range(2))
        assert similarity.lcs_length(a, b) == lcs(a, b)
    assert similarity.ratio_of("", "") == 1.0 and similarity.ratio_of("", "a") == 0.0
