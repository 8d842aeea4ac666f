"""Every stage of the corpus pipeline on its own input, and the registration of the queries."""

import corpus_pipeline
import __spark_entry__ as entry
from tallyline.llm.common import stored
from tallyline.llm.queries import queries

from .test_operators import brute_fingerprint, brute_groups, brute_removed, packed

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        if number < len(corpus_pipeline.STAGES) - 1:
            out = stored(out)
            assert out.columns == columns and out.dtypes == docs.dtypes
            after = {r["doc_id"]: r for r in out.collect()}
            assert len(after) == out.count() and set(after) <= set(before)
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
            if name == "quality classifier":
                label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
                good = [i for i in before if label.get(i) == 1]
                assert sum(i in after for i in good) / len(good) > 0.97 and len(after) < len(before)
            elif name == "simhash near-dedup":
                prints = [(i, brute_fingerprint(r["text"], 5)) for i, r in before.items()]
                assert set(after) == set(brute_groups(prints, 2))
            elif name == "substring dedup":
                ids = list(before)
                for i, (_, gone, kept) in zip(ids, brute_removed([before[i]["text"] for i in ids], 35)):
                    assert after[i]["text"] == (kept if gone else before[i]["text"])
            else:
                assert set(after) == set(before) and sum(r["n_chars"] for r in after.values()) < sum(r["n_chars"] for r in before.values())
            docs = out
        else:
            rows = out.collect()
            _, per_doc = packed(rows, 2048)
            assert set(per_doc) == set(before)


def test_odd_tables_pass_every_stage(spark):
    rows = [(None, None, None, None, None, 1), (1, "", "en", "s", 0, 2), (1, "", "en", "s", 0, 2), (2, None, "en", "s", 0, None), (3, "text " * 50_000, "en", "s", 1, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars int, _k1 int"
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, table, SF)
            assert out.count() <= max(table.count(), 2) * 100
            if number < 4:
                assert out.columns == table.columns


def test_one_query_per_operator():
    names = sorted(queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert set(queries()) | {"pipeline"} <= set(entry.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "substring dedup", "best-fit packing"]
