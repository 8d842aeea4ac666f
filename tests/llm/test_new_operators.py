"""Whitening, personal data and the filter audit beside brute force."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.llm import filter_audit as fa, personal_data as pd_, whitening as wh
from tallyline.llm.queries import queries

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
EMBEDDING = "vec_id long, embedding array<float>, n string, whitened int, label int"


# ---- 11 whitening

def whitened_plainly(vectors):
    x = np.unique(vectors, axis=0)
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    return n, sums, values[::-1], directions[:, ::-1]


def test_secular_roots_are_eigenvalues():
    rng = np.random.default_rng(4)
    with np.errstate(all="ignore"):
        for _ in range(300):
            k = int(rng.integers(1, 24))
            poles = np.sort(rng.random(k) * 10.0 ** rng.integers(-3, 4))
            weights = rng.random(k) * 10.0 ** rng.integers(-10, 0, k)
            weights /= weights.sum()
            rho = rng.random() * 10.0 ** rng.integers(-3, 4)
            if k > 1 and np.diff(poles).min() < 1e-9:
                continue
            z = np.sqrt(weights)
            want = np.linalg.eigvalsh(np.diag(poles) + rho * np.outer(z, z))
            roots, away = wh.secular_roots(poles, weights, rho)
            assert np.allclose(roots, want, rtol=1e-10, atol=1e-12 * max(poles.max(), rho))
            assert np.allclose(away, poles[:, None] - roots, atol=1e-9 * max(poles.max(), rho))


@pytest.mark.parametrize("cuts", [[], [1, 40], [300, 301, 310], list(range(7, 600, 7))])
def test_spectra_of_parts_combine_to_the_scatter(cuts):
    rng = np.random.default_rng(8)
    x = np.floor(60 * rng.normal(size=(600, 12)) @ np.diag(np.linspace(0.1, 2, 12))).astype(np.int64)
    x[:, 3] = x[:, 2]  # a direction without variance
    x[:, 5] = 7
    whole = wh.Spectrum(12)
    with np.errstate(all="ignore"):
        for part in np.split(x, cuts):
            one = wh.Spectrum(12)
            one.add(part)
            whole.merge(wh.Spectrum.of(one.row(0)))
    centred = x - x.mean(axis=0)
    scatter = centred.T @ centred
    assert np.abs(whole.vectors @ np.diag(whole.values) @ whole.vectors.T - scatter).max() < 1e-10 * scatter.max()
    assert np.abs(whole.vectors.T @ whole.vectors - np.eye(12)).max() < 1e-11
    assert whole.n == 600 and (whole.sums == x.sum(axis=0)).all()


def test_whitening_query_equals_plain_eigenvectors(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    x = {r["vec_id"]: np.floor(256 * np.array(r["embedding"], dtype=float)).astype(np.int64) for r in table.collect()}
    n, sums, values, directions = whitened_plainly(np.stack(list(x.values())))
    rows = queries()["op11_whitening"](spark, SF).collect()
    assert len(rows) == 4 * len(x) and {r["component"] for r in rows} == {1, 2, 3, 4}
    by_component = collections.defaultdict(dict)
    for r in rows:
        by_component[r["component"]][r["vec_id"]] = r
    for c, found in by_component.items():
        plain = {i: float((v - sums / n) @ directions[:, c - 1] / np.sqrt(values[c - 1])) for i, v in x.items()}
        first = next(iter(plain))
        sign = 1 if plain[first] * found[first]["whitened"] > 0 else -1
        for i, r in found.items():
            assert abs(r["whitened"] - sign * plain[i]) < 1e-9
            assert r["n"] == n and r["deviation"] == int(((n * x[i] - sums) ** 2).sum())
            assert abs(r["explained"] - values[c - 1] / values.sum()) < 1e-12 and r["identity_error"] < 1e-10


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, 0.2]), (2, [0.1, 0.2]), (2, [0.1, 0.2]), (None, [-0.5, 0.25]), (3, [0.0, -0.0]), (4, None), (5, []), (6, [nan, 1.0]),
            (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 2.0, 3.0]), (10, [3.0, 2.0])]
    df = spark.createDataFrame([(i, v, "clash", 5, 0) for i, v in rows], EMBEDDING)
    got = wh.whiten(df).collect()
    assert sorted((r["vec_id"] or 0) for r in got) == [0, 1, 2, 2, 3, 10]
    assert {r["n"] for r in got} == {4} and all(len(r["whitened"]) == 2 and r["label"] == 0 for r in got)
    same = {tuple(r["whitened"]) for r in got if r["vec_id"] in (1, 2)}
    assert len(same) == 1 and max(r["identity_error"] for r in got) < 1e-10
    single = wh.whiten(df.filter("vec_id in (1, 2)")).collect()
    assert all(r["whitened"] == [0.0, 0.0] and r["deviation"] == 0 and r["explained"] == [0.0, 0.0] for r in single)
    assert wh.whiten(df.filter("vec_id = 4")).collect() == [] and wh.whiten(df.limit(0)).columns[-5:] == ["n", "deviation", "whitened", "explained", "identity_error"]


def test_deviation_beyond_a_long_is_null():
    model = wh.Whitening(10**6, [10**9] * 2, np.ones(2), np.eye(2))
    assert model.deviation(np.array([[1000, 1000], [10**6, 10**3]])) == [0, None]
    assert model.deviation(np.zeros((0, 2), np.int64)) == []


# ---- 12 personal data

PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def base_plainly(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
            fine = [True, kind != 1 or all(int(p) <= 255 for p in m.group().split(".")), 12 <= len(digits) <= 19 and sum(v - 9 * (v > 9) for v in doubled) % 10 == 0,
                    9 <= len(digits) <= 15][kind]
            if fine:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def test_fixed_patterns_equal_plain_expressions():
    rng = random.Random(5)
    for _ in range(40_000):
        letters = rng.choice(["a@.b-@.", "0123.. -", "+1 ()-.2345", "a1@. +-%é٣", "0000 -1", "255.01"])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert pd_.base_spans(text) == base_plainly(text), text


def test_personal_data_query_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries()["op12_personal_data"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = base_plainly(texts[r["doc_id"]])
        shown = ",".join(f"{pd_.KINDS[k]}:{s}:{e}" for k, s, e in base)
        assert r["base_sha256"] == hashlib.sha256(shown.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pd_.KINDS] == [sum(b[0] == i for b in base) for i in range(4)]
        assert set(filter(None, shown.split(","))) <= set(filter(None, r["spans"].split(",")))


def bootstrapped_plainly(texts, rounds=3, least=3, trusted=0.8, sure=0.7):
    """The graph and its rounds in dictionaries; {(text, kind, start, end)} added."""
    mentions = [(t, m) for t in set(texts) for m in pd_.scan(t)[1]]
    held, seeds, fits = collections.defaultdict(set), collections.defaultdict(set), collections.defaultdict(int)
    for _, (kind, fit, _, _, value, patterns) in mentions:
        for p in patterns:
            held[p].add(value)
        fits[value] |= fit
        if kind is not None:
            seeds[value].add(kind)
    held = {p: v for p, v in held.items() if len(v) > 1}
    scores = {(v, k): 1.0 for v, ks in seeds.items() for k in ks}
    for _ in range(rounds):
        confidence = {}
        for p, values in held.items():
            for k in range(4):
                own = [scores.get((v, k), 0.0) for v in values]
                if sum(s >= trusted for s in own) >= least:
                    confidence[p, k] = sum(own) / (len(values) + 1)
        scores = {(v, k): 1.0 for v, ks in seeds.items() for k in ks}
        miss = collections.defaultdict(lambda: 1.0)
        for (p, k), c in confidence.items():
            for v in held[p]:
                if not seeds.get(v) and fits[v] >> k & 1:
                    miss[v, k] *= 1 - c
        scores |= {x: 1 - m for x, m in miss.items()}
    added = set()
    for t, (kind, _, start, end, value, patterns) in mentions:
        if kind is None:
            kinds = {k for p in patterns for k in range(4) if confidence.get((p, k), 0) >= sure and scores.get((value, k), 0) >= trusted}
            if kinds:
                added.add((t, min(kinds, key=lambda k: (-scores[value, k], k)), start, end))
    return added


def planted_texts():
    texts = [f"please call me under +1 (017) 555-77{i:02d} during office hours" for i in range(8)]
    texts += ["please call me under 017 555 4711 during office hours", "you may ring 017 555 4711 in the evening",
              "the order 017 555 4711 left", f"invoice of 2023 10 11 12 paid"]
    texts += [f"my mail is bob{i}@mail{i}.example.com thank you" for i in range(6)] + ["my mail is eve (at) mail dot example dot org thank you"]
    texts += [f"server 10.0.0.{i} went down again" for i in range(5)] + ["server fe80::1:2:3 went down again", "server 10.0.0.900 went down again"]
    return texts + [None, "", " ", "+1 (017) 555-7700" * 2, "x" * 100_000 + " 4929348385146306"]


def test_contexts_find_identifiers_without_fixed_patterns(spark):
    texts = planted_texts()
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(0, texts[0], "clash")] * 3, "doc_id long, text string, spans string")
    rows = pd_.find_personal_data(df).collect()
    assert len(rows) == len(texts) + 3
    got = {(r["text"], s["kind"], s["start"], s["end"]) for r in rows for s in r["spans"] if s not in r["base_spans"]}
    assert got == bootstrapped_plainly([t for t in texts if t])
    found = {(k, t[s:e]) for t, k, s, e in got}
    assert (3, "017 555 4711") in found and (0, "eve (at) mail dot example dot org") in found and (1, "fe80::1:2:3") in found
    assert not any("order" in t or "invoice" in t for t, *_ in got)
    assert pd_.find_personal_data(df.limit(0)).collect() == []


def test_masking(spark):
    df = spark.createDataFrame([(1, "a x@y.z b 4929348385146306"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["m"] for r in pd_.find_personal_data(df).select("doc_id", pd_.masked("text", "spans").alias("m")).collect()}
    assert got == {1: "a [email] b [card]", 2: None}


# ---- 13 filter audit

def audit_plainly(rows, labels):
    texts = {}
    for i, t, _ in rows:
        if i is not None:
            texts[t or ""] = min(texts.get(t or "", i), i)
    good, toxic = ({i for i, *marks in labels if marks[j] == 1} for j in (0, 1))
    docs = []
    for i, t, source in rows:
        t = t or ""
        w = SPACE.findall(t)
        fails = set()
        if len(w) < 200:
            fails.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t):
            fails.add("C")
        if re.search(r"[#$%&*|]", t):
            fails.add("D")
        if i is not None and texts[t] < i:
            fails.add("E")
        docs.append((source or "", fails, i in good, i in toxic))
    out = {}
    shares = collections.Counter()
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shares[part, f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in d[1] for d in own) - len(gone), sum(d[1] == {f} for d in own),
                                                   sum(d[2] for d in gone), sum(d[3] for d in gone)]
    return {k: tuple(v) + (shares[k[0], k[1][k[2] - 1]],) for k, v in out.items()}


def audited(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = df.collect()
    found = {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in names) for r in rows}
    assert len(found) == len(rows)
    return found


def test_audit_query_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert audited(queries()["op13_filter_audit"](spark, SF)) == audit_plainly(rows, labels)


def test_audit_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, None), (2, "", ""), (3, "a", "s"), (3, "a", "s"), (4, "a", "t"), (None, "a", "s"), (None, None, None), (5, long, "s"), (6, long, None),
            (7, "# " * 300, "s"), (8, "ABC " * 300, "t"), (2, "another text", "s")] + [(9, "hot", "t")] * 50 + [(10 + i, "hot", "t") for i in range(50)]
    labels = [(3, 1, 0), (3, 0, 1), (5, 1, None), (8, None, 1), (None, 1, 1), (99, 1, 1), (10, 1, 1)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, source string, n string, mask string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert audited(fa.audit_filters(df, marks)) == audit_plainly(rows, [x for x in labels if x[0] is not None])
    assert fa.audit_filters(df.limit(0), marks).collect() == []
    assert audited(fa.audit_filters(df, marks.limit(0))) == audit_plainly(rows, [])


def test_gray_walk_counts_every_subset():
    cells = np.random.default_rng(2).integers(0, 50, size=(3, 4, 32))
    states = fa.gray_walk(cells)
    for subset in range(32):
        assert (states[..., subset] == cells[..., [m for m in range(32) if not m & subset]].sum(axis=-1)).all()


# ---- columns named like helpers

CLASHES = ["blocks", "_o", "_1", "_2", "k1", "k2", "spans", "_k1", "_k2", "_ord", "_cut", "_x", "_c", "_host", "_failed", "others", "_new", "score"]


def test_columns_named_like_helpers_keep_their_values(spark):
    import corpus_pipeline
    from tallyline.llm.host_rules import judge
    from tallyline.llm.line_dedup import remove_lines
    from tallyline.llm.quality_classifier import classify
    from tallyline.llm.substring_dedup import remove_repeats
    passage = " ".join(f"word{i}" for i in range(60))
    texts = ["a line of more than thirty characters\n" + passage, "a line of more than thirty characters\nother " + passage, None, "short"]
    rows = [(i, t, "h", 1, *[f"{c}-{i}" for c in CLASHES]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES))
    labels = spark.createDataFrame([(0, 1), (1, 1), (3, 0)], "doc_id long, quality int")
    for name, done in (("lines", remove_lines(df)), ("repeats", remove_repeats(df)), ("classify", classify(df, labels)), ("judge", judge(df))):
        found = done.collect()
        assert len(found) == len(rows)
        for r in found:
            assert all(r[c] == f"{c}-{r['doc_id']}" for c in CLASHES if not (name == "classify" and c == "score")), name
    assert {r["doc_id"]: r["n_deleted"] for r in remove_lines(df).collect()} == {0: 0, 1: 1, 2: 0, 3: 0}
    assert {r["doc_id"]: r["n_removed"] for r in remove_repeats(df).collect()} == {0: 60, 1: 60, 2: 0, 3: 0}
    for stage in (corpus_pipeline.line_dedup, corpus_pipeline.near_dedup, corpus_pipeline.substring_dedup):
        out = stage(spark, df, SF)
        assert out.columns == df.columns
        assert all(r[c] == f"{c}-{r['doc_id']}" for r in out.collect() for c in CLASHES)
