"""Operator 5: quality classifier, a generalised additive model with pairwise interactions.

Features of a text fall into bins.  Shallow trees are boosted in turn over the features, each tree
on one feature's bins, so that a feature ends as one table of additions; then over the most useful
pairs of features, as tables over two coarser bins.  A score is the sum of the tables' entries at
the text's bins, looked up for whole batches.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import free_names, small_batches, without

FEATURES = ["log_words", "word_chars", "distinct_words", "top_word", "upper_share", "symbol_share", "digit_share", "stop_share",
            "bar_share", "repeated_lines", "repeated_triples", "line_words", "shouts", "not_ascii"]
LEFT_OUT = 1  # remainder of the ids that are never learnt from
_SYMBOLS = np.frombuffer(b"#*$%&<>~^@_=+\\", dtype=np.uint8)


def text_features(text: str | None) -> list[float]:
    """Plain counts and shares of the whole text; all 0 for a text without words."""
    data = (text or "").encode("utf-8")
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    triples = list(zip(words, words[1:], words[2:]))
    byte = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    chars = int(byte[33:].sum() - byte[127]) or 1
    return [float(np.log1p(n)), chars / n, len(seen) / n, max(seen.values()) / n, byte[65:91].sum() / chars, byte[_SYMBOLS].sum() / chars,
            byte[48:58].sum() / chars, sum(c for w, c in seen.items() if len(w) <= 3) / n, byte[124] / n, 1 - len(set(lines)) / len(lines),
            1 - len(set(triples)) / len(triples) if triples else 0.0, n / len(lines), (byte[33] + byte[63]) / n, byte[128:].sum() / chars]


@dataclass
class AdditiveModel:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[f], x[:, f], side="right")]
        if self.pairs:
            coarse = np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.pair_edges)], axis=1)
            for (a, b), table in zip(self.pairs, self.pair_tables):
                out += table[coarse[:, a], coarse[:, b]]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def _bins(x: np.ndarray, most: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, f], np.linspace(0, 1, most + 1)[1:-1])) for f in range(x.shape[1])]


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int, damp: float) -> tuple[np.ndarray, float]:
    """A tree over ordered bins: greedy cuts into at most ``leaves`` ranges; its steps per bin and its gain."""
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
    value = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + damp)
    ranges, gain = [(0, len(gradient))], 0.0
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for k, (a, b) in enumerate(ranges):
            if b - a > 1:
                at = np.arange(a + 1, b)
                gains = value(a, at) + value(at, b) - value(a, b)
                i = int(gains.argmax())
                if gains[i] > best[0]:
                    best = (float(gains[i]), k, int(at[i]))
        if best[1] is None:
            break
        a, b = ranges.pop(best[1])
        ranges += [(a, best[2]), (best[2], b)]
        gain += best[0]
    step = np.zeros(len(gradient))
    for a, b in ranges:
        step[a:b] = (g[b] - g[a]) / (h[b] - h[a] + damp)
    return step, gain


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, coarse: int = 8, rounds: int = 150, pairs: int = 6, pair_rounds: int = 60,
        rate: float = 0.1, leaves: int = 3, damp: float = 5.0) -> AdditiveModel:
    """Fit to labels 0/1.  Without rows of both labels the score is the smoothed share of label 1 (0.5 without rows)."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return AdditiveModel(base, [np.zeros(0)] * x.shape[1], [np.zeros(1)] * x.shape[1])
    edges = _bins(x, bins)
    at = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    margin = np.full(len(y), base)
    for _ in range(rounds):
        for f, table in enumerate(tables):
            p = 1 / (1 + np.exp(-margin))
            step, _ = _tree(np.bincount(at[f], y - p, len(table)), np.bincount(at[f], p * (1 - p), len(table)), leaves, damp)
            table += rate * step
            margin += rate * step[at[f]]
    pair_edges = _bins(x, coarse)
    low = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(pair_edges)]

    def cells(a: int, b: int) -> tuple[np.ndarray, tuple[int, int]]:
        shape = (len(pair_edges[a]) + 1, len(pair_edges[b]) + 1)
        return low[a] * shape[1] + low[b], shape

    def pair_step(a: int, b: int) -> tuple[np.ndarray, float]:
        """Two levels: the best cut of ``a``, then each side's best tree over ``b``."""
        cell, shape = cells(a, b)
        p = 1 / (1 + np.exp(-margin))
        g = np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape)
        h = np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape)
        best = (np.zeros(shape), 0.0)
        for cut in range(1, shape[0]):
            upper, gain_u = _tree(g[:cut].sum(axis=0), h[:cut].sum(axis=0), 2, damp)
            lower, gain_l = _tree(g[cut:].sum(axis=0), h[cut:].sum(axis=0), 2, damp)
            if gain_u + gain_l > best[1]:
                best = (np.vstack([np.tile(upper, (cut, 1)), np.tile(lower, (shape[0] - cut, 1))]), gain_u + gain_l)
        return best

    n = x.shape[1]
    ranked = sorted(((pair_step(a, b)[1], a, b) for a in range(n) for b in range(a + 1, n)), reverse=True)
    chosen = [(a, b) for gain, a, b in ranked[:pairs] if gain > 0]
    pair_tables = [np.zeros(cells(a, b)[1]) for a, b in chosen]
    for _ in range(pair_rounds):
        for (a, b), table in zip(chosen, pair_tables):
            step, _ = pair_step(a, b)
            table += rate * step
            margin += rate * step[low[a], low[b]]
    return AdditiveModel(base, edges, tables, chosen, pair_edges, pair_tables)


def held_out(id_col: str = "doc_id") -> Column:
    """Ids that are not learnt from: crc32 of the id as text, modulo 3, is 1; false without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == LEFT_OUT, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality") -> DataFrame:
    """``docs`` with held_out, score (0 to 1) and predicted (1 from 0.5).

    The model is fitted on the driver to at most ``sample_rows`` labelled documents (documented bound:
    14 numbers each), the ones with the least hash of their id, none of them held out.  The features of
    every whole text are computed once; no other column reaches them.  Of several labels of one id the
    mean, rounded, counts; null labels and labels of absent documents do not.  Null and empty texts are
    scored like any other, by features that are 0; repeated rows get equal scores.
    """
    spark = docs.sparkSession
    small_batches(spark)
    clean = without(docs, "held_out", "score", "predicted")

    @F.pandas_udf("array<double>")
    def features(texts):
        import pandas as pd
        return pd.Series([text_features(t) for t in texts])

    known = (labels.filter(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id"))
             .agg(F.round(F.avg(label_col)).alias("_y")).filter(~held_out("_id")))
    [numbers] = free_names(clean, "_x")
    marked = clean.withColumn(numbers, features(F.col(text_col)))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    learnt = clean.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")
    # Of documents with one id one is learnt, so at most ``sample_rows`` rows are collected.
    rows = learnt.select("_id", "_y", features("_text").alias("x")).groupBy("_id", "_y").agg(F.min("x").alias("x")).orderBy("_id").collect()
    x = np.array([r["x"] for r in rows], dtype=np.float64).reshape(len(rows), len(FEATURES))
    model = fit(x, np.array([r["_y"] for r in rows], dtype=np.float64))

    @F.pandas_udf("double")
    def score(rows):
        import pandas as pd
        return pd.Series(model.scores(np.stack(rows.tolist())) if len(rows) else [], dtype="float64")

    scored = marked.withColumn("score", score(numbers)).drop(numbers)
    return scored.select("*", held_out(id_col).alias("held_out"), F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import documents
    scored = classify(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", "held_out", "score", "predicted")
