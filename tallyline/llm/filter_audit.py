"""Operator 13: what each filter of a chain removes, in every order of the chain.

Documents are reduced to cells: one count per part, set of failed filters and label.  A walk over all
subsets of filters in Gray-code order toggles one filter at a time; each cell keeps the number of
active filters it fails, and running sums hold what survives.  The states of all subsets are kept, and
each step of each order is a difference of two of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import spread, stored, text_keys
from .host_rules import _once, words_of

LETTERS = "ABCDE"
MEASURES = ["n", "good", "toxic"]


def text_mask(text: Column) -> Column:
    """Bits of the filters that a text fails by itself: A under 200 words, B under half of its words distinct,
    C over 2 % capital letters, D any of ``#$%&*|``.  A null text is an empty one."""
    def bits(words: Column) -> Column:
        count = F.size(words)
        capitals = F.char_length(whole) - F.char_length(F.regexp_replace(whole, "[A-Z]+", ""))
        fails = [count < 200, 100 * F.size(F.array_distinct(words)) < 50 * count,
                 100 * capitals > 2 * F.char_length(whole), whole.rlike(r"[#$%&*|]")]
        return sum((F.when(fail, 1 << place).otherwise(0) for place, fail in enumerate(fails)), F.lit(0))

    whole = F.coalesce(text, F.lit(""))
    return _once(words_of(whole), bits)


def filter_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents per source and set of failed filters, and how many of them are
    labelled good or toxic.

    Filter E is a text that a smaller ``doc_id`` holds too, anywhere in the table.  Rows of one text are counted
    per part and label before they meet the text's least id, so a text that fills a third of the table is a few
    rows by then.  Texts are told apart by 128 bits.  A null text is empty, a null source is the part ``''``;
    a row without id fails no E and causes none; rows with one id are not copies of each other; a document with
    several label rows has each label that one of them gives.  Further columns are not read, an empty table has no cells.
    """
    k1, k2 = text_keys(F.coalesce("text", F.lit("")))
    rows = (docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), k1.alias("k1"), k2.alias("k2"),
                        text_mask(F.col("text")).alias("mask"))
            .groupBy("doc_id", "part", "k1", "k2", "mask").agg(F.count(F.lit(1)).alias("n")))
    marks = labels.groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("is_good"),
                                         F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("is_toxic"))
    marked = rows.join(spread(marks), "doc_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(False)) for c in ("is_good", "is_toxic")})
    texts = stored(marked.groupBy("k1", "k2", "part", "mask", "is_good", "is_toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("without_id"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first")))
    least = texts.groupBy("k1", "k2").agg(F.min("first.doc_id").alias("least"))
    once = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0) + F.col("without_id")
    split = texts.join(spread(least), ["k1", "k2"]).select("part", "mask", "is_good", "is_toxic", F.explode(F.array(
        F.struct(F.lit(0).alias("e"), once.alias("n")),
        F.struct(F.lit(16).alias("e"), (F.col("n") - once).alias("n")))).alias("x"))
    count = F.col("x.n")
    return split.groupBy("part", (F.col("mask") + F.col("x.e")).alias("mask")).agg(
        F.sum(count).alias("n"), F.sum(F.when(F.col("is_good"), count).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("is_toxic"), count).otherwise(0)).alias("toxic"))


def gray_walk(cells: np.ndarray) -> np.ndarray:
    """Survivors under every subset of filters.  ``cells[..., m]`` counts what fails exactly the filters of mask m;
    the result has the same shape, indexed by the set of active filters.

    Subset after subset differs by one filter, so a step touches the half of the cells that fail it.
    """
    size = cells.shape[-1]
    masks = np.arange(size)
    failing = np.zeros(size, dtype=np.int64)  # active filters that each cell fails
    states = np.empty_like(cells)
    alive = cells.sum(axis=-1)
    active = 0
    states[..., active] = alive
    for step in range(1, size):
        bit = step & -step
        cell = masks[(masks & bit) > 0]
        active ^= bit
        if active & bit:
            failing[cell] += 1
            alive = alive - cells[..., cell[failing[cell] == 1]].sum(axis=-1)
        else:
            failing[cell] -= 1
            alive = alive + cells[..., cell[failing[cell] == 0]].sum(axis=-1)
        states[..., active] = alive
    return states


def subset_states(cells: DataFrame, filters: int = 5) -> DataFrame:
    """part, n, good, toxic: per part one array for each measure, of what survives under each of the 2^filters
    subsets (the index is the subset's bits).  ``cells`` has part, mask and the measures."""
    size = 1 << filters

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held = np.stack([np.stack(batch[m].to_numpy()) for m in MEASURES]) if len(batch) else np.zeros((3, 0, size), np.int64)
            states = gray_walk(held.astype(np.int64))
            yield pd.DataFrame({"part": batch["part"], **{m: list(states[i]) for i, m in enumerate(MEASURES)}})

    by_mask = lambda m: F.array(*[F.sum(F.when(F.col("mask") == i, F.col(m)).otherwise(0)) for i in range(size)])
    wide = cells.groupBy("part").agg(*[by_mask(m).alias(m) for m in MEASURES])
    return wide.mapInPandas(walk, "part string, n array<long>, good array<long>, toxic array<long>")


def order_steps(states: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row per part, order of the filters and step, as differences of states.

    kept, removed, good_lost, toxic_lost: by the step's filter in its place; redundant: fail it too, but left
    earlier; unique_fails: fail nothing else; shapley: removed by the filter, summed over all orders.
    """
    every = (1 << len(letters)) - 1
    steps = []
    for order in permutations(range(len(letters))):
        before = 0
        for step, f in enumerate(order, 1):
            steps.append(("".join(letters[i] for i in order), step, f, 1 << f, before))
            before |= 1 << f
    plan = states.sparkSession.createDataFrame(steps, "filter_order string, step int, f int, bit int, before int")
    at = lambda m, s: F.get(F.col(m), s)
    weights = [factorial(s.bit_count()) * factorial(len(letters) - 1 - s.bit_count()) for s in range(every + 1) if s.bit_count() < len(letters)]

    def shapley(bit: int) -> Column:
        return sum((F.lit(weights[s]) * (at("n", F.lit(s)) - at("n", F.lit(s | bit))) for s in range(every) if not s & bit), F.lit(0).cast("long"))

    withs = states.withColumn("shares", F.array(*[shapley(1 << f) for f in range(len(letters))]))
    # The plan has 600 rows for five filters, whatever the table.
    rows = withs.join(F.broadcast(plan))
    bit = F.col("bit")
    after, others = F.col("before") + bit, F.lit(every) - bit
    gone = lambda m: at(m, F.col("before")) - at(m, after)
    return rows.select(
        "part", "filter_order", "step", at("n", after).alias("kept"), gone("n").alias("removed"),
        (at("n", F.lit(0)) - at("n", bit) - gone("n")).alias("redundant"),
        (at("n", others) - at("n", F.lit(every))).alias("unique_fails"),
        gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), F.get("shares", F.col("f")).alias("shapley"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """All orders of the five filters, per source: see ``filter_cells`` for the documents and ``order_steps`` for the rows."""
    return order_steps(subset_states(filter_cells(docs, labels)))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import documents
    return audit_filters(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
