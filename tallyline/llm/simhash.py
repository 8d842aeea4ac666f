"""Operator 1: SimHash near-duplicates by covering locality-sensitive hashing.

Bit i of a fingerprint carries a vector m(i) of radius + 1 bits that is not zero; table v keeps the
bits with <m(i), v> odd.  The vectors of at most ``radius`` differing bits leave some v other than
zero orthogonal to all of them, so a pair within the radius has equal bits in table v: no pair is missed.

Inside a bucket no pairs are listed.  Two fingerprints differ in at most 2r bits exactly if some word
lies within r bits of both, so members of a bucket send the words within r bits of themselves (only
bits the table does not keep can differ), and a word gathers at most as many distinct fingerprints as
a ball holds (65 for radius 2), whatever the size of a group of copies.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf

from .common import LAST, components, small_batches, spread, stored, text_keys

BITS = 64
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
ROWS = 1 << 14  # hashes whose bits are spread at once


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Hashes of all shingles of ``words`` words of the whole text, repeats included; none without a word."""
    import xxhash
    # bytes.split cuts at exactly the six ASCII white-space characters.
    tokens = (text or "").encode("utf-8").translate(LOWER).split()
    if not tokens:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    width = min(words, len(tokens))
    stops = ends[width - 1:].tolist()
    starts = [0, *(ends[:len(tokens) - width] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops)), dtype="<u8", count=len(stops))


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have; 0 without any."""
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), ROWS):
        part = hashes[at:at + ROWS].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def text_fingerprint(text: str | None, words: int) -> int:
    """SimHash of all shingles of ``words`` words of the whole text, repeats included; 0 without a word."""
    return majority(shingle_hashes(text, words))


def fingerprint(text: Column, words: int) -> Column:
    @pandas_udf("long")
    def of(texts):
        import pandas as pd
        return pd.Series([text_fingerprint(t, words) for t in texts], dtype="int64")
    return of(text)


def covering_masks(radius: int) -> list[int]:
    """The 2^(radius+1) - 1 bit masks; bit i carries the vector 1 + i mod (2^(radius+1) - 1)."""
    tables = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(BITS) if ((1 + i % tables) & v).bit_count() % 2) for v in range(1, tables + 1)]


def _signed(word: int) -> int:
    return word - 2**64 if word >= 2**63 else word


def near_links(prints: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) that connect the distinct ``prints`` (fp long) exactly as all pairs within ``radius`` (even) do."""
    if radius % 2:
        raise ValueError("the radius must be even")
    masks = covering_masks(radius)
    tables = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)])
    rows = prints.select("fp", F.explode(tables).alias("t")).select("fp", "t.k", "t.key")
    shared = rows.groupBy("k", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    members = rows.join(spread(shared), ["k", "key"])
    changes = []
    for m in masks:
        free = [1 << i for i in range(BITS) if not m >> i & 1]
        changes.append([0, *[_signed(sum(c)) for r in range(1, radius // 2 + 1) for c in combinations(free, r)]])
    near = F.element_at(F.lit(changes) if len(changes) == 1 else F.array(*[F.lit(c) for c in changes]), F.col("k") + 1)
    balls = members.select("fp", F.explode(near).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("word")).distinct()
    # A word is within radius / 2 bits of at most this many fingerprints.
    most = sum(comb(BITS, r) for r in range(radius // 2 + 1))
    gathered = balls.groupBy("word").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps").between(2, most))
    return gathered.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).filter("a <> b").distinct()


def near_groups(docs: DataFrame, words: int = 5, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (long), component_id: fingerprints linked at ``radius`` or fewer differing bits, all reachable together.

    ``component_id`` is the least id of the component; rows without id belong to their component but do
    not name it (null if none has an id).  Texts without a word have fingerprint 0 and are linked like
    any other.  Repeated rows stay, one result each.  Work is done on distinct fingerprints.
    """
    small_batches(docs.sparkSession)
    keyed = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprint(F.col(text_col), words).alias("fp")))
    prints = stored(keyed.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    rooted = prints.join(print_roots(prints.select("fp"), radius), "fp")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_print = rooted.join(spread(least), "root").select("fp", "component_id")
    return keyed.join(of_print, "fp").select("doc_id", "fp", "component_id")


def print_roots(prints: DataFrame, radius: int) -> DataFrame:
    """fp, root: the component of each of the distinct ``prints``, named by one of its fingerprints."""
    grouped = components(near_links(prints, radius)).withColumnRenamed("node", "fp")
    return prints.join(grouped, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def row_keys() -> list[Column]:
    """The id (absent ones last) and the two hashes of the text: what tells documents with one id apart."""
    one, two = text_keys(F.coalesce(F.col("text"), F.lit("")))
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord"), one.alias("k1"), two.alias("k2")]


def keep_one(docs: DataFrame, roots: DataFrame) -> DataFrame:
    """``docs`` with one row of each component, given by ``roots`` (ord, k1, k2 of the row, root)."""
    chosen = roots.groupBy("root").agg(F.min(F.struct("ord", "k1", "k2")).alias("c")).select(
        F.col("c.ord").alias("_near_o"), F.col("c.k1").alias("_near_1"), F.col("c.k2").alias("_near_2"))
    names = chosen.columns
    marked = docs.withColumns(dict(zip(names, row_keys())))
    # Each component chose one id and text, so what is left of it are repeated rows of that document.
    return marked.join(chosen, names, "left_semi").dropDuplicates(names).select(docs.columns)


def drop_near_copies(docs: DataFrame, words: int = 5, radius: int = 2, per_id: bool = True) -> DataFrame:
    """``docs`` with one row of each group: of the rows with the group's least id, the one with the least text hash.

    Rows without id stay only where their whole group has none, and then one of them stays.  ``per_id``
    takes rows with one id for repeated rows and keeps one of them; without it, texts of one id in
    different groups are different documents.
    """
    small_batches(docs.sparkSession)
    keyed = stored(docs.select(*row_keys(), fingerprint(F.col("text"), words).alias("fp")))
    roots = print_roots(stored(keyed.select("fp").distinct()), radius)
    kept = keep_one(docs, keyed.join(roots, "fp"))
    if not per_id:
        return kept
    return kept.filter("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.filter("doc_id is null"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import documents
    groups = near_groups(documents(spark, sf_dir), words=3, radius=2)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
