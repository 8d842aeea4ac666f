"""Operator 6: homomorphic multiset fingerprints of documents, in DataFrame functions only.

A text is the multiset of its paragraphs, long ones cut at the ends of their clauses.  Each part is
hashed to a vector of 256 lanes of -1 or +1, and the fingerprint is the sum of the vectors, every
lane modulo 2^16.  Sums do not depend on order, a part is inserted or deleted by adding or
subtracting its vector, and equal multisets have equal sums.  Unrelated vectors are nearly
orthogonal, so the product of two sums estimates what the texts share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import cut_points, range_of, shuffle_partitions

HASHES = 4  # 64 lanes each
LANES = 64 * HASHES
WORDS = [f"w{i}" for i in range(32 * HASHES)]  # two lanes in each long, 32 bits apart
LOW = 0x0000000100000001
MODULUS = 1 << 16


def parts(text: Column) -> Column:
    """Paragraphs (lines), each cut after clause ends and bars that white space follows; empty parts stay out."""
    return F.filter(F.split(text, r"\n|(?<=[.,;:!?|])[ \t]"), lambda p: p != "")


def lane_sums(part: Column) -> list[Column]:
    """Aggregates over parts: how often each lane is +1.  Counts of a text stay below 2^31, so no field runs over."""
    out = []
    for h in range(HASHES):
        digest = F.xxhash64(F.lit(h), part)
        out += [F.sum(F.shiftrightunsigned(digest, i).bitwiseAND(F.lit(LOW))).alias(WORDS[32 * h + i]) for i in range(32)]
    return out


def lanes(words: Column, count: Column) -> Column:
    """The 256 sums of -1 and +1, modulo 2^16, of packed counts and the number of parts."""
    one = lambda c: F.pmod(2 * c - count, F.lit(MODULUS))
    return F.flatten(F.transform(words, lambda w: F.array(one(w.bitwiseAND(F.lit(0xFFFFFFFF))), one(F.shiftrightunsigned(w, 32)))))


def _centred(lane: Column) -> Column:
    return F.when(lane >= MODULUS // 2, lane - MODULUS).otherwise(lane).cast("double")


def likeness(a: Column, b: Column) -> Column:
    """Share of common parts, estimated from two vectors: 2ab / (aa + bb), cut to 0..1; equal vectors give 1."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    both = total(F.zip_with(a, b, lambda x, y: _centred(x) * _centred(y)))
    each = total(F.transform(a, lambda x: _centred(x) * _centred(x))) + total(F.transform(b, lambda x: _centred(x) * _centred(x)))
    return F.when(a == b, 1.0).when(each == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * both / each)))


def as_text(vector: Column) -> Column:
    """Four hexadecimal digits a lane."""
    return F.lower(F.array_join(F.transform(vector, lambda x: F.lpad(F.hex(x), 4, "0")), ""))


def changed(vector: Column, other: Column, sign: int = 1) -> Column:
    """The vector with another one's parts inserted (1) or deleted (-1)."""
    return F.zip_with(vector, other, lambda x, y: F.pmod(x + sign * y, F.lit(MODULUS)))


def vectors(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, vector: one per row of ``texts``, whose ``keys`` must tell rows apart.

    Each text is summed where it is read; if the rows lie partitioned by some of the keys, no shuffle follows.
    """
    each = texts.select(*keys, F.explode_outer(parts(F.col(text_col))).alias("part"))
    sums = each.groupBy(*keys).agg(F.count("part").alias("n"), *lane_sums(F.col("part")))
    return sums.select(*keys, lanes(_packed(), F.col("n")).alias("vector"))


def _packed() -> Column:
    return F.array(*[F.when(F.col("n") > 0, F.col(w)).otherwise(F.lit(0)) for w in WORDS])


def with_next_text(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``piece`` (a range of ids), ``place`` in it, ``guest`` and ``next_text``, the text of the next id.

    Ranges are cut at ids that occur; the rows of such an id stand a second time at the end of the
    range before (``guest`` above 0), so that every range knows its last successor without any other
    range.  After the last document comes the first.  Rows of one id stand in the order of their texts, rows without id
    at the end.
    """
    pieces = 4 * shuffle_partitions(docs.sparkSession)
    cuts = cut_points(docs, "doc_id", pieces)
    least = docs.agg(F.min("doc_id")).first()[0]
    last = len(cuts)
    own = range_of(F.col("doc_id"), cuts)
    # Rows of the least id close the circle behind the last range.
    wrap = F.col("doc_id").eqNullSafe(F.lit(least).cast("long"))
    at = [F.struct(own.alias("piece"), F.lit(0).alias("guest"))]
    guests = F.array(*at,
                     F.when((own > 0) & (F.get(F.lit(cuts or [None]).cast("array<long>"), own - 1) == F.col("doc_id")),
                            F.struct((own - 1).alias("piece"), F.lit(1).alias("guest"))),
                     F.when(wrap, F.struct(F.lit(last).alias("piece"), F.lit(2).alias("guest"))))
    placed = docs.withColumn("_at", F.explode(F.filter(guests, lambda g: g.isNotNull()))).select("doc_id", "text", "_at.piece", "_at.guest")
    order = Window.partitionBy("piece").orderBy("guest", F.col("doc_id").asc_nulls_last(), "text")
    return placed.withColumns({"place": F.row_number().over(order), "next_text": F.lead("text").over(order)})


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256 and the vectors of the text, of its edited text and of the next document's text.

    Edited: the last quarter of the characters (rounded down) replaced by as many first ones of the next
    document.  A null text is empty and has the zero vector; a single document is its own successor;
    repeated rows are documents of their own; further columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = F.char_length("text")
    quarter = F.floor(size / 4).cast("int")
    head = F.substring(F.col("text"), F.lit(1), size - quarter)
    edited = F.concat(head, F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), quarter))
    paired = with_next_text(base).select("piece", "place", "guest", "doc_id", size.cast("long").alias("n_chars"), "text", edited.alias("edited"),
                                         # Parts that end before the edit stand in both texts.
                                         F.greatest(F.size(parts(head)) - 1, F.lit(0)).alias("common"))
    keys = ["piece", "place", "guest", "doc_id", "n_chars", "edited_sha256"]
    tagged = F.concat(
        F.transform(parts(F.col("text")), lambda p, i: F.struct(F.when(i < F.col("common"), 0).otherwise(1).alias("kind"), p.alias("part"))),
        F.transform(F.filter(parts(F.col("edited")), lambda p, i: i >= F.col("common")), lambda p: F.struct(F.lit(2).alias("kind"), p.alias("part"))))
    each = (paired.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
            .select(*keys, F.explode_outer(tagged).alias("t")).select(*keys, "t.*"))
    # The edited vector is the text's with the parts of its tail deleted and those of the new tail inserted.
    sums = each.groupBy(*keys, "kind").agg(F.count("part").alias("n"), *lane_sums(F.col("part")))
    kinds = sums.select(*keys, "kind", lanes(_packed(), F.col("n")).alias("v")).groupBy(*keys).agg(
        *[F.coalesce(F.max(F.when(F.col("kind") == k, F.col("v"))), F.lit([0] * LANES).cast("array<long>")).alias(f"v{k}") for k in range(3)])
    own = kinds.select(*keys, changed(F.col("v0"), F.col("v1")).alias("vector"), changed(F.col("v0"), F.col("v2")).alias("edited_vector"))
    order = Window.partitionBy("piece").orderBy("place")
    return (own.withColumn("next_vector", F.lead("vector").over(order)).filter("guest = 0")
            .select("doc_id", "n_chars", "edited_sha256", "vector", "edited_vector", "next_vector"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import documents
    found = fingerprints(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("vector")).alias("fingerprint"), as_text(F.col("edited_vector")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"), likeness(F.col("vector"), F.col("next_vector")).alias("near_next"))
