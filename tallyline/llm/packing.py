"""Operator 7: pack token pieces into sequences by vector best-fit.

A piece asks for a vector (its tokens, one document, tokens squared of attention) and a sequence
offers a capacity for each.  The vector depends on the length alone, so pieces of one length are
interchangeable: the plan is made for counts per length, at most one row per possible length,
whatever the corpus.  Sequences with the same filling are planned as one group with a count.
Pieces then take the planned places by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .chunks import library_encoder
from .common import shuffle_partitions, small_batches, stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def plan(counts: dict[int, int], tokens: int, documents: int | None = None, attention: int | None = None,
         weights: tuple[float, float, float] = (1.0, 0.0, 0.0), score: str = "norm") -> list[tuple[list[int], int]]:
    """Fillings and how many sequences take each, for ``counts`` pieces per length.

    Longest pieces first; each goes to the open sequence that fits it under every capacity and is
    best by ``score``: the least weighted norm of what would be left ("norm") or the greatest weighted
    product of request and rest ("dot"), rests as shares of the capacities; a new sequence is opened
    where none fits.  ``documents`` and ``attention`` default to no limit below that of ``tokens``.
    """
    room = np.array([tokens, documents or tokens, attention or tokens * tokens], dtype=np.float64)
    weight = np.array(weights, dtype=np.float64)
    rest = np.empty((1024, 3))
    free = np.zeros(1024, dtype=np.int64)  # sequences in the group
    filling: list[tuple | None] = []  # (filling before, length)

    def add(left: np.ndarray, number: int, before: tuple | None, length: int) -> None:
        nonlocal rest, free
        if len(filling) == len(rest):
            rest, free = np.vstack([rest, np.empty_like(rest)]), np.concatenate([free, np.zeros_like(free)])
        rest[len(filling)], free[len(filling)] = left, number
        filling.append((before, length))

    for length in sorted(counts, reverse=True):
        ask = np.array([length, 1, length * length], dtype=np.float64)
        if (ask > room).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        todo = counts[length]
        while todo:
            n = len(filling)
            fits = np.flatnonzero((free[:n] > 0) & (rest[:n] >= ask).all(axis=1))
            if len(fits):
                share = rest[fits] / room
                if score == "norm":
                    best = fits[np.argmin(((share - ask / room) ** 2 * weight).sum(axis=1))]
                else:
                    best = fits[np.argmax((share * (ask / room) * weight).sum(axis=1))]
                take = min(todo, int(free[best]))
                free[best] -= take
                add(rest[best] - ask, take, filling[best], length)
                todo -= take
            else:
                # Alone in a new sequence, the pieces of this length that follow fill it up.
                each = int(min(room // ask))
                for size, number in ((each, todo // each), (todo % each, 1)):
                    if size and number:
                        chain = None
                        for _ in range(size - 1):
                            chain = (chain, length)
                        add(room - size * ask, number, chain, length)
                todo = 0
    out = []
    for k in np.flatnonzero(free[:len(filling)]):
        lengths, chain = [], filling[k]
        while chain is not None:
            chain, one = chain
            lengths.append(one)
        out.append((lengths[::-1], int(free[k])))
    return out


def places(groups: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first sequence, offset): ranks of that length that take this place of a group."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, number in groups:
        offset = 0
        for length in lengths:
            at = used.get(length, 0)
            runs.setdefault(length, []).append((at, sequence, offset))
            used[length] = at + number
            offset += length
        sequence += number
    return {length: np.array(r, dtype=np.int64) for length, r in runs.items()}


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, tokens: int, id_col: str = "doc_id",
               text_col: str = "text", keep_tokens: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and tokens): texts as ids with ``end_id``, cut only above ``tokens``.

    Of a long document the first piece takes what full pieces leave over.  A null text is empty.
    """
    small_batches(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            kept: list[np.ndarray] = []
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                ids += end
                size = len(ids) // 4
                at, piece = 0, 0
                while at < size:
                    long = (size - at) % tokens or tokens
                    part = ids[4 * at:4 * (at + long)]
                    rows.append((doc, piece, at, long, zlib.crc32(part)))
                    if keep_tokens:
                        kept.append(np.frombuffer(part, dtype="<i4"))
                    at, piece = at + long, piece + 1
            columns = list(zip(*rows)) or [()] * 5
            arrays = [pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_tokens:
                arrays, names = [*arrays, pa.array(kept, type=pa.list_(pa.int32()))], [*names, "tokens"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(encode, PIECES + (", tokens array<int>" if keep_tokens else ""))


def pack(pieces: DataFrame, tokens: int, documents: int | None = None, attention: int | None = None,
         weights: tuple[float, float, float] = (1.0, 0.0, 0.0), score: str = "norm") -> DataFrame:
    """``pieces`` (doc_id, piece, length and more) with ``sequence_id`` and ``offset``.

    The driver gets one count per length, at most ``tokens`` rows.  A piece's rank among those of its
    length comes from counts per (length, salt) and its place within its salt, so that a length with
    most rows is spread.  Repeated rows and rows without id take places of their own.
    """
    pieces = stored(pieces)
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = places(plan(counts, tokens, documents, attention, weights, score))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shuffle_partitions(spark))))
    sizes = salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")
    ranked = (salted.withColumn("_at", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")))
              .join(sizes.select("length", "_salt", before.alias("_before")), ["length", "_salt"])
              .withColumn("_rank", F.col("_before") + F.col("_at") - 1).select(*pieces.columns, "_rank"))
    schema = ranked.drop("_rank").schema.add("sequence_id", "long").add("offset", "long")
    shared = spark.sparkContext.broadcast(runs)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        for batch in batches:
            lengths, ranks = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.empty(len(ranks), dtype=np.int64), np.empty(len(ranks), dtype=np.int64)
            for length in np.unique(lengths):
                rows, run = np.flatnonzero(lengths == length), runs[int(length)]
                k = np.searchsorted(run[:, 0], ranks[rows], side="right") - 1
                sequence[rows] = run[k, 1] + ranks[rows] - run[k, 0]
                offset[rows] = run[k, 2]
            names = [n for n in batch.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(sequence), pa.array(offset)],
                                             [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, tokens: int = 2048, **options) -> DataFrame:
    """Documents as packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(cut_pieces(docs, tokenizer, end_id, tokens), tokens, **options)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import documents, tokenizer
    return pack_documents(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))
