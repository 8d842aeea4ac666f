"""Operator 3: token ids as ORC files in document order.

Integers of ``tokens`` are run-length encoded by ORC inside stripes; a row index and a Bloom
filter on ``doc_id`` let a reader skip stripes and row groups, and stripes are read in parallel.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from .chunks import library_encoder
from .common import new_folder, shuffle_partitions, small_batches

SCHEMA = "doc_id long, file_start long, n_tokens long, tokens array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id",
                 text_col: str = "text", stripe_mb: int = 16, index_rows: int = 1000) -> None:
    """Encode every text, append ``end_id`` and write ORC files in ascending id order.

    Each file holds one range of ids, sorted; file names ascend with the ranges.  ``file_start`` is
    the number of ids before the document in its file.  A null text is empty (only the end id), a
    document without id comes first, documents sharing an id stand in the order of their texts.
    An empty table gives a folder without rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ordered = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
               .repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text"))
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, start = library_encoder(tokenizer), 0
        for batch in batches:
            ids = [v + end for v in encoder.encode(batch.column("text").to_pylist())]
            sizes = np.fromiter((len(v) // 4 for v in ids), dtype=np.int64, count=len(ids))
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            flat = pa.array(np.frombuffer(b"".join(ids), dtype="<i4"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(start + bounds[:-1]), pa.array(sizes),
                 pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), flat)],
                ["doc_id", "file_start", "n_tokens", "tokens"])
            start += int(bounds[-1])

    (ordered.mapInArrow(encode, SCHEMA).write.option("compression", "zstd").option("orc.stripe.size", stripe_mb << 20)
     .option("orc.row.index.stride", index_rows).option("orc.bloom.filter.columns", "doc_id")
     .option("orc.bloom.filter.fpp", 0.01).mode("error").orc(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, tokens of what ``write_tokens`` wrote.

    The table of files that is joined has one row per file, as many as the writer had partitions.
    """
    files = spark.read.schema(SCHEMA).orc(path).select("*", F.col("_metadata.file_name").alias("_file"))
    sums = files.groupBy("_file").agg(F.sum("n_tokens").alias("_ids")).collect()  # a row per file
    base, before = [], 0
    for row in sorted(sums, key=lambda r: r["_file"]):
        base.append((row["_file"], before))
        before += row["_ids"]
    starts = spark.createDataFrame(base, "_file string, _base long")
    return files.join(F.broadcast(starts), "_file").select(
        "doc_id", (F.col("_base") + F.col("file_start")).alias("start"), "n_tokens", "tokens")


def find_tokens(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The stored rows of some documents; the filter reaches the ORC reader, which skips by index and Bloom filter."""
    return spark.read.schema(SCHEMA).orc(path).filter(F.col("doc_id").isin(ids))


@pandas_udf(LongType())
def ids_crc32(tokens):
    return tokens.map(lambda t: zlib.crc32(np.asarray(t, dtype="<u4").tobytes()))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .queries import documents, tokenizer
    path = new_folder(spark)
    write_tokens(documents(spark, sf_dir), path, tokenizer("word_bpe_49k.json"), end_id=2)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", ids_crc32("tokens").alias("ids_crc32"))
