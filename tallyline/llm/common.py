"""Helpers shared by the operators: stored tables, ordered ranges, connected components, text keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir

LAST = 2**63 - 1  # order of a document without id: after all others


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns an operator is about to add (a clashing input column gives way)."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of ``df`` has, for helper columns that stand beside a caller's columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def new_folder(spark: SparkSession) -> str:
    """A fresh place below the shared checkpoint folder that the cluster names."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, any executor may be lost."""
    path = new_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Rows per Arrow batch, so that a batch of long texts fits a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_keys(text: Column) -> list[Column]:
    """Two 64-bit hashes of a whole text, which together name its content."""
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def cut_points(df: DataFrame, column: str, pieces: int) -> list[int]:
    """Values present in ``column`` that cut it into about equal ranges; at most ``pieces`` of them reach the driver."""
    shares = [i / pieces for i in range(1, pieces)]
    row = df.select(F.percentile_approx(column, shares, 20 * pieces).alias("c")).first() if shares else None
    return sorted(set((row and row["c"]) or []))


def range_of(value: Column, cuts: list[int]) -> Column:
    """Number of cuts not above the value, by halving; a null value comes last."""
    if not cuts:
        return F.lit(0)
    table = F.lit(cuts)

    def halve(state: Column, _step: Column) -> Column:
        mid = F.shiftright(state["lo"] + state["hi"], 1)
        wide = state["lo"] < state["hi"]
        above = value >= F.get(table, mid)
        return F.struct(F.when(wide & above, mid + 1).otherwise(state["lo"]).alias("lo"),
                        F.when(wide & ~above, mid).otherwise(state["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length())), start, halve, lambda s: s["lo"])
    return F.when(value.isNull(), F.lit(len(cuts))).otherwise(found)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """A grouped table dealt out anew, so that a join on its key shuffles both sides itself and Spark can
    split the hot keys of the other side."""
    return df.repartition(shuffle_partitions(df.sparkSession))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges`` (a, b long): one row (node, root) per node of an edge,
    ``root`` its component's least node.

    Large-star and small-star steps in turn: each node's neighbours are joined to its least
    neighbour, which keeps components, needs about log(n) rounds and never gathers a component.
    Every round is written to the shared folder and the round before it deleted.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(spread(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(spread(least), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stored(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        forget(now)
        now = after
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
