"""Shared relational building blocks: keyed reduction, diffs, products by parts, row positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def fold_case(name: str) -> Column:
    return F.lower(F.col(name))


def last_by_pos(df: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """One row per key: the one with the greatest position.  A partial aggregate, safe for hot keys."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(pos)).alias("_r"))
    return picked.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def first_by_pos(df: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """One row per key: the one with the smallest position."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(pos)).alias("_r"))
    return picked.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group.

    Spark keeps only ``k`` rows per group on the map side before it shuffles
    (WindowGroupLimit), so a group with a third of all rows sends k rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def paired(df: DataFrame, other: DataFrame, parts: int = 32) -> DataFrame:
    """Every row of ``df`` with every row of ``other``, where a product has been asked for row by row.

    An equi join on a part number: rows of ``df``, the longer side, are dealt over the parts, rows of ``other`` go to each of them.
    Both sides are shuffled and merged: sizes of derived tables are guessed far too low or high, and a side sent whole to the
    driver and the executors could be the long one.  Operators whose result is a product keep it as two tables instead.
    """
    dealt_out = df.withColumn("_part", F.pmod(F.xxhash64(*df.columns), F.lit(parts)).cast("int"))
    everywhere = other.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt_out.join(everywhere.hint("merge"), "_part").drop("_part")


def missing_from(wanted: DataFrame, present: DataFrame, on: list[tuple[Column, Column]]) -> DataFrame:
    """Rows of ``wanted`` with no partner in ``present``; ``on`` pairs key expressions of both sides."""
    right = present.select(*[r.alias(f"_k{i}") for i, (_, r) in enumerate(on)]).distinct()
    left = wanted.select("*", *[l.alias(f"_w{i}") for i, (l, _) in enumerate(on)])
    cond = reduce(lambda a, b: a & b, [left[f"_w{i}"] == right[f"_k{i}"] for i in range(len(on))])
    return left.join(right, cond, "left_anti").drop(*[f"_w{i}" for i in range(len(on))])


def number_rows(df: DataFrame, pos: str, name: str = "row_no", span: int = 250_000, cells: int = 10_000) -> DataFrame:
    """1-based row number in ``pos`` (an integer) order without a one-task sort; rows without ``pos`` come first.

    Rows are numbered inside cells of ``span`` consecutive positions and shifted by the rows of earlier
    cells, which are summed in two levels (``cells`` cells to a block).  Where positions are distinct a
    cell holds at most ``span`` rows, whatever the size of the table, and nothing is sampled or counted
    beforehand.  Rows sharing a ``pos`` stay in one cell.
    """
    at = F.col(pos).cast("long")
    celled = df.withColumn("_cell", F.coalesce(at - F.pmod(at, F.lit(span)), F.lit(-2**62)))
    sizes = celled.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_block", F.col("_cell") - F.pmod(F.col("_cell"), F.lit(span * cells)))
    blocks = sizes.groupBy("_block").agg(F.sum("_n").alias("_of_block"))
    # A row per span * cells positions that occur: few, even for very large tables.
    earlier = blocks.select("_block", (F.sum("_of_block").over(Window.orderBy("_block")) - F.col("_of_block")).alias("_earlier"))
    inside_block = F.sum("_n").over(Window.partitionBy("_block").orderBy("_cell")) - F.col("_n")
    before = (sizes.withColumn("_before", inside_block).join(earlier, "_block")
              .select("_cell", (F.col("_before") + F.col("_earlier")).alias("_before")))
    inside = F.row_number().over(Window.partitionBy("_cell").orderBy(pos))
    return (celled.withColumn("_inside", inside).join(before, "_cell")
            .withColumn(name, F.col("_before") + F.col("_inside")).select(*df.columns, name))


def number_in_groups(df: DataFrame, key: str, pos: str, name: str = "row_no", span: int = 250_000) -> DataFrame:
    """1-based row number of distinct positions inside each ``key``, counted in cells of ``span`` positions, so that a key
    with very many rows is numbered by many tasks."""
    celled = df.withColumn("_cell", F.floor(F.col(pos) / span))
    sizes = celled.groupBy(key, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(key, "_cell", (F.sum("_n").over(Window.partitionBy(key).orderBy("_cell")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(key, "_cell").orderBy(pos))
    return (celled.withColumn("_inside", inside).join(before, [key, "_cell"])
            .withColumn(name, F.col("_before") + F.col("_inside")).select(*df.columns, name))


def dealt(df: DataFrame) -> DataFrame:
    """A grouped table dealt out anew, so that a join on its key shuffles both sides itself and Spark can split the hot
    keys of the other side."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
