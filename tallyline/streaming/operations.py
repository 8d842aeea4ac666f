"""Operation records as a stream: the same counters, kept up to date while records arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.report import category_statistics

OP_LOG = ("ts timestamp, file string, category string, operation string, item string, success boolean, "
          "error string, pos bigint")


def read_log_stream(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.readStream.schema(OP_LOG).format(fmt).load(path)


def live_statistics(log: DataFrame) -> DataFrame:
    """Counters per category over the whole run; state is one row per category."""
    return category_statistics(log)


def windowed_statistics(log: DataFrame, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Processed and failed records per window and category; old windows leave the state."""
    return (log.withWatermark("ts", lateness).groupBy(F.window("ts", window), "category")
            .agg(F.count(F.lit(1)).alias("processed"), F.count_if(~F.col("success")).alias("errored")))


def start(stats: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Each batch replaces the table at ``path``; nothing is kept in the driver."""
    def replace(batch: DataFrame, _batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)
    return (stats.writeStream.outputMode(mode).foreachBatch(replace)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
