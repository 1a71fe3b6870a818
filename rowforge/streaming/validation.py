"""Record validation of streams. All checks look at one row, so no state is kept and no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rowforge.operators.records import Rules, result_column
from rowforge.types import Node


def route(stream: DataFrame, node: Node, good: str, bad: str, checkpoint: str, rules: Rules | None = None, *, variant: str | None = None, once: bool = False) -> StreamingQuery:
    """Valid data to one Parquet folder and invalid rows with their errors to another.

    Each micro-batch is written to its own subfolder, which a batch that runs again replaces, so both outputs have every
    row exactly once.
    """
    names = stream.columns
    result = stream.select(*(F.col(f"`{c}`") for c in names), result_column(node, stream, rules, variant=variant).alias("__r"))

    def write(batch: DataFrame, number: int) -> None:
        # a batch is read again for each side rather than kept on the executors, which may be lost
        batch.where("__r.ok").select("__r.data.*").write.mode("overwrite").parquet(f"{good}/batch={number}")
        batch.where("NOT __r.ok").select(*(F.col(f"`{c}`") for c in names), F.col("__r.errors").alias("errors")).write.mode("overwrite").parquet(f"{bad}/batch={number}")

    writer = result.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def error_rates(stream: DataFrame, node: Node, time: str, window: str, watermark: str, rules: Rules | None = None) -> DataFrame:
    """Per time window: rows, invalid rows and, for append mode, a watermark that closes windows."""
    result = stream.select(F.col(time).alias("time"), result_column(node, stream, rules).getField("ok").alias("ok"))
    windows = result.withWatermark("time", watermark).groupBy(F.window("time", window).alias("window"))
    return windows.agg(F.count("*").alias("rows"), F.sum(F.when(F.col("ok"), 0).otherwise(1)).alias("invalid"))
