"""Streaming forms: rooms from arriving token files, running cost by window. Extensions of the batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.operators.pairing import rules_rooms

TOKENS = "page_id long, token_index int, text string, confidence double, angle int, x1 int, y1 int, x2 int, y2 int"


def token_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Tokens of arriving Parquet files; a page must arrive whole in one file."""
    return spark.readStream.schema(TOKENS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_rooms(tokens: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Rooms of each micro-batch, in a folder named by the batch, so that a batch that runs again replaces itself."""

    def batch(rows: DataFrame, number: int) -> None:
        rules_rooms(rows).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return tokens.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def cost_windows(calls: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Calls and cost per model and window of event time ``ts``; rows later than ``late`` are dropped from a stream."""
    timed = calls.withWatermark("ts", late) if calls.isStreaming else calls
    sums = timed.groupBy(F.window("ts", window).alias("w"), "model").agg(F.count("*").alias("calls"), F.sum("micro_usd").alias("micro_usd"))
    return sums.select(F.col("w.start").alias("start"), "model", "calls", "micro_usd")
