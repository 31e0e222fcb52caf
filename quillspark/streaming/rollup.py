"""Streaming signal rollup: event files to case signals, micro-batch by micro-batch.

The rollup is a commutative fold (least, greatest, count), so any split into batches gives the batch result.
Rows later than the watermark are dropped from the windowed counts, not from the rollup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.sinks import merge_rows, read_table

SCHEMA = "event_id long, user_id long, ts timestamp, event_type string, value double, props string"
WATERMARK = "1 day"


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def observations(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("case_id"), F.concat(F.lit("activity:"), "event_type").alias("signal_key"), F.col("ts").alias("observed_at"))


def daily_counts(events: DataFrame) -> DataFrame:
    """Signals per case and day."""
    return observations(events).withWatermark("observed_at", WATERMARK).groupBy(F.window("observed_at", "1 day"), "case_id", "signal_key").agg(F.count("*").alias("n"))


def sliding_counts(events: DataFrame) -> DataFrame:
    """Signals per case over seven days, each day."""
    return observations(events).withWatermark("observed_at", WATERMARK).groupBy(F.window("observed_at", "7 days", "1 day"), "case_id", "signal_key").agg(F.count("*").alias("n"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Runs of activity of a case."""
    return observations(events).withWatermark("observed_at", WATERMARK).groupBy(F.session_window("observed_at", gap), "case_id").agg(F.count("*").alias("n"))


def fold(rows: DataFrame) -> DataFrame:
    return rows.groupBy("case_id", "signal_key").agg(F.min("first_observed").alias("first_observed"), F.max("last_observed").alias("last_observed"), F.sum("observations").alias("observations"))


def rollup_into(path: str):
    """A foreachBatch function that folds a batch of observations into the table at path; only parts with the batch's keys are
    rewritten, and a batch that is repeated counts once."""

    def step(batch: DataFrame, batch_id: int) -> None:
        new = fold(batch.selectExpr("case_id", "signal_key", "observed_at first_observed", "observed_at last_observed", "1L observations"))
        merge_rows(new, path, ["case_id", "signal_key"], lambda old, rows: fold(old.unionByName(rows)), step=batch_id)

    return step


def run_rollup(spark: SparkSession, source: str, path: str, checkpoint: str) -> DataFrame:
    """Drains the source into the table and returns it."""
    q = observations(event_stream(spark, source)).writeStream.foreachBatch(rollup_into(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return read_table(spark, path)
