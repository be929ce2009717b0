"""Structured Streaming twins of the signal bus: the same results as the batch operators once all input is in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.signals import QUORUM
from ..sources.exports import append_signals

SIGNAL = "event_id bigint, kind string, key string, signal string, intensity double, note string, target_memory_id bigint, ts timestamp, expires_at timestamp"


def read_signals(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """Signals from parquet files as they arrive."""
    return spark.readStream.schema(SIGNAL).option("maxFilesPerTrigger", per_trigger).parquet(path)


def waggle_state(signals: DataFrame) -> DataFrame:
    """Dances, intensity, newest rationale and quorum per topic, kept up to date (update or complete mode). State is a row a topic."""
    note = F.when(F.col("note").isNotNull(), F.struct("ts", "event_id"))
    w = signals.where("kind = 'waggle'").groupBy("key").agg(F.count(F.lit(1)).alias("dances"), F.max("intensity").alias("intensity"), F.max_by("note", note).alias("rationale"))
    return w.withColumn("quorum", F.col("dances") >= QUORUM)


def signals_per_window(signals: DataFrame, late: str = "1 hour", size: str = "6 hours") -> DataFrame:
    """Counts by kind and event-time window; the watermark bounds the state."""
    return signals.withWatermark("ts", late).groupBy(F.window("ts", size), "kind").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "kind", "n")


def first_of_each(signals: DataFrame, late: str = "1 hour") -> DataFrame:
    """Signals without those that repeat an id within the watermark: pollers may read a row twice."""
    return signals.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def append_pending(signals: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Every batch's signals appended as JSON lines, once: the checkpoint keeps how far the source was read, the log which batches it has."""
    return signals.writeStream.foreachBatch(lambda df, i: append_signals(df, out, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_windows(signals: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Bursts of a key's signals that no gap interrupts."""
    return signals.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "key").agg(F.count(F.lit(1)).alias("n")).select("key", F.col("session_window.start").alias("start"), "n")
