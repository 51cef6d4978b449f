"""Streams: an append-only ledger, windows with late rows, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.store import newest


def append_ledger(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends records to a ledger of Parquet files; each batch is written once, whatever fails."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def retained(spark: SparkSession, path: str, by: list[str], at: str, n: int) -> DataFrame:
    """What retention keeps of a ledger: the newest n records of each group."""
    return newest(spark.read.parquet(path), by, [F.col(at).desc()], n)


def windowed_counts(events: DataFrame, at: str, size: str, lateness: str, by: list[str]) -> DataFrame:
    """Counts and sums by window; rows later than the watermark are left out of a stream."""
    rows = events.withWatermark(at, lateness).groupBy(F.window(at, size), *by).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return rows.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "value")


def sessions(events: DataFrame, at: str, gap: str, user: str) -> DataFrame:
    """A session ends where nothing follows within the gap."""
    rows = events.withWatermark(at, gap).groupBy(F.session_window(at, gap), user).agg(F.count("*").alias("n"))
    return rows.select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
