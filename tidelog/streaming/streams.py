"""The operators on streams: ingest, de-duplication, failure then success, bursts, packets.

Only aware times can live on a stream's event time: rows of the other classes, and late ones, have lanes of their own (`lanes`).
The watermark equals the window, so state is bounded by what arrives in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.sources import logs, network


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log lines of a growing folder as parsed rows with an event time `ts`, without numbers: `lanes.ingest_logs` numbers them and keeps what is late or has no time."""
    lines = spark.readStream.text(path).select(F.col("_metadata.file_path").alias("source_path"), F.lit(None).cast("long").alias("line_number"), F.col("value").alias("line"))
    return timed(logs.parse_logs(lines))


def timed(rows: DataFrame) -> DataFrame:
    """Rows with an aware time, and that time as a timestamp."""
    return rows.filter(F.col("ts_class") == 0).withColumn("ts", F.timestamp_micros("ts_us"))


def untimed(rows: DataFrame) -> DataFrame:
    """Rows that have no place in event time."""
    return rows.filter(F.col("ts_class") != 0)


def deduplicate(rows: DataFrame, columns: list[str], delay_s: int) -> DataFrame:
    """First row of equal columns within the delay."""
    return rows.withWatermark("ts", f"{delay_s} seconds").dropDuplicatesWithinWatermark(columns)


def failure_then_success(rows: DataFrame, window_s: int, failed: str = "error", succeeded: str = "signup") -> DataFrame:
    """Interval join of two watermarked streams: a failure, and a success up to window_s later.

    Times are dealt into buckets of the window's width, as a stream join needs an equal key.
    """
    side = lambda t, s: rows.filter(F.col("event_type") == t).select(F.col("event_id").alias(f"event_{s}"), F.col("user_id").alias(f"user_{s}"), F.col("ts").alias(f"ts_{s}")).withWatermark(f"ts_{s}", f"{window_s} seconds")
    bucket = lambda c: F.floor(F.unix_micros(c) / F.lit(window_s * 1_000_000)).cast("long")
    a = side(failed, "a").withColumn("bucket_a", F.explode(F.array(bucket("ts_a"), bucket("ts_a") + 1)))
    b = side(succeeded, "b").withColumn("bucket_b", bucket("ts_b"))
    return a.join(b, F.expr(f"bucket_a = bucket_b AND ts_b >= ts_a AND ts_b <= ts_a + INTERVAL {window_s} SECONDS")).drop("bucket_a", "bucket_b")


def bursts(rows: DataFrame, key: str | Column, length: str = "5 minutes", slide: str = "1 minute", least: int = 3) -> DataFrame:
    """Windows in which a key has `least` rows or more."""
    counted = rows.withWatermark("ts", length).groupBy(F.window("ts", length, slide), F.col(key) if isinstance(key, str) else key).agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least)


def sessions(rows: DataFrame, key: str, gap: str = "5 minutes") -> DataFrame:
    """Runs of rows of a key without a gap longer than `gap`."""
    return rows.withWatermark("ts", gap).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))


def packets(rows: DataFrame) -> DataFrame:
    """Network events of a stream of packet rows."""
    return network.packet_events(rows)


def run_once(stream: DataFrame, path: str, checkpoint: str) -> str:
    """Process all that is there and stop; returns the path of the Parquet output."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return path
