"""A stream's rows in three lanes: on time, late, and without a place in event time.

A stateful operator of a stream silently drops what is behind its watermark. Here each micro-batch is written
whole first, in lanes, and operators with state read the lane of rows on time: with the same delay nothing of
it is late for them, and what was late is a table beside it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import times
from tidelog.sources import lines, logs

ON_TIME, LATE, UNTIMED = "on_time", "late", "untimed"
MARK = "batch long, on_time long, late long, untimed long, mark_us long"


class Lanes:
    """A foreachBatch function: rows of prepare(batch) (with ts_class, ts_us) to out/batch=<id>/lane=<lane>.

    A row with an aware time is late where this is not after the watermark: the latest time of the batches before,
    less the delay. Naive and missing times are untimed. Each batch leaves a row of counts and its watermark in
    out_marks/batch=<id>, from which the next one starts. A batch that is run again overwrites what it wrote, with
    the same watermark, so every row is there once.
    """

    def __init__(self, out: str, delay_s: int, prepare: Callable[[DataFrame], DataFrame]) -> None:
        self.out, self.delay_us, self.prepare = out.rstrip("/"), delay_s * 1_000_000, prepare

    def mark_before(self, spark: SparkSession, batch_id: int) -> int | None:
        if batch_id == 0:
            return None
        return spark.read.schema(MARK).json(f"{self.out}_marks/batch={batch_id - 1}").first().mark_us

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, seen = batch.sparkSession, Observation()
        mark = self.mark_before(spark, batch_id)
        aware = F.coalesce(F.col("ts_class") == times.AWARE, F.lit(False)) & F.col("ts_us").isNotNull()
        late = F.lit(False) if mark is None else F.col("ts_us") <= mark
        lane = F.when(~aware, UNTIMED).when(late, LATE).otherwise(ON_TIME)
        rows = self.prepare(batch).withColumn("lane", lane)
        counts = [F.count_if(F.col("lane") == k).alias(k) for k in (ON_TIME, LATE, UNTIMED)]
        rows = rows.observe(seen, *counts, F.max(F.when(F.col("lane") != UNTIMED, F.col("ts_us"))).alias("latest"))
        rows.write.mode("overwrite").partitionBy("lane").parquet(f"{self.out}/batch={batch_id}")
        got = seen.get
        marks = [m for m in (mark, None if got["latest"] is None else got["latest"] - self.delay_us) if m is not None]
        row = (batch_id, got[ON_TIME], got[LATE], got[UNTIMED], max(marks, default=None))
        spark.createDataFrame([row], MARK).coalesce(1).write.mode("overwrite").json(f"{self.out}_marks/batch={batch_id}")


def parsed_lines(year: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """Raw lines of a micro-batch as parsed rows. Files arrive whole, so their lines are numbered as in a batch, and ids are the same."""
    return lambda batch: logs.parse_logs(lines.number(batch), year)


def ingest_logs(spark: SparkSession, path: str, out: str, checkpoint: str, delay_s: int, year: int | None = None, files_per_batch: int = 1000) -> None:
    """All files of a growing folder that were not read before, to lanes; returns when they are written."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path).select(*lines.place(), "value")
    query = raw.writeStream.foreachBatch(Lanes(out, delay_s, parsed_lines(year))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_lane(spark: SparkSession, out: str, lane: str) -> DataFrame:
    """The rows of one lane, with the batch that brought them. Only that lane's folders are read."""
    return spark.read.option("basePath", out).parquet(out).filter(F.col("lane") == lane).drop("lane")


def read_marks(spark: SparkSession, out: str) -> DataFrame:
    """A row a batch: how many rows each lane got, and the watermark behind it."""
    return spark.read.schema(MARK).json(f"{out.rstrip('/')}_marks")


def stream_lane(spark: SparkSession, out: str, lane: str = ON_TIME) -> DataFrame:
    """A lane as a stream with an event time `ts`, for operators with state."""
    schema = spark.read.parquet(out).schema
    rows = spark.readStream.schema(schema).parquet(out).filter(F.col("lane") == lane)
    return rows.withColumn("ts", F.timestamp_micros("ts_us"))
