"""Lines of text files with their numbers, whatever the size of a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions.shared import materialize

#: Blocks whose line counts are broadcast at most (some 100 bytes each); beyond that they are joined.
BROADCAST_BLOCKS = 200_000


def place() -> list[Column]:
    """The columns that `number` needs, beside value: of a text source, batch or stream."""
    return [F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("block")]


def number(raw: DataFrame) -> DataFrame:
    """source_path, line_number (from 1), line of the rows (source_path, block, value) of a text source.

    A file is cut into blocks that tasks read side by side. The lines are written once, with their place in the
    task; a line's number is its place in its block, behind the counts of the file's blocks before. No file is
    held by one task or row (a compressed file is one block, read as a stream). Bytes that are no UTF-8 are replaced.
    """
    in_task = raw.select("source_path", "block", F.monotonically_increasing_id().alias("_at"), F.make_valid_utf8("value").alias("line"))
    lines = materialize(in_task, "lines")
    counts = lines.groupBy("source_path", "block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("source_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = materialize(counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n"), "blocks")
    few = blocks.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS
    joined = lines.join(F.broadcast(blocks) if few else blocks, ["source_path", "block"])
    return joined.select("source_path", (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("line_number"), "line")


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Numbered lines of plain or gzip text files. Lines end in LF, CR or both, as universal newlines do."""
    return number(spark.read.text(path).select(*place(), "value"))
