"""Rows of all kinds as one artifact table: union, filter, search, lineage, counts; and its sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import ids

COLUMNS = ["artifact_id", "category", "artifact_type", "source_path", "line_number", "status", "source_event_id", "payload_json"]


def unify(rows: DataFrame, category: str, artifact_type: str, status: str = "PARSED") -> DataFrame:
    """One kind as artifacts: type and status are names of columns where such exist, else values."""
    pick = lambda v: F.col(v) if v in rows.columns else F.lit(v)
    payload = F.to_json(F.struct(*sorted(rows.columns)))
    return rows.select(
        ids.uuid5(ids.namespace("unified"), ids.joined(F.lit(category), F.col("source_path"), F.col("line_number"), payload)).alias("artifact_id"), F.lit(category).alias("category"), pick(artifact_type).alias("artifact_type"), "source_path", "line_number",
        pick(status).alias("status"), F.concat_ws(":", "source_path", "line_number").alias("source_event_id"), payload.alias("payload_json"),
    )


def union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def query(artifacts: DataFrame, category: str | None = None, artifact_type: str | None = None, status: str | None = None, path: str | None = None, path_contains: str | None = None, line: int | None = None, text: str | None = None) -> DataFrame:
    """AND of the given predicates."""
    for c, v in (("category", category), ("artifact_type", artifact_type), ("status", status), ("source_path", path), ("line_number", line)):
        artifacts = artifacts if v is None else artifacts.filter(F.col(c) == v)
    artifacts = artifacts if path_contains is None else artifacts.filter(F.col("source_path").contains(path_contains))
    return artifacts if text is None else artifacts.filter(F.lower("payload_json").contains(text.lower()))


def lineage(artifacts: DataFrame, keys: DataFrame) -> DataFrame:
    """Artifacts whose id or source id is one of the keys (key), in one pass over them."""
    each = artifacts.withColumn("_key", F.explode(F.array_distinct(F.array("artifact_id", "source_event_id"))))
    wanted = keys.select(F.col("key").alias("_key")).distinct()
    return each.join(wanted, "_key", "left_semi").select(artifacts.columns).distinct()


def order(artifacts: DataFrame) -> DataFrame:
    return artifacts.orderBy("source_path", F.coalesce("line_number", F.lit(-1)), "category", "artifact_type", "source_event_id", "artifact_id")


def counts(artifacts: DataFrame) -> DataFrame:
    return artifacts.groupBy("category", "status").agg(F.count("*").alias("n"))


def write_csv(artifacts: DataFrame, path: str) -> None:
    artifacts.select(COLUMNS).write.option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_timeline(events: DataFrame, path: str, form: str = "parquet") -> None:
    """Parquet by category and day, or JSON lines in timeline order."""
    if form == "json":
        from tidelog.operators.timeline import order as in_order

        in_order(events).write.json(path)
    else:
        events.withColumn("day", F.to_date(F.timestamp_micros("ts_us"))).write.partitionBy("category", "day").parquet(path)


def catalogue(spark: SparkSession, root: str) -> DataFrame:
    """path, size, modified, digests of all files below root; files beyond 2 GB have to come with their hash, and empty files have no row (Spark's reader leaves them out)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("size_bytes"), F.unix_micros("modificationTime").alias("modified_us"), F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"), F.sha2("content", 512).alias("sha512"))
