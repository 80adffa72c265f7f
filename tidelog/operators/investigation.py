"""The report of an investigation: events, links and detections in fixed order, with counts, written without gathering them.

A section is JSON lines in folders of ROWS lines by position, each one file, so the lines of a section in the order of its
folders are the same bytes however the tables were partitioned. A digest for each folder, and one over all, prove it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import timeline

#: Lines of a folder; the digest of a folder is of all its lines, which one task holds.
ROWS = 20_000
SECTIONS = ["summary", "events", "links", "detections"]


def link_order() -> list[Column]:
    """By start (missing last), relation, events."""
    return [F.col("start_us").isNull(), F.coalesce("start_us", F.lit(0)), F.col("relation"), F.col("event_a"), F.col("event_b")]


def detection_order() -> list[Column]:
    return [F.col("start_us").isNull(), F.coalesce("start_us", F.lit(0)), F.col("rule_id"), F.array_join("event_ids", ","), F.col("detection_id")]


def summary(events: DataFrame, links: DataFrame, detections: DataFrame) -> DataFrame:
    """section, name, n: totals (name `all`), events by category and class, links by relation, detections by rule."""
    told = lambda rows, section, name: rows.groupBy(name.alias("name")).agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), "name", "n")
    klass = F.concat(F.lit("class "), F.col("ts_class").cast("string"))
    parts = [
        told(events, "events", F.lit("all")), told(events, "events", F.concat(F.lit("category "), F.col("category"))), told(events, "events", klass),
        told(links, "links", F.lit("all")), told(links, "links", F.concat(F.lit("relation "), F.col("relation"))),
        told(detections, "detections", F.lit("all")), told(detections, "detections", F.concat(F.lit("rule "), F.col("rule_name"))),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _lines(rows: DataFrame, section: str, order: list[Column], case: str | None) -> DataFrame:
    """section, position, line: each row as JSON with its columns in order of name, nulls included."""
    columns = sorted(rows.columns)
    of_case = [F.lit(case).alias("case_id")] if case is not None else []
    text = F.to_json(F.struct(*of_case, *columns), {"ignoreNullFields": "false"})
    placed = timeline.with_position(rows.withColumn("_line", text), key=[*order, F.col("_line")])
    return placed.select(F.lit(section).alias("section"), "position", F.col("_line").alias("line"))


def report_lines(events: DataFrame, links: DataFrame, detections: DataFrame, case: str | None = None) -> DataFrame:
    """The lines of all sections: section, chunk, position (from 1 in a section), line."""
    parts = [
        _lines(summary(events, links, detections), "summary", [F.col("section"), F.col("name")], case), _lines(events, "events", timeline.sort_key(), case),
        _lines(links, "links", link_order(), case), _lines(detections, "detections", detection_order(), case),
    ]
    every = reduce(lambda a, b: a.unionByName(b), parts)
    return every.withColumn("chunk", F.floor((F.col("position") - 1) / ROWS))


def write_report(lines: DataFrame, path: str) -> None:
    """A folder for each section and chunk, one text file in each. Sections are numbered in their order."""
    number = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section"))
    rows = lines.select(F.concat_ws("-", number.cast("string"), "section").alias("section"), "chunk", "position", F.col("line").alias("value"))
    dealt = rows.repartitionByRange("section", "chunk").sortWithinPartitions("section", "chunk", "position")
    dealt.drop("position").write.partitionBy("section", "chunk").text(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """section, chunk, line of a written report."""
    rows = spark.read.text(path)
    return rows.select(F.split_part("section", F.lit("-"), F.lit(2)).alias("section"), F.col("chunk").cast("long").alias("chunk"), F.col("value").alias("line"))


def digests(lines: DataFrame) -> DataFrame:
    """section, chunk, n_lines, sha256 of the chunk's lines, each with a line feed, in order."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: F.concat(x["line"], F.lit("\n"))), "")
    return lines.groupBy("section", "chunk").agg(F.count("*").alias("n_lines"), F.sha2(joined, 256).alias("sha256"))
