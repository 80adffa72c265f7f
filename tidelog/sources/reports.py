"""JSON documents: result reports, manifests, custody ledgers and the notes of transfers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Report kinds by the section that tells them apart.
KINDS = {
    "investigation": ["events", "correlations", "detections"],
    "detection": ["detections"],
    "correlation": ["correlations"],
    "timeline": ["events"],
    "memory": ["processes"],
    "custody": ["ledger"],
    "artifact": ["artifacts"],
}
REPORT = "report_type string, case_id string, events array<string>, correlations array<string>, detections array<struct<matched:boolean>>, processes array<string>, ledger array<string>, artifacts array<string>, _corrupt_record string"
ENTRY = "relative_path string, size_bytes long, hashes map<string,string>"
RECORD = "seq long, event_id string, happened string, action_type string, item_id string, actor string, recipient string, previous_hash string, record_hash string, notes string"


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """One row a file with its kind; a broken file has the kind `invalid`."""
    rows = spark.read.schema(REPORT).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").json(path).withColumn("source_path", F.col("_metadata.file_path"))
    kind = F.when(F.col("_corrupt_record").isNotNull(), "invalid").when(F.col("report_type").isNotNull(), F.lower("report_type"))
    for name, sections in KINDS.items():
        has = F.col(sections[0]).isNotNull()
        for s in sections[1:]:
            has = has & F.col(s).isNotNull()
        kind = kind.when(has, name)
    return rows.withColumn("kind", kind.otherwise("unknown"))


def report_counts(reports: DataFrame) -> DataFrame:
    """The same counts for every report."""
    none_if_missing = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    matched = F.when(F.col("detections").isNull(), 0).otherwise(F.size(F.filter("detections", lambda d: d["matched"])))
    return reports.select("source_path", "kind", none_if_missing("artifacts").alias("artifacts"), none_if_missing("events").alias("events"), none_if_missing("correlations").alias("edges"), none_if_missing("detections").alias("detections"), matched.alias("matched"), none_if_missing("ledger").alias("audit_rows"))


def registered(reports: DataFrame) -> DataFrame:
    """Reports by kind, with how many were skipped."""
    return reports.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("kind").isin("invalid", "unknown")).alias("skipped"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of manifests: one row a path and algorithm."""
    rows = spark.read.schema(f"entries array<struct<{ENTRY.replace(' string', ':string').replace(' long', ':long').replace(' map', ':map')}>>").option("multiLine", True).json(path)
    entry = rows.select(F.explode("entries").alias("e")).select("e.relative_path", "e.size_bytes", F.explode_outer("e.hashes").alias("algorithm", "digest"))
    return entry


def read_ledger(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records of ledgers in order, and those refused for want of their hash."""
    fields = ",".join(f.strip().replace(" ", ":", 1) for f in RECORD.split(","))
    rows = spark.read.schema(f"ledger_id string, events array<struct<{fields}>>").option("multiLine", True).json(path)
    events = rows.select("ledger_id", F.posexplode("events").alias("place", "e")).select("ledger_id", "place", "e.*")
    return events.filter("record_hash is not null"), events.filter("record_hash is null")


def transfer_fields(notes: Column) -> Column:
    """struct(releasing, receiving, location) of a record's notes; invalid JSON gives nulls (an old transfer)."""
    return F.from_json(notes, "releasing string, receiving string, location string")
