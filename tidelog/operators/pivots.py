"""The pivot index: one row for each value that a case, file, event, link, detection or process can be found by.

Rows: field, value (normalised), observed, namespace (of identifiers), scope (the evidence or host in which it was
seen), kind of what was found, ref (its id). As a table the index lies in a folder for each field and bucket of values,
with Bloom filters of the values in its files, so a look-up lists one folder and opens few files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.net import normalize_ip
from tidelog.functions.times import strip

# The fields of the index, and the namespaces of identifiers that a look-up may name in front of a value.
FIELDS = ["case", "sha256", "artifact", "event", "rule", "ip", "pid", "user"]
NAMESPACES = {
    "evidence_id": "evidence_id", "unified_id": "unified_id", "unified_artifact_id": "unified_id", "source_id": "source_id", "source_artifact_id": "source_artifact_id",
    "correlation_id": "correlation_id", "report_id": "report_id", "payload_artifact_id": "payload_artifact_id",
}
COLUMNS = ["field", "value", "observed", "namespace", "scope", "kind", "ref"]
BUCKETS = 64


def normalize_text(value: Column) -> Column:
    return F.nullif(strip(value.cast("string")), F.lit(""))


def normalize_sha256(value: Column) -> Column:
    v = F.lower(strip(value))
    return F.when(v.rlike("^[0-9a-f]{64}$"), v)


def normalize_pid(value: Column) -> Column:
    p = strip(value.cast("string")).try_cast("long")
    return F.when(p >= 0, p.cast("string"))


NORMALIZE = {f: normalize_text for f in FIELDS} | {"sha256": normalize_sha256, "pid": normalize_pid, "ip": lambda v: normalize_ip(v.cast("string"))}


def index(rows: DataFrame, kind: str, ref: str, values: list[tuple[str, str, str | None]], scope: str | None = None) -> DataFrame:
    """Index rows of a table: values are (field, column, namespace); a column may hold an array. What does not normalise is left out."""
    parts = []
    for field, column, namespace in values:
        many = F.col(column) if rows.schema[column].dataType.typeName() == "array" else F.array(F.col(column))
        part = F.transform(many, lambda v: F.struct(F.lit(field).alias("field"), NORMALIZE[field](v).alias("value"), v.cast("string").alias("observed"), F.lit(namespace).cast("string").alias("namespace")))  # noqa: B023
        parts.append(part)
    entries = F.filter(F.concat(*parts), lambda x: x["value"].isNotNull())
    at = F.lit(None).cast("string") if scope is None else normalize_text(F.col(scope))
    return rows.select(F.explode(entries).alias("p"), at.alias("scope"), F.lit(kind).alias("kind"), F.col(ref).cast("string").alias("ref")).select("p.*", "scope", "kind", "ref").select(COLUMNS)


def of_events(events: DataFrame, scope: str | None = None) -> DataFrame:
    """Events by their id, artifact, address and user; by pid where they have one."""
    values = [("event", "event_id", None), ("artifact", "source_artifact_id", "source_artifact_id"), ("ip", "source_ip", None), ("user", "username", None)]
    more = [("ip", c, None) for c in ("src_ip", "dst_ip")] + [("pid", "pid", None), ("sha256", "sha256", None), ("case", "case_id", None)]
    return index(events, "event", "event_id", values + [m for m in more if m[1] in events.columns], scope)


def of_detections(detections: DataFrame) -> DataFrame:
    return index(detections, "detection", "detection_id", [("rule", "rule_id", None), ("event", "event_ids", None)])


def of_links(links: DataFrame) -> DataFrame:
    """Links (with edge_id) by both events and by their own id."""
    rows = links.withColumn("_ends", F.array("event_a", "event_b"))
    return index(rows, "link", "edge_id", [("event", "_ends", None), ("artifact", "edge_id", "correlation_id")])


def of_files(files: DataFrame, scope: str | None = None) -> DataFrame:
    """Catalogued files (artifact_id, sha256) by digest and artifact."""
    return index(files, "file", "artifact_id", [("sha256", "sha256", None), ("artifact", "artifact_id", "unified_id")], scope)


def of_processes(processes: DataFrame) -> DataFrame:
    """Processes of memory evidence (evidence_id, artifact_id, pid): a pid is found within its evidence only."""
    return index(processes, "process", "artifact_id", [("pid", "pid", None), ("artifact", "artifact_id", "payload_artifact_id"), ("artifact", "evidence_id", "evidence_id")], "evidence_id")


def of_reports(reports: DataFrame) -> DataFrame:
    """Reports (report_id, case_id)."""
    return index(reports, "report", "report_id", [("case", "case_id", None), ("artifact", "report_id", "report_id")])


def union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def bucket(field: Column, value: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(field, value), F.lit(buckets)).cast("int")


def write(rows: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """The index as a table. A value that many rows have is spread over files of its folder: rebalancing splits what is large."""
    placed = rows.withColumn("bucket", bucket(F.col("field"), F.col("value"), buckets)).hint("rebalance", "field", "bucket")
    out = placed.sortWithinPartitions("field", "bucket", "value", "kind", "ref").write.partitionBy("field", "bucket")
    out.option("parquet.bloom.filter.enabled#value", "true").option("parquet.bloom.filter.expected.ndv#value", "100000").option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def find(index: DataFrame, field: str, value: str, kind: str | None = None, most: int = 1000, scope: str | None = None, namespace: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """References of a value, `most` of them in order, each with how many there are in all (total) and whether some are left out (truncated).

    The value is normalised as the index's own. A namespace may be given, or written in front of the value
    (`evidence_id:E1`); an artifact id that several namespaces hold gives nothing without one. A pid needs a scope, or
    a kind of thing within which it is unique.
    """
    if field not in FIELDS:
        raise ValueError(f"no field of the index: {field}")
    if most < 1:
        raise ValueError("at least one reference has to be asked for")
    if field == "pid" and scope is None and kind is None:
        raise ValueError("a pid is found within one scope or kind only")
    before, colon, rest = value.partition(":")
    if colon and before.strip().lower() in NAMESPACES:
        namespace, value = namespace or NAMESPACES[before.strip().lower()], rest
    namespace = NAMESPACES.get(namespace, namespace)
    wanted = NORMALIZE[field](F.lit(value))
    at = (F.col("field") == field) & (F.col("value") == wanted)
    if "bucket" in index.columns:  # of the written table: one folder
        (number,) = index.sparkSession.range(1).select(bucket(F.lit(field), wanted, buckets)).first()
        at = at & (F.col("bucket") == number)
    every = index.filter(at).select(COLUMNS)
    out = every
    for column, given in (("kind", kind), ("scope", scope), ("namespace", namespace)):
        out = out if given is None else out.filter(F.col(column) == given)
    first = out.orderBy("kind", "ref", "scope", "observed").limit(most).crossJoin(out.agg(F.count("*").alias("total")))  # one row
    if field == "artifact" and namespace is None:
        first = first.crossJoin(every.agg(F.count_distinct("namespace").alias("_spaces"))).filter("_spaces <= 1").drop("_spaces")
    return first.withColumn("truncated", F.col("total") > most)


def counts(index: DataFrame) -> DataFrame:
    return index.groupBy("field").agg(F.count("*").alias("n"), F.count_distinct("value").alias("values"))
