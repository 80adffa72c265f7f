"""The timeline of memory artifacts, and the triage of each evidence: from objects as `memory_documents.load` gives them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import ids, times
from tidelog.functions.shared import materialize
from tidelog.operators import memory, rules
from tidelog.sources import memory_documents

# Texts that stand for no time.
NO_TIME = ["n/a", "none", "null", "-"]
#: All of an event but its id; `attributes` as sorted entries.
FINGERPRINT = ["ts_class", "ts_us", "raw_timestamp", "category", "kind", "event_type", "description", "evidence_id", "artifact_id", "timestamp_origin"]
FIELDS = ["pid", "ppid", "name", "path", "protocol", "local_port", "state", "execution_id", "source_plugin", "source_row"]


def _time(text: Column) -> Column:
    """struct(ts_class, ts_us) of a time as tools write it; null where it is none."""
    ts_class, us = times.normalize(F.when(~F.lower(times.strip(text)).isin(NO_TIME), text))
    return F.when(us.isNotNull(), F.struct(ts_class.alias("ts_class"), us.alias("ts_us")))


def _endpoint(address: str, port: str) -> Column:
    return F.concat(F.coalesce(F.col(address), F.lit("*")), F.lit(":"), F.coalesce(F.col(port).cast("string"), F.lit("*")))


def _part(before: str, value: Column, after: str = "") -> Column:
    return F.coalesce(F.concat(F.lit(before), value.cast("string"), F.lit(after)), F.lit(""))


def events(objects: DataFrame) -> DataFrame:
    """Events of accepted objects: a process created and exited, or observed where it has neither time; a socket created or observed; a module observed; and stored events as they are."""
    rows = objects.filter(F.col("reason").isNull())
    created, exited, stored = _time(F.col("created_at")), _time(F.col("exit_time")), _time(F.col("timestamp"))
    none = F.lit(None).cast("struct<ts_class:int,ts_us:bigint>")
    event = lambda kind, at, raw, origin: F.struct(F.lit(kind).alias("event_type"), at.cast("struct<ts_class:int,ts_us:bigint>").alias("at"), (F.lit(None).cast("string") if raw is None else F.col(raw)).alias("raw_timestamp"), F.lit(origin).alias("timestamp_origin"))
    of_process = F.when(created.isNull() & exited.isNull(), F.array(event("process_observed", none, None, "none"))).otherwise(
        F.array_compact(F.array(F.when(created.isNotNull(), event("process_created", created, "created_at", "source_created_at")), F.when(exited.isNotNull(), event("process_exited", exited, "exit_time", "source_exit_time"))))
    )
    of_socket = F.array(F.when(created.isNotNull(), event("socket_created", created, "created_at", "source_created_at")).otherwise(event("socket_observed", none, "created_at", "none")))
    of_module = F.array(event("module_observed", none, None, "none"))
    of_event = F.array(F.struct(F.coalesce("event_type", F.lit("memory_event")).alias("event_type"), stored.cast("struct<ts_class:int,ts_us:bigint>").alias("at"), F.col("raw_timestamp"), F.lit("stored").alias("timestamp_origin")))
    kind = F.col("kind")
    made = F.when(kind == "process", of_process).when(kind == "socket", of_socket).when(kind == "module", of_module).otherwise(of_event)
    rows = rows.select("*", F.explode(made).alias("e"))
    verb = F.split_part("e.event_type", F.lit("_"), F.lit(-1))
    description = (
        F.when(kind == "process", F.concat(F.lit("process "), verb, F.lit(": "), F.col("process_name"), F.lit(" (PID "), F.col("pid").cast("string"), F.lit(")")))
        .when(kind == "socket", F.concat(F.lit("socket "), verb, F.lit(": "), F.col("protocol"), F.lit(" "), _endpoint("local_address", "local_port"), F.lit(" -> "), _endpoint("remote_address", "remote_port"), _part(" (state: ", F.col("state"), ")"), _part(" (PID: ", F.col("pid"), ")")))
        .when(kind == "module", F.concat(F.lit("module "), verb, F.lit(": "), F.col("module_name"), _part(", base: ", F.col("base_address")), _part(", size: ", F.col("size_bytes"))))
        .otherwise(F.coalesce("description", F.lit("")))
    )
    key = ids.uuid5(ids.namespace("memory-event"), ids.joined(F.col("evidence_id"), F.col("artifact_id"), F.col("e.event_type"), F.col("e.timestamp_origin")))
    return rows.select(
        F.when(kind == "event", F.col("event_id")).otherwise(key).alias("event_id"), F.coalesce("e.at.ts_class", F.lit(times.MISSING)).alias("ts_class"), "e.at.ts_us", F.lit("memory").alias("category"), "kind", "e.event_type",
        description.alias("description"), "evidence_id", F.coalesce("artifact_id", F.lit("")).alias("artifact_id"), "e.raw_timestamp", "e.timestamp_origin", "pid", "ppid", F.coalesce("process_name", "module_name").alias("name"), F.col("driver_path").alias("path"),
        "protocol", "local_port", "state", "execution_id", "source_plugin", F.coalesce(F.get("row_indices", F.lit(0)), F.lit(0)).alias("source_row"), "attributes",
    )


def deduplicate(memory_events: DataFrame) -> DataFrame:
    """One row of each fingerprint, that of the smallest id, with n: how many there were. One aggregate, no window."""
    entries = F.array_sort(F.map_entries(F.coalesce("attributes", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))))
    one = memory_events.withColumn("_entries", entries).groupBy(*FINGERPRINT, "_entries").agg(F.min(F.struct("event_id", *FIELDS)).alias("first"), F.count("*").alias("n"))
    return one.select(F.col("first.event_id").alias("event_id"), *FINGERPRINT, *(f"first.{c}" for c in FIELDS), F.map_from_entries("_entries").alias("attributes"), "n")


def sort_key() -> list[Column]:
    """Aware, naive, missing; then time, evidence, artifact, row, type, description, id, time as written."""
    return [F.col("ts_class"), F.coalesce("ts_us", F.lit(0)), F.col("evidence_id"), F.col("artifact_id"), F.col("source_row"), F.col("event_type"), F.col("description"), F.col("event_id"), F.coalesce("raw_timestamp", F.lit(""))]


def reconstruct(objects: DataFrame) -> DataFrame:
    """The memory timeline: without duplicates, in order, by range partitions."""
    return deduplicate(events(objects)).orderBy(*sort_key())


def as_timeline(memory_events: DataFrame) -> DataFrame:
    """With the columns of the common timeline, for `timeline.unite`, links and rules."""
    return memory_events.withColumn("source_path", F.concat(F.lit("memory:"), F.col("evidence_id"))).withColumn("source_line", F.col("source_row") + 1).withColumn("source_artifact_id", F.col("artifact_id")).withColumn("source_event_id", F.col("event_id"))


def _within_one_evidence(detections: DataFrame, memory_events: DataFrame) -> DataFrame:
    """evidence_id, rule_name of the detections whose events are all of one evidence."""
    of = memory_events.select(F.col("event_id").alias("_event"), "evidence_id").distinct()
    owned = detections.select("detection_id", "rule_name", F.explode("event_ids").alias("_event")).join(of, "_event")
    return owned.groupBy("detection_id", "rule_name").agg(F.min("evidence_id").alias("evidence_id"), F.max("evidence_id").alias("_other")).filter(F.col("evidence_id") == F.col("_other"))


def triage(objects: DataFrame, over: list[rules.Rule]) -> DataFrame:
    """evidence_id, measure, name, n: all that is told of each evidence, from counts.

    Measures: objects accepted (by kind) and refused (by reason, under the evidence they name); events, duplicates
    removed, time classes and types of events; links (by relation, of distinct artifacts); and hits of the rules. Rules see
    one evidence at a time: what joins two is no hit.
    """
    objects = materialize(objects, "objects")  # read many times below: parsed once
    alike = materialize(deduplicate(events(objects)), "events")
    told = lambda rows, measure, name, n: rows.groupBy("evidence_id", name.alias("name")).agg(n.alias("n")).select("evidence_id", F.lit(measure).alias("measure"), "name", "n")
    all_of = F.lit("all")
    klass = F.when(F.col("ts_class") == times.AWARE, "aware").when(F.col("ts_class") == times.NAIVE, "naive").otherwise("unanchored")
    once = lambda rows: rows.dropDuplicates(["evidence_id", "artifact_id"])
    processes, sockets, modules = (once(of(objects)) for of in (memory_documents.processes, memory_documents.sockets, memory_documents.modules))
    paths = processes.select("evidence_id", "artifact_id", F.col("attributes")["ImagePath"].alias("image_path"), F.col("attributes")["MemoryRegions"].alias("memory_regions"))
    bound = memory.process_module(paths, modules.select("evidence_id", "artifact_id", F.col("driver_path").alias("path"), "base_address"))
    links = memory.triage(processes, sockets).unionByName(bound.groupBy("evidence_id", "relation").agg(F.count("*").alias("n")))
    hits = _within_one_evidence(rules.evaluate(as_timeline(alike), over), alike)
    parts = [
        told(objects.filter("reason is null"), "objects", F.col("kind"), F.count("*")), told(objects.filter("reason is not null and evidence_id is not null"), "refused", F.col("reason"), F.count("*")),
        told(alike, "events", all_of, F.count("*")), told(alike, "duplicates", all_of, F.sum(F.col("n") - 1)), told(alike, "class", klass, F.count("*")), told(alike, "event_type", F.col("event_type"), F.count("*")),
        links.select("evidence_id", F.lit("links").alias("measure"), F.col("relation").alias("name"), "n"), told(hits, "rule", F.col("rule_name"), F.count("*")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
