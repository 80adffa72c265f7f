"""Links between memory artifacts, their timeline and their rules. The evidence is in every join key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import ids
from tidelog.functions.times import strip
from tidelog.operators.correlate import band_join


def sided(df: DataFrame, s: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{c}_{s}") for c in df.columns))


def edges(pairs: DataFrame, kind: str, confidence: str, *more: Column) -> DataFrame:
    return pairs.select(F.lit(kind).alias("relation"), F.col("evidence_id_a").alias("evidence_id"), F.col("artifact_id_a").alias("from_id"), F.col("artifact_id_b").alias("to_id"), F.lit(confidence).alias("confidence"), *more)


def pairs_on(a: DataFrame, b: DataFrame, on: Column) -> DataFrame:
    return sided(a, "a").join(sided(b, "b"), (F.col("evidence_id_a") == F.col("evidence_id_b")) & on)


def parent_child(processes: DataFrame) -> DataFrame:
    pairs = pairs_on(processes.filter("ppid > 0"), processes, F.col("ppid_a") == F.col("pid_b")).filter("artifact_id_a <> artifact_id_b")
    return edges(pairs, "PARENT_CHILD_PROCESS", "HIGH", F.col("pid_a").alias("child_pid"), F.col("pid_b").alias("parent_pid"))


def process_socket(processes: DataFrame, sockets: DataFrame) -> DataFrame:
    pairs = pairs_on(processes, sockets.filter("pid > 0"), F.col("pid_a") == F.col("pid_b"))
    return edges(pairs, "PROCESS_NETWORK_SOCKET", "HIGH", F.col("pid_a").alias("pid"), F.col("local_port_b").alias("local_port"))


def same_pid(processes: DataFrame) -> DataFrame:
    """Different artifacts of one pid; differing names point to reuse."""
    pairs = pairs_on(processes, processes, F.col("pid_a") == F.col("pid_b")).filter("artifact_id_a < artifact_id_b")
    return edges(pairs, "PROCESS_PID_MATCH", "MEDIUM", F.col("pid_a").alias("pid"), (F.col("name_a") != F.col("name_b")).alias("reused"))


def _parts(texts: DataFrame, wanted: DataFrame, ends_only: bool) -> DataFrame:
    """evidence_id, text, part: the parts of each text that have the length of a wanted one of the same evidence; only its ends, or all."""
    lengths = wanted.groupBy("evidence_id").agg(F.collect_set(F.length("part")).alias("_lengths"))  # as many as there are lengths
    fits = F.filter("_lengths", lambda n: n <= F.length("text"))
    at = lambda n: F.array(F.length("text") - n + 1) if ends_only else F.sequence(F.lit(1), F.length("text") - n + 1)
    cut = F.flatten(F.transform(fits, lambda n: F.transform(at(n), lambda k: F.substring(F.col("text"), k, n))))
    return texts.join(lengths, "evidence_id").select("evidence_id", "text", F.explode(F.array_distinct(cut)).alias("part"))


def found_in(texts: DataFrame, wanted: DataFrame, ends_only: bool = False) -> DataFrame:
    """evidence_id, text, part of all distinct texts (evidence_id, text) that hold, or end in, a wanted part (evidence_id, part).

    An equi-join: each text is cut at the lengths that its evidence's wanted parts have, and cuts are compared whole. No
    key is shorter than what is looked for, so a short common ending gathers nothing but its matches.
    """
    texts, wanted = texts.distinct(), wanted.distinct()
    return _parts(texts, wanted, ends_only).join(wanted, ["evidence_id", "part"])


def _folded(c: str) -> Column:
    return F.nullif(F.lower(strip(F.col(c))), F.lit(""))


def process_module(processes: DataFrame, modules: DataFrame) -> DataFrame:
    """A module whose path equals the image path or ends in it, or the reverse; else one whose base address a process's memory regions name.

    Paths are compared without case and blanks around. binding is path_binding or base_address_binding.
    """
    p = processes.withColumn("image", _folded("image_path")).select("evidence_id", "artifact_id", "image", *(["memory_regions"] if "memory_regions" in processes.columns else []))
    m = modules.withColumn("own", _folded("path")).select("evidence_id", "artifact_id", "own", *(["base_address"] if "base_address" in modules.columns else []))
    images, owns = p.filter("image is not null").select("evidence_id", F.col("image").alias("text")).distinct(), m.filter("own is not null").select("evidence_id", F.col("own").alias("text")).distinct()
    as_part = lambda d: d.withColumnRenamed("text", "part")
    ends = found_in(images, as_part(owns), True).select("evidence_id", F.col("text").alias("image"), F.col("part").alias("own"))
    starts = found_in(owns, as_part(images), True).select("evidence_id", F.col("part").alias("image"), F.col("text").alias("own"))
    paths = ends.unionByName(starts).distinct()
    sides = lambda d, s: d.withColumnRenamed("artifact_id", f"artifact_id_{s}")
    by_path = sides(p, "a").join(paths, ["evidence_id", "image"]).join(sides(m, "b"), ["evidence_id", "own"])
    pairs = by_path.select("evidence_id", "artifact_id_a", "artifact_id_b", (F.col("image") == F.col("own")).alias("exact"), F.lit("path_binding").alias("binding"))
    if "memory_regions" in p.columns and "base_address" in m.columns:
        held = found_in(p.filter("memory_regions <> ''").select("evidence_id", F.col("memory_regions").alias("text")), m.filter("base_address <> ''").select("evidence_id", F.col("base_address").alias("part")))
        held = held.select("evidence_id", F.col("text").alias("memory_regions"), F.col("part").alias("base_address"))
        by_base = sides(p, "a").join(held, ["evidence_id", "memory_regions"]).join(sides(m, "b"), ["evidence_id", "base_address"])
        by_base = by_base.join(pairs.select("evidence_id", "artifact_id_a", "artifact_id_b"), ["evidence_id", "artifact_id_a", "artifact_id_b"], "left_anti")
        pairs = pairs.unionByName(by_base.select("evidence_id", "artifact_id_a", "artifact_id_b", F.lit(False).alias("exact"), F.lit("base_address_binding").alias("binding")))
    pairs = pairs.withColumnRenamed("evidence_id", "evidence_id_a")
    return edges(pairs, "PROCESS_MODULE", "MEDIUM", F.col("exact"), F.col("binding"))


def shared(artifacts: DataFrame, key: str, kind: str) -> DataFrame:
    """Artifacts of one evidence that share a key (an execution, a plugin)."""
    pairs = pairs_on(artifacts, artifacts, F.col(f"{key}_a") == F.col(f"{key}_b")).filter("artifact_id_a < artifact_id_b")
    return edges(pairs, kind, "LOW", F.col(f"{key}_a").alias("value"))


def shared_counts(artifacts: DataFrame, key: str, kind: str) -> DataFrame:
    """relation, evidence_id, value, n: how many pairs of artifacts share a key, from the number that has it. No pair is made."""
    held = artifacts.filter(F.col(key).isNotNull()).groupBy("evidence_id", F.col(key).alias("value")).agg(F.count("*").alias("k"))
    return held.filter("k > 1").select(F.lit(kind).alias("relation"), "evidence_id", "value", F.expr("k * (k - 1) DIV 2").alias("n"))


def same_evidence(processes: DataFrame, modules: DataFrame) -> DataFrame:
    """Every process with every module of an evidence: off unless asked for, as its size is their product."""
    return edges(pairs_on(processes, modules, F.lit(True)), "SAME_EVIDENCE", "LOW")


def near_in_time(processes: DataFrame, window: float) -> DataFrame:
    rows = processes.withColumn("ts_us", F.col("created_us")).withColumn("ts_class", F.when(F.col("created_us").isNull(), 2).otherwise(0))
    pairs = band_join(sided(rows, "a"), sided(rows, "b"), ["evidence_id"], window).filter("artifact_id_a < artifact_id_b")
    return edges(pairs, "TEMPORAL_PROXIMITY", "LOW", (F.abs(F.col("created_us_a") - F.col("created_us_b")) / F.lit(1_000_000.0)).alias("delta_seconds"))


def filtered(links: DataFrame, relations: list[str] | None = None, confidence: str | None = None, evidence: str | None = None, participant: str | None = None) -> DataFrame:
    out = links.filter(F.col("relation").isin(relations)) if relations else links
    out = out.filter(F.col("confidence") == confidence) if confidence else out
    out = out.filter(F.col("evidence_id") == evidence) if evidence else out
    return out.filter((F.col("from_id") == participant) | (F.col("to_id") == participant)) if participant else out


def with_ids(links: DataFrame) -> DataFrame:
    return links.withColumn("edge_id", ids.edge_id(F.col("relation"), F.col("from_id"), F.col("to_id")))


def events(processes: DataFrame) -> DataFrame:
    """Creation events of processes; those without a time are observed without one."""
    kind = F.when(F.col("created_us").isNotNull(), "process_created").otherwise("process_observed")
    return processes.select(
        ids.uuid5(ids.namespace("memory-event"), ids.joined(F.col("artifact_id"), kind)).alias("event_id"), F.when(F.col("created_us").isNotNull(), 0).otherwise(2).alias("ts_class"), F.col("created_us").alias("ts_us"),
        F.lit("memory").alias("category"), kind.alias("event_type"), F.concat(F.lit("process "), F.col("name"), F.lit(" pid "), F.col("pid").cast("string")).alias("description"), F.col("evidence_id").alias("source_path"), F.col("artifact_id").alias("source_artifact_id"), "pid", "name",
    )


def triage(processes: DataFrame, sockets: DataFrame) -> DataFrame:
    """How many links of each relation each evidence has, from counts of equal keys: no pair is made."""
    alive = processes.filter("evidence_id is not null")
    by_pid = alive.filter("pid is not null").groupBy("evidence_id", "pid").agg(F.count("*").alias("n"))
    children = alive.filter("ppid > 0").groupBy("evidence_id", F.col("ppid").alias("pid")).agg(F.count("*").alias("k"), F.count_if(F.col("pid") == F.col("ppid")).alias("own"))
    ends = sockets.filter("evidence_id is not null and pid > 0").groupBy("evidence_id", "pid").agg(F.count("*").alias("k"))
    runs = alive.filter("execution_id is not null").groupBy("evidence_id", "execution_id").agg(F.count("*").alias("n"))
    pairs = F.expr("sum(n * (n - 1) DIV 2)")
    parts = [
        ("PARENT_CHILD_PROCESS", children.join(by_pid, ["evidence_id", "pid"]), F.sum(F.col("k") * F.col("n") - F.col("own"))),
        ("PROCESS_NETWORK_SOCKET", ends.join(by_pid, ["evidence_id", "pid"]), F.sum(F.col("k") * F.col("n"))),
        ("PROCESS_PID_MATCH", by_pid, pairs),
        ("SHARED_EXECUTION_PROVENANCE", runs, pairs),
    ]
    every = [rows.groupBy("evidence_id").agg(total.alias("n")).select("evidence_id", F.lit(kind).alias("relation"), "n") for kind, rows, total in parts]
    return reduce(lambda a, b: a.unionByName(b), every).filter("n > 0")


def _observed(rows: DataFrame, kind: str, *fields: str) -> DataFrame:
    """Artifacts without a time of their own as events."""
    return rows.select(
        ids.uuid5(ids.namespace("memory-event"), ids.joined(F.col("artifact_id"), F.lit(kind))).alias("event_id"), F.lit(2).alias("ts_class"), F.lit(None).cast("long").alias("ts_us"),
        F.lit("memory").alias("category"), F.lit(kind).alias("event_type"), F.col("evidence_id").alias("source_path"), F.col("artifact_id").alias("source_artifact_id"), *fields,
    )


def socket_events(sockets: DataFrame) -> DataFrame:
    return _observed(sockets, "socket_observed", "protocol", "local_port", "state", "pid")


def module_events(modules: DataFrame) -> DataFrame:
    return _observed(modules, "module_observed", "name", "path")


def timeline(processes: DataFrame, sockets: DataFrame, modules: DataFrame) -> DataFrame:
    """All memory events; fields of another kind are null."""
    return events(processes).drop("description").unionByName(socket_events(sockets), allowMissingColumns=True).unionByName(module_events(modules), allowMissingColumns=True)


def timeline_edges(links: DataFrame, memory_events: DataFrame) -> DataFrame:
    """Links of artifacts as edges of their events."""
    of = memory_events.select("event_id", "source_artifact_id")
    a = of.select(F.col("event_id").alias("event_a"), F.col("source_artifact_id").alias("from_id"))
    b = of.select(F.col("event_id").alias("event_b"), F.col("source_artifact_id").alias("to_id"))
    none = F.lit(None).cast("long")
    return links.join(a, "from_id").join(b, "to_id").select("relation", "event_a", "event_b", F.lit(None).cast("double").alias("delta_seconds"), none.alias("start_us"), none.alias("end_us"))
