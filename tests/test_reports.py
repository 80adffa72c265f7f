"""The report of an investigation as bytes, and look-ups in the stored pivot index."""

import glob
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tests.test_links import random_events
from tidelog.operators import correlate, investigation, pivots, rules


def found(spark, seed=3, n=90, parts=4):
    _, events = random_events(spark, seed, n)
    events = events.repartition(parts)
    links = correlate.with_ids(correlate.same_user(events, untimed=False))
    return events, links, rules.evaluate(events, [rules.Rule("sudo", event_types=("sudo_command",))])


def bytes_of(path):
    files = sorted(glob.glob(f"{path}/section=*/chunk=*/*.txt"), key=lambda f: (f.split("section=")[1].split("/")[0], int(f.split("chunk=")[1].split("/")[0])))
    return b"".join(open(f, "rb").read() for f in files), len(files)


@pytest.mark.parametrize("rows", [7, 20_000])
def test_report_is_the_same_bytes_however_it_is_partitioned(spark, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(investigation, "ROWS", rows)
    out = []
    for k, parts in enumerate((1, 9)):
        lines = investigation.report_lines(*found(spark, parts=parts), case="C")
        spark.conf.set("spark.sql.shuffle.partitions", str(3 + 4 * k))
        try:
            investigation.write_report(lines, str(tmp_path / str(k)))
            out.append((bytes_of(tmp_path / str(k)), sorted(map(tuple, investigation.digests(lines).collect()))))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out[0] == out[1]
    whole = [json.loads(x) for x in out[0][0][0].decode().splitlines()]
    assert out[0][0][1] == len(out[0][1]) and all(x["case_id"] == "C" for x in whole)
    events, links, detections = found(spark)
    assert [x["event_id"] for x in whole if "category" in x] == [r.event_id for r in investigation.timeline.order(events).collect()]
    told = {(x["section"], x["name"]): x["n"] for x in whole if "n" in x}
    assert told[("events", "all")] == 90 and told[("links", "all")] == links.count() == sum("edge_id" in x for x in whole) and told[("detections", "rule sudo")] == detections.count() > 5
    one = sorted(r.line for r in investigation.read_report(spark, str(tmp_path / "0")).filter("section = 'events' and chunk = 0").collect())
    first = next(d for d in out[0][1] if d[0] == "events" and d[1] == 0)
    assert first[2] == len(one) and first[3] == hashlib.sha256("".join(json.dumps(x, separators=(",", ":"), ensure_ascii=False) + "\n" for x in [w for w in whole if "category" in w][: first[2]]).encode()).hexdigest()


def index_of(spark):
    events = spark.createDataFrame([(f"e{k}", "A1" if k < 5 else "same", f"10.0.0.{k % 3}", f"u{k % 2} ", f"h{k % 2}") for k in range(9)], "event_id string, source_artifact_id string, source_ip string, username string, host string")
    processes = spark.createDataFrame([("E1", "p1", 7), ("E2", "p2", 7), ("E2", "same", -1), ("E2", "p4", None)], "evidence_id string, artifact_id string, pid int")
    files = spark.createDataFrame([("f1", "AB" * 32), ("f2", "short"), ("f3", None)], "artifact_id string, sha256 string")
    reports = spark.createDataFrame([("r1", " C-1 "), ("r2", None)], "report_id string, case_id string")
    return pivots.union(pivots.of_events(events, "host"), pivots.of_processes(processes), pivots.of_files(files), pivots.of_reports(reports))


def refs(table, *args, **more):
    return [(r.kind, r.ref) for r in pivots.find(table, *args, **more).collect()]


@pytest.mark.parametrize("stored", [False, True])
def test_look_ups(spark, tmp_path, stored):
    table = index_of(spark)
    if stored:
        pivots.write(table, str(tmp_path / "index"))
        table = pivots.read(spark, str(tmp_path / "index"))
    assert refs(table, "pid", "7", scope="E2") == [("process", "p2")] and refs(table, "pid", "07", kind="process") == [("process", "p1"), ("process", "p2")]
    assert refs(table, "sha256", " " + "ab" * 32) == [("file", "f1")] and refs(table, "sha256", "short") == [] and refs(table, "case", "C-1") == [("report", "r1")]
    assert refs(table, "artifact", "same") == [] and refs(table, "artifact", "same", namespace="payload_artifact_id") == [("process", "same")]
    assert refs(table, "artifact", "source_artifact_id:same") == [("event", f"e{k}") for k in range(5, 9)] and refs(table, "artifact", "evidence_id: E1") == [("process", "p1")]
    assert refs(table, "user", "u1", scope="h1") == [("event", f"e{k}") for k in (1, 3, 5, 7)] and refs(table, "user", "u1", scope="h0") == []
    cut = pivots.find(table, "ip", "10.0.0.1", most=2).collect()
    assert [(r.ref, r.total, r.truncated) for r in cut] == [("e1", 3, True), ("e4", 3, True)]
    assert refs(table, "event", "nothing") == [] and refs(table, "event", "") == []
    for bad in ({"field": "pid", "value": "7"}, {"field": "colour", "value": "x"}, {"field": "ip", "value": "x", "most": 0}):
        with pytest.raises(ValueError):
            pivots.find(table, **bad)


def test_a_look_up_reads_one_folder(spark, tmp_path):
    rows = spark.range(20_000).select(F.lit("event").alias("field"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), "id")).alias("value"))
    rows = rows.select("field", "value", F.col("value").alias("observed"), F.lit(None).cast("string").alias("namespace"), F.lit(None).cast("string").alias("scope"), F.lit("event").alias("kind"), F.monotonically_increasing_id().cast("string").alias("ref"))
    pivots.write(rows, str(tmp_path / "index"))
    table = pivots.read(spark, str(tmp_path / "index"))
    found = pivots.find(table, "event", "v1", most=5)
    assert [r.total for r in found.collect()] == [1] and pivots.find(table, "event", "hot", most=1).first().total == 6667
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(field" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0] and "EqualTo(value,v1)" in plan
    at = table.filter(F.col("value") == "v1").select("field", "bucket").distinct().collect()
    assert len(at) == 1 and table.inputFiles() and sum(f"bucket={at[0].bucket}/" in f for f in table.inputFiles()) < len(table.inputFiles()) / 30
