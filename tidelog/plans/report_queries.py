"""Queries over the stored pivot index and the report of an investigation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.shared import new_path
from tidelog.operators import correlate, investigation, pivots, rules, timeline
from tidelog.plans.registry import Registry
from tidelog.plans.views import view
from tidelog.sources import memory as tools

REGISTRY = Registry()
QUERIES, SQL = REGISTRY.queries, REGISTRY.sql
query = REGISTRY.query

#: Events, timed links of users, and detections of one rule, as the report and the index have them.
FOUND = """e AS (SELECT * FROM timeline WHERE event_id NOT LIKE '%b'), links AS (
  SELECT least(a.event_id, b.event_id) AS event_a, greatest(a.event_id, b.event_id) AS event_b, a.username AS value, least(a.ts_us, b.ts_us) AS start_us, greatest(a.ts_us, b.ts_us) AS end_us FROM e a JOIN e b
  ON a.event_id < b.event_id AND a.username = b.username AND a.ts_class = b.ts_class AND a.ts_class <> 2 AND abs(a.ts_us - b.ts_us) <= 300000000
), hits AS (SELECT event_id, ts_us FROM e WHERE event_type = 'sudo_command' AND username = 'u7')"""
PIVOTS = f"""{FOUND}, catalogue_ids AS (SELECT doc_id, sha256 FROM catalogue), procs AS (SELECT DISTINCT evidence_id, plugin, pid_upper, image_name, created_sec, execution_id, ppid_text, image_path FROM mem_processes WHERE pid_mixed IS NULL), x AS (
  SELECT 'event' AS field, event_id AS value, CAST(NULL AS VARCHAR) AS namespace, source_path AS scope, 'event' AS kind FROM e UNION ALL SELECT 'artifact', source_artifact_id, 'source_artifact_id', source_path, 'event' FROM e
  UNION ALL SELECT 'ip', source_ip, NULL, source_path, 'event' FROM e UNION ALL SELECT 'user', username, NULL, source_path, 'event' FROM e
  UNION ALL SELECT 'event', event_a, NULL, NULL, 'link' FROM links UNION ALL SELECT 'event', event_b, NULL, NULL, 'link' FROM links UNION ALL SELECT 'artifact', 'L', 'correlation_id', NULL, 'link' FROM links
  UNION ALL SELECT 'rule', 'R', NULL, NULL, 'detection' FROM hits UNION ALL SELECT 'event', event_id, NULL, NULL, 'detection' FROM hits
  UNION ALL SELECT 'sha256', sha256, NULL, 'image', 'file' FROM catalogue_ids UNION ALL SELECT 'artifact', 'F', 'unified_id', 'image', 'file' FROM catalogue_ids
  UNION ALL SELECT 'pid', pid_upper, NULL, evidence_id, 'process' FROM procs UNION ALL SELECT 'artifact', 'P', 'payload_artifact_id', evidence_id, 'process' FROM procs UNION ALL SELECT 'artifact', evidence_id, 'evidence_id', evidence_id, 'process' FROM procs
)"""


def _found(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    events = timeline.deduplicate(view(spark, sf, "timeline"))
    links = correlate.with_ids(correlate.same_user(events, untimed=False))
    rule = rules.Rule("sudo of u7", event_types=("sudo_command",), conditions=(rules.Condition("username", "equals", "u7"),))
    return events, links, rules.evaluate(events, [rule])


def _index(spark, sf) -> DataFrame:
    events, links, detections = _found(spark, sf)
    files = view(spark, sf, "catalogue").select(F.col("doc_id").cast("string").alias("artifact_id"), F.upper("sha256").alias("sha256"), F.lit("image").alias("image"))
    processes = tools.process_artifacts(view(spark, sf, "mem_processes"))
    return pivots.union(pivots.of_events(events, "source_path"), pivots.of_links(links), pivots.of_detections(detections), pivots.of_files(files, "image"), pivots.of_processes(processes))


def _written(spark, sf) -> DataFrame:
    path = new_path(spark, "pivots")
    pivots.write(_index(spark, sf), path)
    return pivots.read(spark, path)


@query("pivot_index", f"WITH {PIVOTS} SELECT field, kind, namespace, count(*) AS n, count(DISTINCT scope) AS scopes FROM x GROUP BY field, kind, namespace", "timeline", "catalogue", "mem_processes")
def pivot_index(spark, sf):
    """The stored index, counted by field, kind and namespace."""
    return _written(spark, sf).groupBy("field", "kind", "namespace").agg(F.count("*").alias("n"), F.count_distinct("scope").alias("scopes"))


LOOKUPS = [
    ("event", {"field": "event", "value": " 1007 "}), ("user in scope", {"field": "user", "value": "u7", "scope": "var/log/f7.log", "most": 5}), ("address", {"field": "ip", "value": "10.0.0.7", "kind": "event"}),
    ("pid of evidence", {"field": "pid", "value": "25", "scope": "MEM-0"}), ("evidence by prefix", {"field": "artifact", "value": "evidence_id:MEM-1", "most": 3}), ("source artifact", {"field": "artifact", "value": "A7", "namespace": "source_artifact_id", "most": 4}),
]


@query("pivot_lookups", f"""WITH {PIVOTS}, w AS (
  SELECT 'event' AS asked, x.* FROM x WHERE field = 'event' AND value = '1007' UNION ALL SELECT 'user in scope', x.* FROM x WHERE field = 'user' AND value = 'u7' AND scope = 'var/log/f7.log' UNION ALL SELECT 'address', x.* FROM x WHERE field = 'ip' AND value = '10.0.0.7'
  UNION ALL SELECT 'pid of evidence', x.* FROM x WHERE field = 'pid' AND value = '25' AND scope = 'MEM-0' UNION ALL SELECT 'evidence by prefix', x.* FROM x WHERE value = 'MEM-1' AND namespace = 'evidence_id' UNION ALL SELECT 'source artifact', x.* FROM x WHERE value = 'A7'
), most AS (SELECT * FROM (VALUES ('event', 1000), ('user in scope', 5), ('address', 1000), ('pid of evidence', 1000), ('evidence by prefix', 3), ('source artifact', 4)) AS v(asked, most))
SELECT asked, any_value(field) AS field, any_value(value) AS value, least(count(*), any_value(most)) AS given, count(*) AS total, count(*) > any_value(most) AS truncated FROM w JOIN most USING (asked) GROUP BY asked""", "timeline", "catalogue", "mem_processes")
def pivot_lookups(spark, sf):
    """Look-ups in the stored index: how many references each gives, and how many there are."""
    table = _written(spark, sf)
    parts = [pivots.find(table, **how).groupBy("field", "value", "total", "truncated").agg(F.count("*").alias("given")).withColumn("asked", F.lit(name)) for name, how in LOOKUPS]
    return reduce(lambda a, b: a.unionByName(b), parts).select("asked", "field", "value", "given", "total", "truncated")


EVENT_LINE = ", ".join(f"{c} := {c}" for c in sorted(timeline.COLUMNS))


@query("investigation_report", f"""WITH {FOUND}, lines AS (
  SELECT row_number() OVER (ORDER BY ts_class, coalesce(ts_us, 0), source_path, source_line, source_artifact_id, source_event_id, event_type, description, event_id) AS position, CAST(to_json(struct_pack(case_id := 'C1', {EVENT_LINE})) AS VARCHAR) AS line FROM e
) SELECT 'events' AS section, (position - 1) // {investigation.ROWS} AS chunk, count(*) AS n_lines, sha256(string_agg(line || chr(10), '' ORDER BY position)) AS sha256 FROM lines GROUP BY ALL
UNION ALL SELECT 'links', i // {investigation.ROWS}, count(*), NULL FROM (SELECT unnest(range(count(*))) AS i FROM links) GROUP BY ALL UNION ALL SELECT 'detections', i // {investigation.ROWS}, count(*), NULL FROM (SELECT unnest(range(count(*))) AS i FROM hits) GROUP BY ALL
UNION ALL SELECT 'summary', 0, (SELECT 1 + count(DISTINCT category) + count(DISTINCT ts_class) FROM e) + 4, NULL""", "timeline")
def investigation_report(spark, sf):
    """The report, written and read back: lines of each section and chunk, and the digest of the events' bytes."""
    path = new_path(spark, "report")
    investigation.write_report(investigation.report_lines(*_found(spark, sf), case="C1"), path)
    lines = investigation.read_report(spark, path).withColumn("position", F.monotonically_increasing_id())  # a chunk is one file, read in order
    out = investigation.digests(lines)
    return out.withColumn("sha256", F.when(F.col("section") == "events", F.col("sha256")))
