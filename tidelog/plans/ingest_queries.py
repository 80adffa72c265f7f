"""Queries over what comes in: lines that try to hide, numbered lines, documents of memory tools."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions.shared import new_path
from tidelog.operators import memory_timeline, rules
from tidelog.plans.registry import Registry
from tidelog.plans.views import view
from tidelog.sources import files, lines, logs, memory_documents, memory_sockets
from tidelog.streaming import lanes

REGISTRY = Registry()
QUERIES, SQL = REGISTRY.queries, REGISTRY.sql
query = REGISTRY.query


HOSTILE = r"""WITH m AS (
  SELECT source_path, line_number, regexp_extract(line, '^\S+\s+\S+\s+([^:\[\s]+)', 1) AS service, regexp_extract(line, '^\S+\s+\S+\s+[^:\[\s]+(\[\d+\])?:\s*((?s:.*))$', 2) AS message FROM hostile_lines
), k AS (
  SELECT *, regexp_extract(message, '^Failed\s+(\S+)\s+for\s+invalid\s+user\s+(\S+)\s+from\s+(\S+)\s+port\s+(\d+)', ['method', 'who', 'ip', 'port']) AS invalid,
    regexp_extract(message, '^Failed\s+(\S+)\s+for\s+(\S+)\s+from\s+(\S+)\s+port\s+(\d+)', ['method', 'who', 'ip', 'port']) AS failed,
    regexp_extract(message, '^Accepted\s+(\S+)\s+for\s+(\S+)\s+from\s+(\S+)\s+port\s+(\d+)', ['method', 'who', 'ip', 'port']) AS accepted,
    regexp_extract(message, '^\s*(\S+)\s*:\s*TTY=(\S+)\s*;\s*PWD=(\S+)\s*;\s*USER=(\S+)\s*;\s*COMMAND=((?s:.*))$', ['who', 'tty', 'pwd', 'target', 'command']) AS su,
    regexp_extract(message, 'session opened for user\s+(\S+)', 1) AS opened FROM m
)
SELECT line_number, service, message, CASE WHEN service = 'sshd' AND accepted.who <> '' THEN 'ssh_login_success' WHEN service = 'sshd' AND invalid.who <> '' THEN 'ssh_invalid_user' WHEN service = 'sshd' AND failed.who <> '' THEN 'ssh_login_failure'
    WHEN service = 'sudo' AND su.who <> '' THEN 'sudo_command' WHEN opened <> '' THEN 'session_open' ELSE 'generic_syslog' END AS event_type,
  CASE service WHEN 'sshd' THEN coalesce(nullif(accepted.who, ''), nullif(invalid.who, ''), failed.who) WHEN 'sudo' THEN su.who ELSE nullif(opened, '') END AS username,
  CASE WHEN service = 'sshd' THEN coalesce(nullif(accepted.ip, ''), nullif(invalid.ip, ''), failed.ip) END AS src_ip, CASE WHEN service = 'sudo' THEN su.command END AS command
FROM k"""


@query("hostile_lines", HOSTILE, "hostile_lines")
def hostile_lines(spark, sf):
    """Lines with control characters, tabs and letters beyond ASCII in users, commands and messages."""
    rows = logs.parse_logs(view(spark, sf, "hostile_lines"))
    return rows.select("line_number", "service", "message", "event_type", F.col("user").alias("username"), "src_ip", "command")


@query("lines_numbered", "SELECT count(*) AS n_lines, count(DISTINCT line) AS n_distinct, CAST(0 AS BIGINT) AS misplaced, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM log_lines", "log_lines")
def lines_numbered(spark, sf):
    """Log lines written as text files and read back with numbers. A line begins with its number in the table; a file holds a run of them."""
    path = new_path(spark, "text")
    rows = view(spark, sf, "log_lines").select("line_number", F.concat_ws(" ", "line_number", "line").alias("value"))
    rows.repartitionByRange("line_number").sortWithinPartitions("line_number").select("value").write.text(path)
    read = lines.read_lines(spark, path).withColumn("own", F.split_part("line", F.lit(" "), F.lit(1)).cast("long"))
    of_file = read.groupBy("source_path").agg(
        F.count("*").alias("n"), F.count_distinct("line").alias("d"), F.sum(F.length("line") - F.length(F.col("own").cast("string")) - 1).alias("c"), F.min(F.col("own") - F.col("line_number")).alias("lo"), F.max(F.col("own") - F.col("line_number")).alias("hi")
    )
    totals = of_file.agg(F.sum("n").alias("n_lines"), F.sum("d").alias("_d"), F.count_if(F.col("lo") != F.col("hi")).alias("misplaced"), F.sum("c").alias("n_chars"))
    distinct = read.select(F.expr("substr(line, instr(line, ' ') + 1)").alias("text")).agg(F.count_distinct("text").alias("n_distinct"))
    return totals.drop("_d").crossJoin(distinct)  # a row each


SLICES = 3
DELAY_S = 3600
#: Three deliveries: the first half of a month, the rest, and what both left out, most of it late.
LANES = f"""WITH r AS (
  SELECT line_number, line LIKE 'garbage%' AS bad, CASE WHEN line NOT LIKE 'garbage%' THEN epoch_us(CAST(substr(line, 1, 26) AS TIMESTAMP)) END AS us, CASE WHEN line_number % 20 = 0 THEN 2 WHEN line NOT LIKE 'garbage%' AND substr(line, 9, 2) < '15' THEN 0 ELSE 1 END AS slice FROM log_lines
), m AS (SELECT slice, max(max(us)) OVER (ORDER BY slice) - {DELAY_S}000000 AS mark FROM r GROUP BY slice)
SELECT r.slice AS batch, CASE WHEN bad THEN 'untimed' WHEN us <= mark THEN 'late' ELSE 'on_time' END AS lane, count(*) AS n, CAST(coalesce(sum(us // 1000000), 0) AS BIGINT) AS seconds FROM r LEFT JOIN m ON m.slice = r.slice - 1 GROUP BY ALL"""


@query("log_stream_lanes", LANES, "log_lines")
def log_stream_lanes(spark, sf):
    """Three deliveries of log files to a stream: rows on time, late and untimed by batch."""
    folder, out, checkpoint = (new_path(spark, k) for k in ("inbox", "lanes", "progress"))
    rows = view(spark, sf, "log_lines").withColumn("slice", F.when(F.col("line_number") % 20 == 0, 2).when(~F.col("line").startswith("garbage") & (F.substring("line", 9, 2) < "15"), 0).otherwise(1))
    for k in range(SLICES):
        rows.filter(F.col("slice") == k).select(F.col("line").alias("value")).write.mode("append").text(folder)
        lanes.ingest_logs(spark, folder, out, checkpoint, DELAY_S)
    every = spark.read.parquet(out)
    return every.groupBy(F.col("batch").cast("int").alias("batch"), "lane").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.floor(F.col("ts_us") / 1_000_000)), F.lit(0)).alias("seconds"))


#: Objects of the documents, parsed as JSON; a text with only a beginning is no document.
OBJECTS = r"""docs AS (SELECT source, value, CASE WHEN json_valid(value) THEN json_type(value) END AS t FROM mem_documents), listed AS (
  SELECT source, CASE WHEN t = 'ARRAY' THEN CAST(value AS JSON[]) WHEN json_type(value, '$.artifacts') = 'ARRAY' THEN CAST(json_extract(value, '$.artifacts') AS JSON[]) ELSE [CAST(value AS JSON)] END AS os FROM docs WHERE t IS NOT NULL
), each AS (
  SELECT source, CAST(i - 1 AS INT) AS position, os[i] AS j FROM (SELECT source, os, unnest(range(1, len(os) + 1)) AS i FROM listed)
), kinds AS (
  SELECT *, CASE WHEN json_type(j) <> 'OBJECT' THEN NULL WHEN j->>'artifact_id' LIKE 'MEMPROC-%' THEN 'process' WHEN j->>'artifact_id' LIKE 'MEMMOD-%' THEN 'module' WHEN j->>'artifact_id' LIKE 'MEMNET-%' THEN 'socket' WHEN j->>'event_id' LIKE 'MEMEVT-%' THEN 'event'
    WHEN json_exists(j, '$.module_name') THEN 'module' END AS kind FROM each
), o AS (
  SELECT source, position, kind, CASE WHEN json_type(j) <> 'OBJECT' THEN 'NO_OBJECT' WHEN kind IS NULL THEN 'UNKNOWN_SHAPE' WHEN kind = 'module' AND j->>'artifact_id' = 'x' THEN 'INVALID_ID' WHEN kind = 'process' AND j->>'process_name' = '' THEN 'MISSING_NAME'
      WHEN kind = 'process' AND CAST(j->>'pid' AS BIGINT) < 0 THEN 'INVALID_PID' WHEN kind = 'socket' AND CAST(j->>'local_port' AS BIGINT) > 65535 THEN 'INVALID_PORT' END AS reason,
    j->>'evidence_id' AS evidence_id, j->>'artifact_id' AS artifact_id, j->>'event_id' AS event_id, CAST(j->>'pid' AS BIGINT) AS pid, CAST(j->>'ppid' AS BIGINT) AS ppid, j->>'process_name' AS process_name, j->>'module_name' AS module_name, j->>'protocol' AS protocol,
    CAST(j->>'local_port' AS BIGINT) AS local_port, CAST(j->>'size_bytes' AS BIGINT) AS size_bytes, j->>'driver_path' AS driver_path, j->>'execution_id' AS execution_id, j->>'created_at' AS created_at, j->>'exit_time' AS exit_time, coalesce(CAST(j->>'$.source_row_indices[0]' AS BIGINT), 0) AS source_row,
    j->>'$.raw_attributes.ImagePath' AS image_path FROM kinds
  UNION ALL SELECT source, NULL, NULL, 'UNREADABLE_DOCUMENT', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 0, NULL FROM docs WHERE t IS NULL
)"""
#: Events of accepted objects, before and after duplicates go.
EVENTS = """made AS (
  SELECT evidence_id, coalesce(artifact_id, '') AS artifact_id, kind, 'process_created' AS event_type, CASE WHEN created_at LIKE '%Z' THEN 0 ELSE 1 END AS ts_class, epoch_us(CAST(replace(created_at, 'Z', '') AS TIMESTAMP)) AS ts_us, process_name AS name, pid, local_port, source_row FROM o WHERE reason IS NULL AND kind = 'process' AND created_at IS NOT NULL
  UNION ALL SELECT evidence_id, artifact_id, kind, 'process_exited', 0, epoch_us(CAST('2024-01-19 22:00:00.5' AS TIMESTAMP)), process_name, pid, local_port, source_row FROM o WHERE reason IS NULL AND kind = 'process' AND exit_time <> 'n/a'
  UNION ALL SELECT evidence_id, artifact_id, kind, 'process_observed', 2, NULL, process_name, pid, local_port, source_row FROM o WHERE reason IS NULL AND kind = 'process' AND created_at IS NULL AND exit_time = 'n/a'
  UNION ALL SELECT evidence_id, artifact_id, kind, 'socket_observed', 2, NULL, NULL, pid, local_port, source_row FROM o WHERE reason IS NULL AND kind = 'socket'
  UNION ALL SELECT evidence_id, artifact_id, kind, 'module_observed', 2, NULL, module_name, pid, local_port, source_row FROM o WHERE reason IS NULL AND kind = 'module'
  UNION ALL SELECT evidence_id, '', kind, 'kept', 0, epoch_us(TIMESTAMP '2024-02-01'), NULL, pid, local_port, source_row FROM o WHERE reason IS NULL AND kind = 'event'
), ev AS (SELECT evidence_id, artifact_id, kind, event_type, ts_class, ts_us, name, pid, local_port, source_row, count(*) AS n FROM made GROUP BY ALL)"""


def _objects(spark, sf):
    return memory_documents.load(view(spark, sf, "mem_documents"))


@query("memory_documents", f"WITH {OBJECTS} SELECT source, position, kind, reason, artifact_id, event_id, evidence_id, pid, ppid, nullif(process_name, '') AS process_name, module_name, protocol, local_port, size_bytes, driver_path, execution_id FROM o", "mem_documents")
def documents_of_memory(spark, sf):
    """Every object of every document by its kind, or with the reason why not."""
    columns = ["source", "position", "kind", "reason", "artifact_id", "event_id", "evidence_id", "pid", "ppid", "process_name", "module_name", "protocol", "local_port", "size_bytes", "driver_path", "execution_id"]
    return _objects(spark, sf).select(columns)


@query("memory_timeline", f"WITH {OBJECTS}, {EVENTS} SELECT CAST(ts_class AS INT) AS ts_class, ts_us, kind, event_type, evidence_id, artifact_id, name, pid, source_row, n FROM ev ORDER BY ts_class, coalesce(ts_us, 0), evidence_id, artifact_id, source_row, event_type", "mem_documents")
def memory_timeline_of_documents(spark, sf):
    """The memory timeline in order, each event with how many there were alike."""
    return memory_timeline.reconstruct(_objects(spark, sf)).select("ts_class", "ts_us", "kind", "event_type", "evidence_id", "artifact_id", "name", "pid", "source_row", "n")


RULES = [rules.memory_process_rule("p3"), rules.memory_socket_rule(1005), rules.memory_module_rule(path_prefix="/lib/m1")]


@query("memory_triage_full", f"""WITH {OBJECTS}, {EVENTS}, one AS (SELECT DISTINCT evidence_id, artifact_id, kind, pid, ppid, execution_id, image_path, driver_path FROM o WHERE reason IS NULL), p AS (SELECT * FROM one WHERE kind = 'process')
SELECT evidence_id, 'objects' AS measure, kind AS name, count(*) AS n FROM o WHERE reason IS NULL GROUP BY ALL UNION ALL SELECT evidence_id, 'refused', reason, count(*) FROM o WHERE reason IS NOT NULL AND evidence_id IS NOT NULL GROUP BY ALL
UNION ALL SELECT evidence_id, 'events', 'all', count(*) FROM ev GROUP BY ALL UNION ALL SELECT evidence_id, 'duplicates', 'all', CAST(sum(n - 1) AS BIGINT) FROM ev GROUP BY ALL
UNION ALL SELECT evidence_id, 'class', CASE ts_class WHEN 0 THEN 'aware' WHEN 1 THEN 'naive' ELSE 'unanchored' END, count(*) FROM ev GROUP BY ALL UNION ALL SELECT evidence_id, 'event_type', event_type, count(*) FROM ev GROUP BY ALL
UNION ALL SELECT a.evidence_id, 'links', 'PARENT_CHILD_PROCESS', count(*) FROM p a JOIN p b ON a.evidence_id = b.evidence_id AND a.ppid = b.pid AND a.ppid > 0 AND a.artifact_id <> b.artifact_id GROUP BY ALL
UNION ALL SELECT a.evidence_id, 'links', 'PROCESS_NETWORK_SOCKET', count(*) FROM p a JOIN one b ON a.evidence_id = b.evidence_id AND b.kind = 'socket' AND b.pid = a.pid AND b.pid > 0 GROUP BY ALL
UNION ALL SELECT a.evidence_id, 'links', 'PROCESS_PID_MATCH', count(*) FROM p a JOIN p b ON a.evidence_id = b.evidence_id AND a.pid = b.pid AND a.artifact_id < b.artifact_id GROUP BY ALL
UNION ALL SELECT a.evidence_id, 'links', 'SHARED_EXECUTION_PROVENANCE', count(*) FROM p a JOIN p b ON a.evidence_id = b.evidence_id AND a.execution_id = b.execution_id AND a.artifact_id < b.artifact_id GROUP BY ALL
UNION ALL SELECT a.evidence_id, 'links', 'PROCESS_MODULE', count(*) FROM p a JOIN one b ON a.evidence_id = b.evidence_id AND b.kind = 'module' AND (ends_with(a.image_path, b.driver_path) OR ends_with(b.driver_path, a.image_path)) GROUP BY ALL
UNION ALL SELECT evidence_id, 'rule', 'Memory process name', count(*) FROM ev WHERE event_type IN ('process_created', 'process_observed') AND name = 'p3' GROUP BY ALL
UNION ALL SELECT evidence_id, 'rule', 'Memory socket', count(*) FROM ev WHERE event_type = 'socket_observed' AND local_port = 1005 GROUP BY ALL
UNION ALL SELECT evidence_id, 'rule', 'Memory module', count(*) FROM ev WHERE event_type = 'module_observed' AND name LIKE 'm1%' GROUP BY ALL""", "mem_documents")
def memory_triage_full(spark, sf):
    """All that is told of each evidence."""
    return memory_timeline.triage(_objects(spark, sf), RULES)


DOCS_A_FILE = 100


@query("files_catalogued", f"SELECT doc_id // {DOCS_A_FILE} AS part, 'collected' AS status, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS size_bytes, md5(string_agg(text || chr(10), '' ORDER BY doc_id)) AS md5, sha256(string_agg(text || chr(10), '' ORDER BY doc_id)) AS sha256 FROM documents GROUP BY ALL")
def files_catalogued(spark, sf):
    """Texts of documents written as files of a hundred each, catalogued with their digests."""
    root = new_path(spark, "evidence")
    docs = view(spark, sf, "documents").select(F.floor(F.col("doc_id") / DOCS_A_FILE).alias("part"), "doc_id", F.col("text").alias("value"))
    docs.repartition("part").sortWithinPartitions("part", "doc_id").drop("doc_id").write.partitionBy("part").text(root)
    found = files.catalogue(spark, root).filter(F.col("relative_path").endswith(".txt"))
    part = F.regexp_extract("relative_path", r"part=(\d+)/", 1).cast("long")
    return found.select(part.alias("part"), "status", "size_bytes", "md5", "sha256")


#: Sockets under the column names of two tools: ports inside addresses, brackets, stars, columns that disagree.
TOOL = """s AS (
  SELECT evidence_id, row_index AS k, row_index % 2 = 0 AS linux, local_addr, local_port, foreign_addr, state, pid_text, row_index % 5 AS form, row_index % 30 = 3 AS twice, row_index % 17 = 0 AS nameless FROM mem_sockets
), r AS (
  SELECT evidence_id, CASE WHEN linux THEN 'linux.sockstat' ELSE 'windows.netscan' END AS plugin, k AS row_index, CASE WHEN k % 19 <> 0 THEN 'TCPV4' END AS protocol, CASE form WHEN 1 THEN 'fe80::1' ELSE local_addr END AS local_address,
    CASE WHEN form <> 4 THEN CAST(local_port AS BIGINT) END AS port, foreign_addr AS remote_address, CASE WHEN k % 3 = 0 THEN 443 END AS remote_port, upper(state) AS state,
    CASE WHEN k % 23 <> 0 THEN CAST(pid_text AS BIGINT) END AS pid, CASE WHEN NOT nameless THEN 'p' || k % 4 END AS process_name, twice, k FROM s
)"""


@query("memory_tool_sockets", f"""WITH {TOOL} SELECT evidence_id, plugin, row_index, protocol, local_address, CASE WHEN port <= 65535 THEN port END AS local_port, remote_address, remote_port, state, pid, process_name,
  CASE WHEN protocol IS NULL THEN 'MISSING_PROTOCOL' WHEN twice THEN 'CONFLICTING_ALIASES' WHEN port > 65535 THEN 'INVALID_PORT' WHEN k % 23 = 0 THEN 'INVALID_PID' END AS reason FROM r""", "mem_sockets")
def memory_tool_sockets(spark, sf):
    """Rows of two tools as sockets, accepted or refused."""
    k, text = F.col("row_index"), lambda v: F.lit(v)
    rows = view(spark, sf, "mem_sockets").withColumn("linux", k % 2 == 0)
    form = k % 5
    at = F.when(form == 0, F.concat("local_addr", F.lit(":"), "local_port")).when(form == 1, F.concat(F.lit("[FE80::1]:"), "local_port")).otherwise(F.col("local_addr"))
    port = F.when(form == 4, "*").when(form.isin(2, 3), F.col("local_port"))
    name = lambda linux, other: F.when(F.col("linux"), text(linux)).otherwise(text(other))
    cells = [
        (name("Proto", "Protocol"), F.when(k % 19 != 0, F.col("proto")).otherwise("n/a")), (name("Local Address", "LocalAddr"), at), (name("Local Port", "LocalPort"), port), (text("LPort"), F.when(k % 30 == 3, "1")),
        (name("Foreign Address", "ForeignAddr"), F.concat(F.lit(" "), "foreign_addr")), (name("RPort", "ForeignPort"), F.when(k % 3 == 0, "0x1BB")), (text("State"), F.col("state")),
        (name("PID", "OwnerPID"), F.when(k % 23 == 0, "none of them").otherwise(F.col("pid_text"))), (name("COMM", "Owner"), F.when(k % 17 != 0, F.concat(F.lit("p"), (k % 4).cast("string"))).otherwise("-")),
    ]
    rows = rows.withColumn("row", F.map_from_entries(F.array(*(F.struct(a.alias("k"), b.cast("string").alias("v")) for a, b in cells)))).withColumn("plugin", name("linux.sockstat", "windows.netscan")).withColumn("execution_id", F.lit("X"))
    found = memory_sockets.sockets(rows)
    return found.select("evidence_id", "plugin", "row_index", "protocol", "local_address", "local_port", "remote_address", "remote_port", "state", "pid", "process_name", "reason")
