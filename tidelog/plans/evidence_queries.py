"""Queries over accounts, artifacts, packets, memory, integrity and pivots, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.shared import materialize
from tidelog.operators import artifacts, correlate, integrity, memory, pivots, rules
from tidelog.plans.host_queries import EV, _auth, _events, _logs
from tidelog.plans.views import oracle, view
from tidelog.sources import accounts, logs, network
from tidelog.sources import memory as tools

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = oracle(sql, *views)
        return f

    return add


PASSWD = "pw AS (SELECT line_number, string_split(line, ':') AS f FROM account_lines WHERE source_path = 'etc/passwd'), u AS (SELECT line_number, f[1] AS username, CAST(f[3] AS BIGINT) AS uid, CAST(f[4] AS BIGINT) AS gid, f[6] AS home FROM pw WHERE len(f) = 7)"
GROUPS = "gr AS (SELECT line_number, string_split(line, ':') AS f FROM account_lines WHERE source_path = 'etc/group'), g AS (SELECT line_number, f[1] AS group_name, CAST(f[3] AS BIGINT) AS gid, list_filter(string_split(f[4], ','), lambda x: x <> '') AS members FROM gr WHERE len(f) = 4)"


@query("accounts_passwd", f"WITH {PASSWD} SELECT username, uid, gid, home, uid = 0 AS privileged FROM u", "account_lines")
def accounts_passwd(spark, sf):
    return accounts.passwd(view(spark, sf, "account_lines")).select("username", "uid", "gid", "home", "privileged")


@query("accounts_group", f"WITH {GROUPS} SELECT group_name, gid, CAST(len(members) AS INT) AS n_members, array_to_string(members, ',') AS members FROM g", "account_lines")
def accounts_group(spark, sf):
    return accounts.group(view(spark, sf, "account_lines")).select("group_name", "gid", F.size("members").alias("n_members"), F.array_join("members", ",").alias("members"))


@query("accounts_relationships", f"WITH {PASSWD}, {GROUPS} SELECT username, uid, u.gid, group_name AS primary_group, coalesce(further, '') AS further FROM u LEFT JOIN g ON g.gid = u.gid LEFT JOIN (SELECT m, string_agg(DISTINCT group_name, ',' ORDER BY group_name) AS further FROM (SELECT group_name, unnest(members) AS m FROM g) GROUP BY m) ON m = username", "account_lines")
def accounts_relationships(spark, sf):
    lines = view(spark, sf, "account_lines")
    return accounts.relationships(accounts.passwd(lines), accounts.group(lines)).withColumn("further", F.array_join("further", ","))


@query("accounts_totals", f"WITH {PASSWD}, {GROUPS} SELECT (SELECT count(*) FROM u) AS users, (SELECT count(*) FROM u WHERE uid = 0) AS privileged, (SELECT count(*) FROM g) AS groups, (SELECT CAST(sum(len(members)) AS BIGINT) FROM g) AS memberships", "account_lines")
def accounts_totals(spark, sf):
    return accounts.totals(view(spark, sf, "account_lines"))


@query("first_lines_of_texts", r"SELECT doc_id, line_number, line FROM (SELECT doc_id, i AS line_number, l AS line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE regexp_replace(l, '^\s+|\s+$', '', 'g') <> '' AND (l LIKE '#!%' OR NOT regexp_matches(l, '^\s*#'))) WHERE r <= 25")
def first_lines_of_texts(spark, sf):
    d = view(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    lines = d.select(F.col("doc_id").alias("source_path"), (F.col("at") + 1).cast("long").alias("line_number"), "line")
    return logs.first_lines(lines).select(F.col("source_path").alias("doc_id"), "line_number", "line")


def _artifacts(spark, sf) -> DataFrame:
    lines = view(spark, sf, "account_lines")
    return artifacts.union(artifacts.unify(_logs(spark, sf), "log", "event_type"), artifacts.unify(_auth(spark, sf), "authentication", "auth_type", "status"), artifacts.unify(accounts.passwd(lines), "account", "user"), artifacts.unify(accounts.group(lines), "account", "group"))


from tidelog.plans.host_queries import LOGS  # noqa: E402

ART = f"{LOGS}, {PASSWD}, {GROUPS}, art AS (SELECT 'log' AS category, event_type AS artifact_type, source_path, line_number, 'PARSED' AS status FROM l UNION ALL SELECT 'authentication', auth_type, source_path, line_number, status FROM a UNION ALL SELECT 'account', 'user', 'etc/passwd', line_number, 'PARSED' FROM u UNION ALL SELECT 'account', 'group', 'etc/group', line_number, 'PARSED' FROM g)"


@query("artifact_counts", f"WITH {ART} SELECT category, status, count(*) AS n FROM art GROUP BY ALL", "log_lines", "account_lines")
def artifact_counts(spark, sf):
    return artifacts.counts(_artifacts(spark, sf))


@query("artifact_query", f"WITH {ART} SELECT category, artifact_type, source_path, line_number FROM art WHERE category = 'authentication' AND status = 'FAILURE' AND contains(source_path, 'syslog')", "log_lines", "account_lines")
def artifact_query(spark, sf):
    return artifacts.query(_artifacts(spark, sf), category="authentication", status="FAILURE", path_contains="syslog").select("category", "artifact_type", "source_path", "line_number")


@query("artifact_lineage", f"WITH {ART} SELECT category, artifact_type, source_path, line_number FROM art WHERE source_path || ':' || line_number IN (SELECT 'var/log/auth.log:' || (event_id + 1) FROM events WHERE event_type = 'error')", "log_lines", "account_lines")
def artifact_lineage(spark, sf):
    keys = view(spark, sf, "events").filter("event_type = 'error'").select(F.concat(F.lit("var/log/auth.log:"), F.col("event_id") + 1).alias("key"))
    return artifacts.lineage(_artifacts(spark, sf), keys).select("category", "artifact_type", "source_path", "line_number")


@query("artifacts_ordered", f"WITH {ART} SELECT category, artifact_type, source_path, line_number, status FROM art ORDER BY source_path, line_number, category, artifact_type", "log_lines", "account_lines")
def artifacts_ordered(spark, sf):
    return artifacts.order(_artifacts(spark, sf)).select("category", "artifact_type", "source_path", "line_number", "status")


# packets


def _packets(spark, sf, name: str = "packets") -> DataFrame:
    return view(spark, sf, name).withColumn("ts_us", F.col("sec").cast("long") * 1_000_000)


KIND = "CASE WHEN fragment_offset > 0 THEN 'ip_fragment' WHEN transport_protocol = 'TCP' THEN 'tcp_packet' ELSE 'udp_packet' END"


@query("packet_classes", f"SELECT capture, frame_number, {KIND} AS event_type, CASE WHEN fragment_offset > 0 THEN 'Observed IP fragment from ' || src_ip || ' to ' || dst_ip || ' (offset ' || fragment_offset || ')' ELSE 'Observed ' || transport_protocol || ' packet from ' || src_ip || ':' || src_port || ' to ' || dst_ip || ':' || dst_port END AS description FROM packets", "packets")
def packet_classes(spark, sf):
    return network.packet_events(_packets(spark, sf)).select(F.col("source_path").alias("capture"), F.col("source_line").alias("frame_number"), "event_type", "description")


@query("network_timeline", f"SELECT event_type, source_path AS capture, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM (SELECT capture AS source_path, {KIND} AS event_type, sec * 1000000 AS us FROM packets UNION ALL SELECT capture, CASE WHEN server_name IS NOT NULL THEN 'tls_hello' ELSE 'dns_query' END, sec * 1000000 FROM packets WHERE server_name IS NOT NULL OR query_name IS NOT NULL) GROUP BY ALL", "packets")
def network_timeline(spark, sf):
    e = network.network_events(_packets(spark, sf))
    return e.groupBy("event_type", F.col("source_path").alias("capture")).agg(F.count("*").alias("n"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


@query("rules_network_pack", f"SELECT rule_name, count(*) AS n FROM (SELECT 'DNS query' AS rule_name FROM packets WHERE server_name IS NULL AND query_name = 'h7.example.org' UNION ALL SELECT 'TLS server name' FROM packets WHERE server_name = 's3.portal.org' UNION ALL SELECT 'Network protocol and port' FROM packets WHERE transport_protocol = 'TCP' AND dst_port = 22) GROUP BY ALL", "packets")
def rules_network_pack(spark, sf):
    pack = [rules.dns_rule("h7.example.org"), rules.tls_rule("s3.portal.org"), rules.protocol_rule("TCP", 22)]
    return rules.counts(rules.single(network.network_events(_packets(spark, sf)), pack))


APP = """a AS (SELECT *, frame_number % 4 = 0 AS asks, frame_number % 4 = 1 AS replies, CASE WHEN server_name IS NOT NULL THEN 'tls_hello' WHEN frame_number % 4 < 2 THEN 'http_message' WHEN query_name IS NOT NULL THEN 'dns_query' END AS kind FROM packets_app)"""


@query(
    "network_applications",
    f"""WITH {APP} SELECT capture, frame_number, kind AS event_type, CASE WHEN kind = 'http_message' AND asks THEN 'GET' END AS method, CASE WHEN kind = 'http_message' AND asks THEN 'h' || (frame_number % 20) END AS host,
    CASE WHEN kind = 'http_message' AND asks THEN '/p' || (frame_number % 50) END AS target, CAST(CASE WHEN kind = 'http_message' AND replies THEN 200 + frame_number % 3 END AS INT) AS status_code,
    CASE WHEN kind = 'tls_hello' THEN ['TLS 1.0', 'TLS 1.1', 'TLS 1.2', 'TLS 1.3', 'CODE773'][frame_number % 5 + 1] END AS tls_version, CASE WHEN kind = 'dns_query' THEN ['NOERROR', 'FORMERR', 'SERVFAIL', 'NXDOMAIN', 'NOTIMP', 'REFUSED', 'CODE6'][frame_number % 7 + 1] END AS response_code
    FROM a WHERE kind IS NOT NULL""",
    "packets", "packets_app",
)
def network_applications(spark, sf):
    e = network.application_events(_packets(spark, sf, "packets_app"))
    return e.select(F.col("source_path").alias("capture"), F.col("source_line").alias("frame_number"), "event_type", "method", "host", "target", "status_code", "tls_version", "response_code")


@query(
    "rules_network_full_pack",
    f"""WITH {EV}, {APP} SELECT rule_name, count(*) AS n FROM (SELECT 'DNS query' AS rule_name FROM a WHERE kind = 'dns_query' AND query_name = 'h7.example.org' UNION ALL SELECT 'TLS server name' FROM a WHERE server_name = 's3.portal.org'
    UNION ALL SELECT 'HTTP message' FROM a WHERE kind = 'http_message' AND asks AND frame_number % 20 = 4 UNION ALL SELECT 'Network protocol and port' FROM a WHERE transport_protocol = 'TCP' AND dst_port = 22
    UNION ALL SELECT 'Network protocol and port' FROM a WHERE transport_protocol = 'TCP' AND dst_port = 22 AND kind IS NOT NULL
    UNION ALL SELECT 'Host event with network event' FROM e h JOIN a ON (h.source_ip = a.src_ip OR h.source_ip = a.dst_ip) AND h.ts_class = 0 AND abs(h.ts_us - a.sec * 1000000) <= 300000000 WHERE h.category <> 'network') GROUP BY ALL""",
    "timeline", "packets", "packets_app",
)
def rules_network_full_pack(spark, sf):
    packets = materialize(_packets(spark, sf, "packets_app"), "packets", clean=True)  # written once: numbering shuffles them
    host = materialize(_events(spark, sf, "ts_class", "ts_us", "category", "event_type", "username", "source_ip", "session_id"), "host", clean=True)
    events = network.network_events(packets)
    edges = correlate.host_network_edges(correlate.host_network(host, network.packet_events(packets)))
    pack = rules.network_pack("h7.example.org", "s3.portal.org", "h4", "TCP", 22)
    return rules.counts(rules.evaluate(events.unionByName(host, allowMissingColumns=True), pack, edges, unique=True))


HEADS = "h AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN NULL WHEN page_id % 7 = 0 THEN 'r' ELSE 'q' END AS t FROM http_heads)"


@query("http_heads", f"WITH {HEADS} SELECT page_id, CASE t WHEN 'q' THEN 'GET' END AS method, CASE t WHEN 'q' THEN '/p/' || page_id END AS target, CAST(CASE t WHEN 'r' THEN 404 END AS INT) AS status_code, CASE t WHEN 'q' THEN 'h' || (page_id % 10) || '.example.org' END AS host, CASE t WHEN 'r' THEN page_id END AS content_length, CASE t WHEN 'q' THEN 'host=h' || (page_id % 10) || '.example.org;cookie=[REDACTED]' ELSE 'server=s' || (page_id % 3) || ';content-length=' || page_id END AS headers FROM h WHERE t IS NOT NULL", "http_heads")
def http_heads(spark, sf):
    return network.http_heads(view(spark, sf, "http_heads")).select("page_id", "method", "target", "status_code", "host", "content_length", "headers")


@query("links_host_network", f"""WITH {EV}, n AS (SELECT capture || ':' || frame_number AS id, sec * 1000000 AS us, src_ip, dst_ip, src_port, dst_port FROM packets)
SELECT h.event_id AS host_event, n.id AS network_event, 'ip_match' AS dimension, h.source_ip AS value, abs(h.ts_us - n.us) / 1000000.0 AS delta_seconds, CASE WHEN h.source_ip = n.src_ip THEN 'outbound' ELSE 'inbound' END AS direction
FROM e h JOIN n ON (h.source_ip = n.src_ip OR h.source_ip = n.dst_ip) AND h.ts_class = 0 AND abs(h.ts_us - n.us) <= 300000000 WHERE h.category <> 'network'""", "timeline", "packets")
def links_host_network(spark, sf):
    packets = materialize(_packets(spark, sf).select("capture", "frame_number", "ts_us", "src_ip", "dst_ip", "src_port", "dst_port", "network_protocol", "transport_protocol", "fragment_offset", "query_name", "server_name"), "packets", clean=True)
    net = network.packet_events(packets).withColumn("event_id", F.concat_ws(":", "source_path", "source_line"))
    host = materialize(_events(spark, sf, "ts_class", "ts_us", "category", "username", "source_ip", "session_id"), "host", clean=True)
    return correlate.host_network(host, net).select("host_event", "network_event", "dimension", "value", "delta_seconds", "direction")


# memory


PROC = "p AS (SELECT evidence_id, plugin, execution_id, CAST(pid_upper AS BIGINT) AS pid, CAST(ppid_text AS BIGINT) AS ppid, image_name AS name, created_sec * 1000000 AS created_us, image_path, pid_mixed, row_index FROM mem_processes), k AS (SELECT evidence_id, plugin, execution_id, pid, ppid, name, created_us, image_path, count(*) - 1 AS duplicates FROM p WHERE pid_mixed IS NULL GROUP BY ALL)"


@query("memory_processes", f"WITH {PROC} SELECT * FROM k", "mem_processes")
def memory_processes(spark, sf):
    return tools.process_artifacts(view(spark, sf, "mem_processes")).select(*tools.PROCESS, "duplicates")


@query("memory_rejected", "SELECT evidence_id, plugin, row_index, 'CONFLICTING_ALIASES' AS reason FROM mem_processes WHERE pid_mixed IS NOT NULL", "mem_processes")
def memory_rejected(spark, sf):
    return tools.split_rows(tools.processes(view(spark, sf, "mem_processes")))[1].select("evidence_id", "plugin", "row_index", "reason")


@query("memory_totals", "SELECT evidence_id, count(*) AS n_rows, count(*) FILTER (pid_mixed IS NULL) AS valid, count(*) FILTER (pid_mixed IS NOT NULL) AS rejected FROM mem_processes GROUP BY evidence_id", "mem_processes")
def memory_totals(spark, sf):
    return tools.totals(tools.processes(view(spark, sf, "mem_processes")))


@query("memory_sockets", "SELECT evidence_id, row_index, 'TCP' AS protocol, local_addr, CAST(local_port AS BIGINT) AS local_port, foreign_addr, upper(state) AS state, CAST(pid_text AS BIGINT) AS pid FROM mem_sockets WHERE CAST(local_port AS BIGINT) <= 65535", "mem_sockets")
def memory_sockets(spark, sf):
    return tools.socket_artifacts(view(spark, sf, "mem_sockets")).select(*tools.SOCKET)


@query("memory_modules", "SELECT evidence_id, row_index, name_text AS name, path_text AS path, row_index * 4096 AS base, CAST(size_text AS BIGINT) AS size FROM mem_modules", "mem_modules")
def memory_modules(spark, sf):
    return tools.module_artifacts(view(spark, sf, "mem_modules")).select("evidence_id", "row_index", "name", "path", "base", "size")


def _processes(spark, sf) -> DataFrame:
    return tools.process_artifacts(view(spark, sf, "mem_processes"))


@query("memory_parent_child", f"WITH {PROC} SELECT c.evidence_id, c.pid AS child_pid, d.pid AS parent_pid, count(*) AS n FROM k c JOIN k d ON c.evidence_id = d.evidence_id AND c.ppid = d.pid AND c.ppid > 0 WHERE (c.pid, c.plugin, c.name) <> (d.pid, d.plugin, d.name) GROUP BY ALL", "mem_processes")
def memory_parent_child(spark, sf):
    return memory.parent_child(_processes(spark, sf)).groupBy("evidence_id", "child_pid", "parent_pid").agg(F.count("*").alias("n"))


@query("memory_process_socket", f"WITH {PROC} SELECT k.evidence_id, k.pid, CAST(local_port AS BIGINT) AS local_port, count(*) AS n FROM k JOIN mem_sockets s ON s.evidence_id = k.evidence_id AND CAST(pid_text AS BIGINT) = k.pid WHERE CAST(local_port AS BIGINT) <= 65535 GROUP BY ALL", "mem_processes", "mem_sockets")
def memory_process_socket(spark, sf):
    links = memory.process_socket(_processes(spark, sf), tools.socket_artifacts(view(spark, sf, "mem_sockets")))
    return links.groupBy("evidence_id", "pid", "local_port").agg(F.count("*").alias("n"))


@query("memory_same_pid", f"WITH {PROC} SELECT a.evidence_id, a.pid, a.name <> b.name AS reused FROM k a JOIN k b ON a.evidence_id = b.evidence_id AND a.pid = b.pid AND a.plugin < b.plugin", "mem_processes")
def memory_same_pid(spark, sf):
    return memory.same_pid(_processes(spark, sf)).select("evidence_id", "pid", "reused")


@query("memory_process_module", f"WITH {PROC} SELECT k.evidence_id, image_path = path_text AS exact, count(*) AS n FROM k JOIN mem_modules m ON m.evidence_id = k.evidence_id AND (ends_with(image_path, path_text) OR ends_with(path_text, image_path)) GROUP BY ALL", "mem_processes", "mem_modules")
def memory_process_module(spark, sf):
    links = memory.process_module(_processes(spark, sf), tools.module_artifacts(view(spark, sf, "mem_modules")))
    return links.groupBy("evidence_id", "exact").agg(F.count("*").alias("n"))


@query("memory_shared_execution", f"WITH {PROC} SELECT a.evidence_id, a.execution_id AS value, count(*) AS n FROM k a JOIN k b ON a.evidence_id = b.evidence_id AND a.execution_id = b.execution_id AND (a.pid, a.plugin, a.name) < (b.pid, b.plugin, b.name) GROUP BY ALL", "mem_processes")
def memory_shared_execution(spark, sf):
    return memory.shared_counts(_processes(spark, sf), "execution_id", "SHARED_EXECUTION_PROVENANCE").select("evidence_id", "value", "n")


@query("memory_near_in_time", f"WITH {PROC} SELECT a.evidence_id, abs(a.created_us - b.created_us) / 1000000.0 AS delta_seconds, count(*) AS n FROM k a JOIN k b ON a.evidence_id = b.evidence_id AND (a.pid, a.plugin, a.name) < (b.pid, b.plugin, b.name) AND abs(a.created_us - b.created_us) <= 60000000 GROUP BY ALL", "mem_processes")
def memory_near_in_time(spark, sf):
    return memory.near_in_time(_processes(spark, sf), 60.0).groupBy("evidence_id", "delta_seconds").agg(F.count("*").alias("n"))


@query("memory_events", f"WITH {PROC} SELECT 'process_created' AS event_type, created_us AS ts_us, 'process ' || name || ' pid ' || pid AS description, evidence_id AS source_path FROM k", "mem_processes")
def memory_events(spark, sf):
    return memory.events(_processes(spark, sf)).select("event_type", "ts_us", "description", "source_path")


@query("memory_triage", f"""WITH {PROC}, x AS (SELECT c.evidence_id, 'PARENT_CHILD_PROCESS' AS relation FROM k c JOIN k d ON c.evidence_id = d.evidence_id AND c.ppid = d.pid AND c.ppid > 0 WHERE (c.pid, c.plugin, c.name) <> (d.pid, d.plugin, d.name)
UNION ALL SELECT k.evidence_id, 'PROCESS_NETWORK_SOCKET' FROM k JOIN mem_sockets s ON s.evidence_id = k.evidence_id AND CAST(pid_text AS BIGINT) = k.pid WHERE CAST(local_port AS BIGINT) <= 65535
UNION ALL SELECT a.evidence_id, 'PROCESS_PID_MATCH' FROM k a JOIN k b ON a.evidence_id = b.evidence_id AND a.pid = b.pid AND a.plugin < b.plugin
UNION ALL SELECT a.evidence_id, 'SHARED_EXECUTION_PROVENANCE' FROM k a JOIN k b ON a.evidence_id = b.evidence_id AND a.execution_id = b.execution_id AND (a.pid, a.plugin, a.name) < (b.pid, b.plugin, b.name)) SELECT evidence_id, relation, count(*) AS n FROM x GROUP BY ALL""", "mem_processes", "mem_sockets")
def memory_triage(spark, sf):
    return memory.triage(_processes(spark, sf), tools.socket_artifacts(view(spark, sf, "mem_sockets")))


# without look-around: the character in front of a name is matched and put back
_SECRET = "passw(?:or)?d|(?:client[-_])secret|(?:access|auth|api|session)[-_]token|api[-_]?key|(?:secret|private)[-_]key"
_VALUE = """('[^']*'|"[^"]*"|[^\\s,;'"]+)""".replace("'", "''")


@query(
    "credentials_redacted",
    rf"""SELECT doc_id, regexp_replace(regexp_replace(text, '(^|[^\w-])(--?(?:{_SECRET}|secret|token|key)(?:\s*[:=]\s*|\s+)){_VALUE}', '\1\2[REDACTED]', 'gi'),
    '(^|[^\w-])((?:{_SECRET})\s*[:=]\s*){_VALUE}', '\1\2[REDACTED]', 'gi') AS text FROM documents""",
)
def credentials_redacted(spark, sf):
    return view(spark, sf, "documents").select("doc_id", tools.redact(F.col("text")).alias("text"))


# integrity


@query("manifest_built", "SELECT 'd/' || doc_id AS relative_path, CAST(strlen(text) AS BIGINT) AS size_bytes, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def manifest_built(spark, sf):
    m = integrity.manifest_of(view(spark, sf, "documents"), F.concat(F.lit("d/"), F.col("doc_id")), F.col("text"))
    return m.select("relative_path", "size_bytes", "md5", "sha256")


VERIFIED = "v AS (SELECT m.relative_path, CASE WHEN m.relative_path LIKE '../%' THEN 'PATH_TRAVERSAL_DETECTED' WHEN algorithm = 'sha9' THEN 'UNSUPPORTED_ALGORITHM' WHEN f.relative_path IS NULL THEN 'FILE_MISSING' WHEN digest = f.sha256 THEN 'VERIFIED' ELSE 'MISMATCH' END AS status FROM manifest m LEFT JOIN files f ON f.relative_path = m.relative_path)"


@query("manifest_verified", f"WITH {VERIFIED} SELECT * FROM v", "manifest", "files")
def manifest_verified(spark, sf):
    return integrity.verify_manifest(view(spark, sf, "manifest"), view(spark, sf, "files"))


@query("manifest_counts", f"WITH {VERIFIED} SELECT count(*) AS entries, count(*) FILTER (status = 'VERIFIED') AS verified, count(*) FILTER (status <> 'VERIFIED') AS failed, CASE WHEN bool_and(status = 'VERIFIED') THEN 'VERIFIED' ELSE 'FAILED' END AS overall FROM v", "manifest", "files")
def manifest_counts(spark, sf):
    return integrity.verification_counts(integrity.verify_manifest(view(spark, sf, "manifest"), view(spark, sf, "files")))


def _chain(spark, sf) -> DataFrame:
    built = integrity.build_chain(view(spark, sf, "custody_actions").select(*integrity.FIELDS, "okey"))
    return built.withColumn("actor", F.when(F.col("okey") % 500 == 0, "altered").otherwise(F.col("actor"))).drop("okey")


@query("custody_chain_problems", "SELECT ledger_id, CAST(seq AS BIGINT) AS seq, CASE WHEN okey % 500 = 0 THEN 'ALTERED_RECORD' END AS problem FROM custody_actions", "custody_actions")
def custody_chain_problems(spark, sf):
    return integrity.verify_chain(_chain(spark, sf)).select("ledger_id", F.col("seq").cast("long").alias("seq"), "problem")


@query("custody_intake", "SELECT ledger_id, item_id, arg_min(action_type, seq) AS first_action, arg_min(action_type, seq) IN ('RECEIVED', 'REGISTERED') AS accepted FROM custody_actions GROUP BY ALL", "custody_actions")
def custody_intake(spark, sf):
    return integrity.audit_intake(view(spark, sf, "custody_actions"))


@query("custody_chronology", "SELECT ledger_id, item_id, CAST(seq AS BIGINT) AS seq, coalesce(happened < lag(happened) OVER (PARTITION BY ledger_id, item_id ORDER BY seq), false) AS inverted FROM custody_actions", "custody_actions")
def custody_chronology(spark, sf):
    return integrity.audit_chronology(view(spark, sf, "custody_actions")).withColumn("seq", F.col("seq").cast("long"))


HOLDER = "c AS (SELECT *, CASE WHEN action_type = 'TRANSFERRED' THEN recipient WHEN action_type = 'RECEIVED' THEN actor END AS holds FROM custody_actions)"


@query("custody_possession", f"WITH {HOLDER}, d AS (SELECT *, last_value(holds IGNORE NULLS) OVER (PARTITION BY ledger_id, item_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS holder FROM c) SELECT ledger_id, item_id, CAST(seq AS BIGINT) AS seq, holder, actor, coalesce(holder <> actor, false) AS discrepancy FROM d WHERE action_type = 'TRANSFERRED'", "custody_actions")
def custody_possession(spark, sf):
    return integrity.audit_possession(view(spark, sf, "custody_actions")).withColumn("seq", F.col("seq").cast("long"))


@query("custody_current", f"WITH {HOLDER} SELECT ledger_id, item_id, arg_max(holds, seq) AS holder, CAST(max(seq) AS BIGINT) AS since_seq FROM c WHERE holds IS NOT NULL GROUP BY ALL", "custody_actions")
def custody_current(spark, sf):
    return integrity.current_custodians(view(spark, sf, "custody_actions")).withColumn("since_seq", F.col("since_seq").cast("long"))


# pivots


@query("pivot_counts", f"WITH {EV} SELECT field, count(*) AS n, count(DISTINCT value) AS values FROM (SELECT 'event' AS field, event_id AS value FROM e UNION ALL SELECT 'artifact', source_artifact_id FROM e UNION ALL SELECT 'ip', source_ip FROM e UNION ALL SELECT 'user', username FROM e) GROUP BY field", "timeline")
def pivot_counts(spark, sf):
    return pivots.counts(pivots.of_events(_events(spark, sf)))


@query("pivot_of_address", f"WITH {EV} SELECT 'ip' AS field, source_ip AS value, 'event' AS kind, event_id AS ref FROM e WHERE source_ip = '10.0.0.7' ORDER BY ref LIMIT 1001", "timeline")
def pivot_of_address(spark, sf):
    return pivots.find(pivots.of_events(_events(spark, sf)), "ip", "10.0.0.7", "event", 1001).select("field", "value", "kind", "ref")


@query("custody_digests", "SELECT m.relative_path, algorithm, CASE WHEN f.relative_path IS NULL OR algorithm = 'sha9' THEN 'NO_BASELINE' WHEN digest = f.sha256 THEN 'EQUAL' ELSE 'DIFFERENT' END AS outcome FROM manifest m LEFT JOIN files f ON f.relative_path = m.relative_path", "manifest", "files")
def custody_digests(spark, sf):
    return integrity.audit_digests(view(spark, sf, "manifest"), view(spark, sf, "files"))


@query("evidence_inventory", f"WITH {VERIFIED} SELECT relative_path, count(*) AS digests, max(status) AS status, max(status) <> 'VERIFIED' AS warning FROM v GROUP BY relative_path", "manifest", "files")
def evidence_inventory(spark, sf):
    entries = view(spark, sf, "manifest")
    return integrity.inventory(entries, integrity.verify_manifest(entries, view(spark, sf, "files")))


def _memory(spark, sf):
    return _processes(spark, sf), tools.socket_artifacts(view(spark, sf, "mem_sockets")), tools.module_artifacts(view(spark, sf, "mem_modules"))


@query("rules_memory_pack", f"""WITH {PROC}, x AS (SELECT 'Memory process name' AS rule_name FROM k WHERE name = 'p3' UNION ALL SELECT 'Memory socket' FROM mem_sockets WHERE local_port = '443' UNION ALL SELECT 'Memory module' FROM mem_modules WHERE path_text LIKE '/tmp%'
UNION ALL SELECT 'Memory link PARENT_CHILD_PROCESS' FROM k c JOIN k d ON c.evidence_id = d.evidence_id AND c.ppid = d.pid AND c.ppid > 0 WHERE (c.pid, c.plugin, c.name) <> (d.pid, d.plugin, d.name)
UNION ALL SELECT 'Memory link PROCESS_NETWORK_SOCKET' FROM k JOIN mem_sockets s ON s.evidence_id = k.evidence_id AND CAST(pid_text AS BIGINT) = k.pid WHERE CAST(local_port AS BIGINT) <= 65535) SELECT rule_name, count(*) AS n FROM x GROUP BY ALL""", "mem_processes", "mem_sockets", "mem_modules")
def rules_memory_pack(spark, sf):
    processes, sockets, modules = _memory(spark, sf)
    events = memory.timeline(processes, sockets, modules)
    cols = ["relation", "evidence_id", "from_id", "to_id", "confidence"]
    links = memory.parent_child(processes).select(cols).unionByName(memory.process_socket(processes, sockets).select(cols))
    return rules.counts(rules.evaluate(events, rules.memory_pack("p3", 443, "/tmp"), memory.timeline_edges(links, events)))
