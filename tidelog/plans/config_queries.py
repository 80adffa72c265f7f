"""Queries over accounts, startup configuration, PAM details and ledgers; their SQL starts from the driver tables, not from the lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.functions.shared import materialize
from tidelog.operators import integrity, memory, timeline
from tidelog.plans.evidence_queries import KIND, PROC, _chain, _packets, _processes
from tidelog.plans.host_queries import LOGS, file_times
from tidelog.plans.views import oracle, view
from tidelog.sources import accounts, logs, network, persistence

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str, *views: str):
    def add(f):
        QUERIES[name] = f
        SQL[name] = oracle(sql, *views)
        return f

    return add


def _lines(spark, sf):
    return view(spark, sf, "config_lines")


def _customers(kind: int, columns: str, where: str = "true") -> str:
    return f"SELECT {columns} FROM (SELECT c_custkey AS k FROM customer) WHERE k % 10 = {kind} AND {where}"


@query(
    "accounts_shadow",
    _customers(0, "'u' || k AS username, k % 40 = 0 AS locked, k % 40 = 20 AS empty, k % 40 IN (10, 30) AS has_password, CASE k % 40 WHEN 10 THEN 'sha512' WHEN 30 THEN 'yescrypt' END AS hash_family, "
                  "CASE k % 40 WHEN 0 THEN '!' WHEN 20 THEN '' ELSE '[REDACTED]' END AS hash"),
)
def accounts_shadow(spark, sf):
    return accounts.shadow(_lines(spark, sf)).select("username", "locked", "empty", "has_password", "hash_family", "hash")


@query(
    "accounts_sudoers",
    "SELECT k AS line_number, CASE WHEN rule THEN 'RULE' ELSE 'UNPARSED' END AS kind, CASE WHEN rule THEN 'u' || k END AS principal, CASE WHEN rule THEN 'ALL' END AS host, CASE WHEN rule THEN 'root' END AS runas, "
    "CASE WHEN rule THEN 'NOPASSWD' ELSE '' END AS tags, CASE WHEN rule THEN '/bin/a|/bin/b' || k ELSE '' END AS commands FROM (SELECT c_custkey AS k, c_custkey % 20 = 1 AS rule FROM customer WHERE c_custkey % 10 = 1)",
)
def accounts_sudoers(spark, sf):
    return accounts.sudoers(_lines(spark, sf)).withColumns({"tags": F.array_join("tags", "|"), "commands": F.array_join("commands", "|")}).drop("source_path")


@query("accounts_keys", _customers(2, "'home/u' || k || '/.ssh/authorized_keys' AS source_path, CAST(1 AS BIGINT) AS line_number, 'u' || k AS owner, 'ssh-ed25519' AS key_type, 'u' || k || '@h' AS comment"))
def accounts_keys(spark, sf):
    return accounts.authorized_keys(_lines(spark, sf))


@query("persistence_systemd", _customers(3, "'etc/systemd/system/s' || k || '.service' AS source_path, CAST(4 AS BIGINT) AS line_number, 'ExecStart' AS kind, '/bin/s' || k AS command, 'd' || k AS description, 'u' || k AS \"user\", CAST(NULL AS VARCHAR) AS wanted_by"))
def persistence_systemd(spark, sf):
    return persistence.systemd(_lines(spark, sf))


@query(
    "persistence_cron",
    "WITH c AS (" + _customers(4, "'etc/cron.d/c' || k AS source_path, k") + """)
SELECT source_path, CAST(1 AS BIGINT) AS line_number, CASE WHEN k % 20 = 4 THEN 'JOB' ELSE 'MALFORMED' END AS kind, CASE WHEN k % 20 = 4 THEN '*/5 * * * *' END AS schedule, CASE WHEN k % 20 = 4 THEN 'root' END AS "user", CASE WHEN k % 20 = 4 THEN '/bin/c' || k || ' x' END AS command FROM c
UNION ALL SELECT source_path, 2, 'JOB', '@daily', 'u' || k, '/bin/d' FROM c UNION ALL SELECT source_path, 3, 'ENVIRONMENT', NULL, NULL, NULL FROM c""",
)
def persistence_cron(spark, sf):
    return persistence.cron(_lines(spark, sf))


@query("persistence_anacron", _customers(5, "'etc/anacrontab' AS source_path, k AS line_number, '7' AS period, CAST(k % 9 AS VARCHAR) AS delay, 'job' || k AS job, '/bin/run ' || k AS command"))
def persistence_anacron(spark, sf):
    return persistence.anacron(_lines(spark, sf))


@query(
    "persistence_shell",
    "WITH c AS (" + _customers(6, "'home/u' || k || '/.bashrc' AS source_path, k") + ") SELECT source_path, CAST(1 AS BIGINT) AS line_number, 'export' AS hint, 'export A=' || k AS text FROM c UNION ALL SELECT source_path, 2, 'alias', 'alias l=ls' FROM c UNION ALL SELECT source_path, 4, 'command', '/bin/e' || k FROM c",
)
def persistence_shell(spark, sf):
    return persistence.shell_startup(_lines(spark, sf))


@query("persistence_autostart", _customers(7, "'home/u' || k || '/.config/autostart/a.desktop' AS source_path, 'n' || k AS name, '/bin/y' || k AS command, CAST(NULL AS VARCHAR) AS hidden"))
def persistence_autostart(spark, sf):
    return persistence.autostart(_lines(spark, sf))


@query("persistence_preload", "WITH c AS (" + _customers(8, "k") + ") SELECT 'etc/ld.so.preload' AS source_path, k AS line_number, '/lib/a' || k || '.so' AS library FROM c UNION ALL SELECT 'etc/ld.so.preload', k, '/lib/b.so' FROM c")
def persistence_preload(spark, sf):
    return persistence.preload(_lines(spark, sf))


@query("persistence_modules", "WITH c AS (" + _customers(9, "k") + ") SELECT 'etc/modules' AS source_path, k AS line_number, 'load' AS directive, 'mod' || k AS module FROM c UNION ALL SELECT 'etc/modprobe.d/m' || k || '.conf', 1, 'blacklist', 'm' || k FROM c")
def persistence_modules(spark, sf):
    return persistence.kernel_modules(_lines(spark, sf))


@query(
    "persistence_counts",
    "WITH c AS (SELECT c_custkey % 10 AS d, count(*) AS n FROM customer GROUP BY 1) SELECT CASE d WHEN 3 THEN 'systemd' WHEN 4 THEN 'cron' WHEN 5 THEN 'anacron' WHEN 6 THEN 'shell_startup' WHEN 7 THEN 'autostart' WHEN 8 THEN 'preload' ELSE 'kernel_modules' END AS category, "
    "CAST(n * CASE d WHEN 4 THEN 3 WHEN 6 THEN 3 WHEN 8 THEN 2 WHEN 9 THEN 2 ELSE 1 END AS BIGINT) AS n FROM c WHERE d >= 3",
)
def persistence_counts(spark, sf):
    return persistence.counts(_lines(spark, sf))


@query(
    "persistence_enablement",
    "SELECT 'etc/systemd/system/t' || (c_custkey % 3) || '.target.wants/s' || c_custkey || '.service' AS relative_path, 't' || (c_custkey % 3) || '.target' AS target, 'wants' AS relation, 's' || c_custkey || '.service' AS unit, '/lib/s' || c_custkey || '.service' AS link_target FROM customer WHERE c_custkey % 2 = 0",
)
def persistence_enablement(spark, sf):
    return persistence.enablement(view(spark, sf, "unit_links"))


@query(
    "pam_details",
    "SELECT event_id + 1 AS line_number, CASE WHEN event_id % 3 = 0 THEN 'l' || user_id END AS logname, '0' AS uid, '0' AS euid, 'ssh' AS tty, CAST(NULL AS VARCHAR) AS ruser, '10.0.0.' || (user_id % 250) AS rhost, CASE WHEN event_id % 2 = 0 THEN 'u' || user_id END AS pam_user FROM events WHERE event_type = 'error'",
)
def pam_details(spark, sf):
    out = logs.pam_detail(logs.parse_logs(view(spark, sf, "pam_lines"))).drop("source_path")
    return out.select("line_number", *(F.nullif(c, F.lit("")).alias(c) for c in out.columns if c != "line_number"))


@query("memory_shared_plugin", f"WITH {PROC} SELECT a.evidence_id, a.plugin AS value, count(*) AS n FROM k a JOIN k b ON a.evidence_id = b.evidence_id AND a.plugin = b.plugin AND (a.pid, a.name) < (b.pid, b.name) GROUP BY ALL", "mem_processes")
def memory_shared_plugin(spark, sf):
    return memory.shared_counts(_processes(spark, sf), "plugin", "SHARED_PLUGIN_PROVENANCE").select("evidence_id", "value", "n")


@query("memory_links_filtered", f"WITH {PROC} SELECT c.pid AS child_pid, d.pid AS parent_pid FROM k c JOIN k d ON c.evidence_id = d.evidence_id AND c.ppid = d.pid AND c.ppid > 0 WHERE (c.pid, c.plugin, c.name) <> (d.pid, d.plugin, d.name) AND c.evidence_id = 'MEM-1'", "mem_processes")
def memory_links_filtered(spark, sf):
    return memory.filtered(memory.parent_child(_processes(spark, sf)), ["PARENT_CHILD_PROCESS"], "HIGH", "MEM-1").select("child_pid", "parent_pid")


# ledgers: the chain is followed record by record
CHAIN = """WITH RECURSIVE b AS (SELECT *, '{"action_type":"' || action_type || '","actor":"' || actor || '","event_id":"' || event_id || '","happened":"' || happened || '","item_id":"' || item_id || '","ledger_id":"' || ledger_id || '","recipient":"' || recipient || '","seq":' || seq || '}' AS body FROM custody_actions),
h AS (SELECT ledger_id, seq, repeat('0', 64) AS previous_hash, sha256(repeat('0', 64) || body) AS record_hash FROM b WHERE seq = 1
UNION ALL SELECT b.ledger_id, b.seq, h.record_hash, sha256(h.record_hash || b.body) FROM h JOIN b ON b.ledger_id = h.ledger_id AND b.seq = h.seq + 1)"""


@query("custody_chain_built", CHAIN + " SELECT a.ledger_id, CAST(a.seq AS BIGINT) AS seq, event_id, happened, action_type, item_id, actor, recipient, previous_hash, record_hash FROM custody_actions a JOIN h ON h.ledger_id = a.ledger_id AND h.seq = a.seq", "custody_actions")
def custody_chain_built(spark, sf):
    return integrity.build_chain(view(spark, sf, "custody_actions").select(*integrity.FIELDS)).withColumn("seq", F.col("seq").cast("long"))


@query("custody_heads", CHAIN + " SELECT ledger_id, count(*) AS records, arg_max(record_hash, seq) AS head_hash FROM h GROUP BY ledger_id", "custody_actions")
def custody_heads(spark, sf):
    return integrity.ledger_heads(integrity.build_chain(view(spark, sf, "custody_actions").select(*integrity.FIELDS)))


@query(
    "custody_status",
    """WITH a AS (SELECT * REPLACE (CASE WHEN okey % 500 = 0 THEN 'altered' ELSE actor END AS actor) FROM custody_actions),
c AS (SELECT *, CASE WHEN action_type = 'TRANSFERRED' THEN recipient WHEN action_type = 'RECEIVED' THEN actor END AS holds FROM a),
d AS (SELECT *, last_value(holds IGNORE NULLS) OVER w AS holder, lag(happened) OVER (PARTITION BY ledger_id, item_id ORDER BY seq) AS before, row_number() OVER (PARTITION BY ledger_id, item_id ORDER BY seq) AS nth FROM c
  WINDOW w AS (PARTITION BY ledger_id, item_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT ledger_id, CASE max(CASE WHEN okey % 500 = 0 THEN 3 WHEN action_type = 'TRANSFERRED' AND coalesce(holder <> actor, false) OR coalesce(happened < before, false) THEN 2 WHEN nth = 1 AND action_type <> 'RECEIVED' THEN 1 ELSE 0 END)
  WHEN 3 THEN 'TAMPERED' WHEN 2 THEN 'DISCREPANCY' WHEN 1 THEN 'INCOMPLETE' ELSE 'VERIFIED' END AS status FROM d GROUP BY ledger_id""",
    "custody_actions",
)
def custody_status(spark, sf):
    return integrity.audit_status(_chain(spark, sf))


# one timeline of all sources


def _all_sources(spark, sf, keep: list[str] | None = None):
    packets = materialize(_packets(spark, sf).drop("sec"), "packets", clean=True)  # their numbering has a shuffle of its own
    return timeline.unite(timeline.of_lines(view(spark, sf, "log_lines")), timeline.filesystem_events(file_times(spark, sf)), network.packet_events(packets), memory.events(_processes(spark, sf)), keep=keep)


FILES = """SELECT 'filesystem' AS category, e.event_type, 0 AS ts_class, e.ts_us FROM orders, LATERAL (VALUES ('file_created', epoch_us(o_orderdate)), ('file_modified', CASE WHEN o_orderkey % 3 <> 0 THEN epoch_us(o_orderdate) + o_custkey * 1000000 END)) AS e(event_type, ts_us) WHERE e.ts_us IS NOT NULL"""


@query(
    "timeline_all_sources",
    f"""WITH {LOGS}, {PROC.replace('p AS (SELECT', 'pr AS (SELECT', 1).replace('FROM p WHERE', 'FROM pr WHERE')} SELECT category, event_type, CAST(ts_class AS INT) AS ts_class, count(*) AS n FROM (
SELECT 'authentication' AS category, auth_type AS event_type, CASE WHEN ok THEN 0 ELSE 2 END AS ts_class, 0 AS ts_us FROM a
UNION ALL SELECT 'log', event_type, CASE WHEN ok THEN 0 ELSE 2 END, 0 FROM l WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.source_path = l.source_path AND a.line_number = l.line_number)
UNION ALL {FILES} UNION ALL SELECT 'network', {KIND}, 0, 0 FROM packets UNION ALL SELECT 'memory', 'process_created', 0, 0 FROM k) AS u GROUP BY ALL""",
    "log_lines", "packets", "mem_processes",
)
def timeline_all_sources(spark, sf):
    return _all_sources(spark, sf, ["category", "event_type", "ts_class"]).groupBy("category", "event_type", "ts_class").agg(F.count("*").alias("n"))


@query("timeline_attribute_search", f"WITH {PROC} SELECT category, count(*) AS n FROM (SELECT 'network' AS category FROM packets WHERE query_name = 'h7.example.org' UNION ALL SELECT 'memory' FROM k WHERE name = 'h7.example.org') GROUP BY ALL", "packets", "mem_processes")
def timeline_attribute_search(spark, sf):
    """Only attributes hold the text: a packet's query name is no column of the timeline."""
    return timeline.query(_all_sources(spark, sf), text="H7.example").groupBy("category").agg(F.count("*").alias("n"))
