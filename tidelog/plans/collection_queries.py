"""Queries over all kinds of host rows at once. Lines are those of account and configuration files; SQL starts from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions import paths
from tidelog.functions.shared import materialize
from tidelog.operators import artifacts, host_artifacts
from tidelog.plans.host_queries import LOGS
from tidelog.plans.registry import Registry
from tidelog.plans.views import view
from tidelog.sources import logs

REGISTRY = Registry()
QUERIES, SQL = REGISTRY.queries, REGISTRY.sql
query = REGISTRY.query

#: Rows of startup configuration by mechanism: customers by the last digit of their key.
STARTUP = """s AS (
  SELECT CASE c_custkey % 10 WHEN 3 THEN 'systemd' WHEN 4 THEN 'cron' WHEN 5 THEN 'anacron' WHEN 6 THEN 'shell_startup' WHEN 7 THEN 'autostart' WHEN 8 THEN 'preload' ELSE 'kernel_modules' END AS mechanism, CASE WHEN c_custkey % 10 IN (6, 7) THEN 'user' ELSE 'system' END AS scope,
    CASE WHEN c_custkey % 20 = 14 AND i = 1 THEN 'MALFORMED' ELSE 'PARSED' END AS status FROM customer, (SELECT unnest([1, 2, 3]) AS i) WHERE c_custkey % 10 >= 3 AND i <= CASE c_custkey % 10 WHEN 4 THEN 3 WHEN 6 THEN 3 WHEN 8 THEN 2 WHEN 9 THEN 2 ELSE 1 END
  UNION ALL SELECT 'enablement', 'system', 'PARSED' FROM unit_links WHERE relative_path LIKE '%.wants/%' AND link_target IS NOT NULL
)"""
USERS = "u AS (SELECT * FROM account_lines WHERE source_path = 'etc/passwd' AND line <> 'broken'), g AS (SELECT * FROM account_lines WHERE source_path = 'etc/group')"


def _lines(spark, sf) -> DataFrame:
    """Written once: each kind of row reads them."""
    return materialize(view(spark, sf, "account_lines").select("source_path", "line_number", "line").unionByName(view(spark, sf, "config_lines")), "lines")


@query("startup_scopes", f"WITH {STARTUP} SELECT mechanism, scope, count(*) AS n, count(*) FILTER (status = 'MALFORMED') AS malformed FROM s GROUP BY ALL", "unit_links")
def startup_scopes(spark, sf):
    """Startup configuration by mechanism and scope."""
    return host_artifacts.startup_counts(host_artifacts.startup_rows(_lines(spark, sf), view(spark, sf, "unit_links")))


@query("account_summary", f"""WITH {USERS} SELECT 'users' AS measure, count(*) AS n FROM u UNION ALL SELECT 'privileged users', count(*) FROM u WHERE line_number = 0 UNION ALL SELECT 'groups', count(*) FROM g UNION ALL SELECT 'memberships', CAST(sum(len(list_filter(string_split(string_split(line, ':')[4], ','), lambda m: m <> ''))) AS BIGINT) FROM g
UNION ALL SELECT 'credentials', count(*) FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT 'locked', count(*) FROM customer WHERE c_custkey % 40 = 0 UNION ALL SELECT 'empty', count(*) FROM customer WHERE c_custkey % 40 = 20 UNION ALL SELECT 'with password', count(*) FROM customer WHERE c_custkey % 40 IN (10, 30)
UNION ALL SELECT 'sudo rules', count(*) FROM customer WHERE c_custkey % 20 = 1 UNION ALL SELECT 'sudo unparsed', count(*) FROM customer WHERE c_custkey % 20 = 11 UNION ALL SELECT 'sudo without password', count(*) FROM customer WHERE c_custkey % 20 = 1
UNION ALL SELECT 'ssh keys', count(*) FROM customer WHERE c_custkey % 10 = 2 UNION ALL SELECT 'key owners', count(*) FROM customer WHERE c_custkey % 10 = 2""", "account_lines")
def account_summary(spark, sf):
    """What account files hold: users, groups, credentials, privileges, keys."""
    return host_artifacts.account_summary(_lines(spark, sf))


@query("artifact_collection", f"""WITH {LOGS}, {USERS}, {STARTUP}, art AS (
  SELECT 'log' AS category, event_type AS artifact_type, 'PARSED' AS status FROM l UNION ALL SELECT 'authentication', auth_type, status FROM a UNION ALL SELECT 'account', 'user_account', 'PARSED' FROM u UNION ALL SELECT 'group', 'group', 'PARSED' FROM g
  UNION ALL SELECT 'credential_metadata', 'shadow_record', 'PARSED' FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT 'privilege', 'sudo_rule', CASE WHEN c_custkey % 20 = 1 THEN 'PARSED' ELSE 'UNPARSED' END FROM customer WHERE c_custkey % 10 = 1
  UNION ALL SELECT 'ssh_key', 'ssh_authorized_key', 'PARSED' FROM customer WHERE c_custkey % 10 = 2 UNION ALL SELECT 'persistence', mechanism, status FROM s
  UNION ALL SELECT 'filesystem', CASE doc_id % 6 WHEN 0 THEN 'auth_log' WHEN 1 THEN 'ssh_config' WHEN 2 THEN 'ssh_key' WHEN 3 THEN 'user_file' WHEN 4 THEN 'passwd' ELSE 'generic_file' END, 'collected' FROM catalogue
) SELECT category, artifact_type, status, count(*) AS n FROM art GROUP BY ALL""", "log_lines", "account_lines", "unit_links", "catalogue")
def artifact_collection(spark, sf):
    """Nine kinds of rows as artifacts, counted."""
    parsed = logs.parse_logs(view(spark, sf, "log_lines"))
    _, kind, _ = paths.classify(F.col("relative_path"))
    files = view(spark, sf, "catalogue").withColumn("artifact_type", kind).withColumn("status", F.lit("collected"))
    every = host_artifacts.collection(_lines(spark, sf), parsed, logs.authentication_rows(parsed), files, view(spark, sf, "unit_links"))
    return every.groupBy("category", "artifact_type", "status").agg(F.count("*").alias("n"))


@query("artifact_of_source_id", "SELECT 'ssh_key' AS category, source_path, line_number FROM (SELECT 'home/u' || CAST(c_custkey AS VARCHAR) || '/.ssh/authorized_keys' AS source_path, CAST(1 AS BIGINT) AS line_number FROM customer WHERE c_custkey % 10 = 2) WHERE source_path IN ('home/u2/.ssh/authorized_keys', 'home/u12/.ssh/authorized_keys')")
def artifact_of_source_id(spark, sf):
    """Artifacts found by the ids of their sources."""
    keys = view(spark, sf, "region").filter("r_regionkey < 2").select(F.concat(F.lit("home/u"), (F.col("r_regionkey") * 10 + 2).cast("string"), F.lit("/.ssh/authorized_keys:1")).alias("key"))
    found = artifacts.lineage(host_artifacts.collection(_lines(spark, sf)), keys)
    return found.select("category", "source_path", "line_number")
