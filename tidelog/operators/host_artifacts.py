"""All kinds of host rows as one artifact table, and what is told of accounts and startup configuration."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators import artifacts
from tidelog.sources import accounts, persistence


def scope(path: Column) -> Column:
    """Whether a file configures one user or the system."""
    return F.when(path.rlike(r"(^|/)(home/[^/]+|root|Users/[^/]+)/") | path.rlike(r"(^|/)var/spool/cron/"), "user").otherwise("system")


def startup_rows(lines: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """source_path, line_number, mechanism, status, scope, payload_json of every row of startup configuration."""
    kinds = {
        "systemd": persistence.systemd, "cron": persistence.cron, "anacron": persistence.anacron, "shell_startup": persistence.shell_startup,
        "autostart": persistence.autostart, "preload": persistence.preload, "kernel_modules": persistence.kernel_modules,
    }
    parts = {name: read(lines) for name, read in kinds.items()}
    if catalogue is not None:
        parts["enablement"] = persistence.enablement(catalogue).withColumn("source_path", F.col("relative_path"))
    out = []
    for name, rows in parts.items():
        line = F.col("line_number").cast("long") if "line_number" in rows.columns else F.lit(None).cast("long")
        bad = F.col("kind") == "MALFORMED" if name == "cron" else F.lit(False)
        out.append(rows.select("source_path", line.alias("line_number"), F.lit(name).alias("mechanism"), F.when(bad, "MALFORMED").otherwise("PARSED").alias("status"), scope(F.col("source_path")).alias("scope"), F.to_json(F.struct(*sorted(rows.columns))).alias("payload_json")))
    return reduce(lambda a, b: a.unionByName(b), out)


def startup_counts(startup: DataFrame) -> DataFrame:
    """By mechanism and scope: rows, and how many are malformed."""
    return startup.groupBy("mechanism", "scope").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "MALFORMED").alias("malformed"))


def collection(lines: DataFrame, logs: DataFrame | None = None, auth: DataFrame | None = None, files: DataFrame | None = None, catalogue: DataFrame | None = None) -> DataFrame:
    """Nine kinds as artifacts: files, log rows, authentication, users, groups, credentials, privileges, keys, startup configuration.

    lines are those of account and configuration files; files are catalogued ones (relative_path, artifact_type, status).
    """
    sudo = accounts.sudoers(lines).withColumn("_status", F.when(F.col("kind") == "RULE", "PARSED").otherwise("UNPARSED"))
    parts = [
        artifacts.unify(accounts.passwd(lines), "account", "user_account"), artifacts.unify(accounts.group(lines), "group", "group"), artifacts.unify(accounts.shadow(lines), "credential_metadata", "shadow_record"),
        artifacts.unify(sudo, "privilege", "sudo_rule", "_status"), artifacts.unify(accounts.authorized_keys(lines), "ssh_key", "ssh_authorized_key"), artifacts.unify(startup_rows(lines, catalogue), "persistence", "mechanism", "status"),
    ]
    if logs is not None:
        parts.append(artifacts.unify(logs, "log", "event_type"))
    if auth is not None:
        parts.append(artifacts.unify(auth, "authentication", "auth_type", "status"))
    if files is not None:
        rows = files.withColumn("source_path", F.col("relative_path")).withColumn("line_number", F.lit(None).cast("long"))
        parts.append(artifacts.unify(rows, "filesystem", "artifact_type", "status"))
    return artifacts.union(*parts)


def account_summary(lines: DataFrame) -> DataFrame:
    """measure, n: what account files hold in all."""
    users, groups, shadow, sudo, keys = accounts.passwd(lines), accounts.group(lines), accounts.shadow(lines), accounts.sudoers(lines), accounts.authorized_keys(lines)
    told = {
        users: {"users": F.count("*"), "privileged users": F.count_if("privileged")}, groups: {"groups": F.count("*"), "memberships": F.coalesce(F.sum(F.size("members")), F.lit(0))},
        shadow: {"credentials": F.count("*"), "locked": F.count_if("locked"), "empty": F.count_if("empty"), "with password": F.count_if("has_password")},
        sudo: {"sudo rules": F.count_if(F.col("kind") == "RULE"), "sudo unparsed": F.count_if(F.col("kind") == "UNPARSED"), "sudo without password": F.count_if(F.array_contains("tags", "NOPASSWD"))},
        keys: {"ssh keys": F.count("*"), "key owners": F.count_distinct("owner")},
    }
    parts = [rows.agg(*(v.cast("long").alias(k) for k, v in of.items())).unpivot([], list(of), "measure", "n") for rows, of in told.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)
