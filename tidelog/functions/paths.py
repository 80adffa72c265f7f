"""Paths: normal form, classification, safety."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Known host artifacts, (path or glob, category, type); `*` also crosses `/`.
KNOWN = [
    ("etc/passwd", "account", "passwd"),
    ("etc/group", "account", "group"),
    ("etc/shadow", "account", "shadow"),
    ("etc/gshadow", "account", "group"),
    ("etc/hosts", "host_config", "hosts"),
    ("etc/hostname", "host_config", "hostname"),
    ("etc/resolv.conf", "host_config", "resolv_conf"),
    ("etc/os-release", "host_config", "os_release"),
    ("usr/lib/os-release", "host_config", "os_release"),
    ("etc/issue", "host_config", "issue"),
    ("etc/issue.net", "host_config", "issue"),
    ("var/log/auth.log*", "log", "auth_log"),
    ("var/log/secure*", "log", "auth_log"),
    ("var/log/syslog*", "log", "syslog"),
    ("var/log/messages*", "log", "messages"),
    ("etc/ssh/*", "ssh", "ssh_config"),
    ("home/*/.ssh/authorized_keys*", "ssh", "ssh_authorized_keys"),
    ("root/.ssh/authorized_keys*", "ssh", "ssh_authorized_keys"),
    ("home/*/.ssh/known_hosts*", "ssh", "ssh_known_hosts"),
    ("root/.ssh/known_hosts*", "ssh", "ssh_known_hosts"),
    ("home/*/.ssh/id_*", "ssh", "ssh_key"),
    ("root/.ssh/id_*", "ssh", "ssh_key"),
    ("home/*/.ssh/*", "ssh", "ssh_config"),
    ("root/.ssh/*", "ssh", "ssh_config"),
    ("home/*/*", "user_fs", "user_file"),
    ("root/*", "user_fs", "user_file"),
]


def normalize_path(path: Column) -> Column:
    """Forward slashes, no leading `/` or `./`."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./|/)+", "")


def classify(path: Column) -> tuple[Column, Column, Column]:
    """(category, type, known) by the first rule that matches."""
    p = normalize_path(path)
    category, kind = F.lit("generic"), F.lit("generic_file")
    for glob, cat, typ in reversed(KNOWN):
        hit = p.rlike("(?s)^" + ".*".join(x.replace(".", r"\.") for x in glob.split("*")) + "$") if "*" in glob else p == glob
        category, kind = F.when(hit, cat).otherwise(category), F.when(hit, typ).otherwise(kind)
    return category, kind, category != "generic"


def entry_path_status(path: Column) -> Column:
    """`ok`, or why a manifest entry's path is refused."""
    return (
        F.when(path.isNull() | (F.trim(path) == ""), "empty").when(path.contains("\\"), "backslash").when(path.rlike(r"^[A-Za-z]:"), "drive")
        .when(path.startswith("/"), "absolute").when(path.endswith("/"), "trailing_slash").when(path.rlike(r"(^|/)\.\.(/|$)"), "parent")
        .when(path.rlike(r"(^|/)\.(/|$)") | path.contains("//"), "segment").otherwise("ok")
    )
