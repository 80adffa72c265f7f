"""Startup configuration: systemd, cron, anacron, shell startup, autostart, preload, kernel modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions.times import strip
from tidelog.sources.accounts import of_file

# Words of schedules and units.
SPECIAL = ["@reboot", "@yearly", "@annually", "@monthly", "@weekly", "@daily", "@midnight", "@hourly"]
TIMER_KEYS = ["OnCalendar", "OnBootSec", "OnStartupSec", "OnUnitActiveSec", "OnUnitInactiveSec", "OnActiveSec"]


def systemd(lines: DataFrame) -> DataFrame:
    """One row an ExecStart or timer directive, else one a file, with the file's description and user."""
    text = strip(F.col("line"))
    rows = of_file(lines, r"\.(service|timer|socket|path|mount|target)$").filter(~text.startswith(";"))
    w = Window.partitionBy("source_path").orderBy("line_number")
    rows = rows.withColumn("section", F.last(F.nullif(F.regexp_extract(text, r"^\[(.+)\]$", 1), F.lit("")), ignorenulls=True).over(w))
    pairs = rows.filter(text.rlike(r"^[^=\[]+=")).select("source_path", "line_number", "section", strip(F.substring_index(text, "=", 1)).alias("key"), strip(F.regexp_replace(text, r"^[^=]*=", "")).alias("value"))
    last = lambda k: F.max_by(F.when(F.col("key") == k, F.col("value")), F.when(F.col("key") == k, F.col("line_number")))
    files = rows.groupBy("source_path").agg(F.min("line_number").alias("first_line"))
    attributes = pairs.groupBy("source_path").agg(last("Description").alias("description"), last("User").alias("user"), last("WantedBy").alias("wanted_by"))
    acts = pairs.filter(F.col("key").isin("ExecStart", *TIMER_KEYS)).select("source_path", "line_number", "key", F.col("value").alias("command"))
    out = files.join(attributes, "source_path", "left").join(acts, "source_path", "left")
    return out.select("source_path", F.coalesce("line_number", "first_line").alias("line_number"), F.coalesce("key", F.lit("unit")).alias("kind"), "command", "description", "user", "wanted_by")


def cron(lines: DataFrame) -> DataFrame:
    """Environment, `@special` and five-field lines; system files have a user column; other lines are MALFORMED."""
    text = strip(F.col("line"))
    rows = of_file(lines, r"(^|/)(etc/crontab$|etc/cron\.d/|var/spool/cron/)")
    system = F.col("source_path").rlike(r"(^|/)etc/")
    field = r"[0-9A-Za-z*,/\-]+"
    five = rf"^({field}\s+{field}\s+{field}\s+{field}\s+{field})\s+(.+)$"
    special = r"^(@\w+)\s+(.+)$"
    is_env, is_special, is_five = text.rlike(r"^[A-Za-z_]\w*\s*="), text.rlike(special) & F.regexp_extract(text, special, 1).isin(SPECIAL), text.rlike(five)
    rest = F.when(is_special, F.regexp_extract(text, special, 2)).when(is_five, F.regexp_extract(text, five, 2))
    with_user = system & rest.rlike(r"^\S+\s+\S")
    kind = F.when(is_env, "ENVIRONMENT").when(is_special | is_five, F.when(system & ~with_user, "MALFORMED").otherwise("JOB")).otherwise("MALFORMED")
    job = kind == "JOB"
    return rows.select(
        "source_path", "line_number", kind.alias("kind"), F.when(job, F.when(is_special, F.regexp_extract(text, special, 1)).otherwise(F.regexp_extract(text, five, 1))).alias("schedule"),
        F.when(job, F.when(system, F.regexp_extract(rest, r"^(\S+)", 1)).otherwise(F.nullif(F.regexp_extract("source_path", r"([^/]+)$", 1), F.lit("")))).alias("user"),
        F.when(job, F.when(system, F.regexp_extract(rest, r"^\S+\s+(.+)$", 1)).otherwise(rest)).alias("command"),
    )


def anacron(lines: DataFrame) -> DataFrame:
    rule = r"^(\d+|@\w+)\s+(\d+)\s+(\S+)\s+(.+)$"
    text = strip(F.col("line"))
    rows = of_file(lines, r"(^|/)etc/anacrontab$").filter(text.rlike(rule))
    return rows.select("source_path", "line_number", *(F.regexp_extract(text, rule, k).alias(n) for k, n in ((1, "period"), (2, "delay"), (3, "job"), (4, "command"))))


def shell_startup(lines: DataFrame) -> DataFrame:
    text = strip(F.col("line"))
    rows = of_file(lines, r"(^|/)(\.(bashrc|bash_profile|bash_login|profile|zshrc|zprofile)|etc/profile|etc/bash\.bashrc|etc/profile\.d/[^/]+)$")
    hint = F.when(text.startswith("export "), "export").when(text.startswith("alias "), "alias").when(text.rlike(r"^(source|\.)\s"), "source").otherwise("command")
    return rows.select("source_path", "line_number", hint.alias("hint"), text.alias("text"))


def autostart(lines: DataFrame) -> DataFrame:
    """A desktop file as one row; the last line of a key counts."""
    text = strip(F.col("line"))
    rows = of_file(lines, r"\.desktop$").filter(text.rlike(r"^[^=\[]+=")).withColumn("key", strip(F.substring_index(text, "=", 1))).withColumn("value", strip(F.regexp_replace(text, r"^[^=]*=", "")))
    last = lambda k: F.max_by(F.when(F.col("key") == k, F.col("value")), F.when(F.col("key") == k, F.col("line_number")))
    return rows.groupBy("source_path").agg(last("Name").alias("name"), last("Exec").alias("command"), last("Hidden").alias("hidden"))


def preload(lines: DataFrame) -> DataFrame:
    rows = of_file(lines, r"(^|/)etc/ld\.so\.preload$")
    return rows.select("source_path", "line_number", F.explode(F.filter(F.split("line", r"[\s:]+"), lambda t: t != "")).alias("library"))


def kernel_modules(lines: DataFrame) -> DataFrame:
    rows = of_file(lines, r"(^|/)etc/(modules$|modules-load\.d/|modprobe\.d/)").withColumn("w", F.split(strip(F.col("line")), r"\s+", 3))
    probe = F.col("source_path").contains("modprobe.d")
    return rows.select("source_path", "line_number", F.when(probe, F.col("w")[0]).otherwise("load").alias("directive"), F.when(probe, F.get("w", F.lit(1))).otherwise(F.col("w")[0]).alias("module"))


def enablement(catalogue: DataFrame) -> DataFrame:
    """Links below `*.wants` or `*.requires` of a catalogue (relative_path, link_target)."""
    rule = r"/([^/]+)\.(wants|requires)/([^/]+)$"
    rows = catalogue.filter(F.col("relative_path").rlike(rule) & F.col("link_target").isNotNull())
    return rows.select("relative_path", *(F.regexp_extract("relative_path", rule, k).alias(n) for k, n in ((1, "target"), (2, "relation"), (3, "unit"))), "link_target")


def counts(lines: DataFrame) -> DataFrame:
    """Rows by kind of configuration."""
    kinds = {"systemd": systemd, "cron": cron, "anacron": anacron, "shell_startup": shell_startup, "autostart": autostart, "preload": preload, "kernel_modules": kernel_modules}
    out = None
    for name, f in kinds.items():
        part = f(lines).select(F.lit(name).alias("category"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("category").agg(F.count("*").alias("n"))
