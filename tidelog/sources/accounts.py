"""Account files: passwd, group, shadow, sudoers, authorized keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.times import strip

# Hash families by prefix, key types.
HASHES = {"$1$": "md5", "$2a$": "bcrypt", "$2b$": "bcrypt", "$2y$": "bcrypt", "$5$": "sha256", "$6$": "sha512", "$y$": "yescrypt"}
KEY_TYPES = ["ssh-rsa", "ssh-dss", "ssh-ed25519", "ecdsa-sha2-nistp256", "ecdsa-sha2-nistp384", "ecdsa-sha2-nistp521", "sk-ssh-ed25519@openssh.com", "sk-ecdsa-sha2-nistp256@openssh.com"]


def of_file(lines: DataFrame, pattern: str) -> DataFrame:
    """Significant lines of the files whose path matches."""
    return lines.filter(F.col("source_path").rlike(pattern) & (strip(F.col("line")) != "") & ~strip(F.col("line")).startswith("#"))


def passwd(lines: DataFrame) -> DataFrame:
    """Exactly 7 fields with integer ids; uid 0 is privileged; other lines are left out."""
    f = F.split("line", ":", -1)
    rows = of_file(lines, r"(^|/)etc/passwd$").withColumn("f", f).filter(F.size("f") == 7)
    out = rows.select("source_path", "line_number", F.get("f", F.lit(0)).alias("username"), F.get("f", F.lit(2)).try_cast("long").alias("uid"), F.get("f", F.lit(3)).try_cast("long").alias("gid"), F.get("f", F.lit(4)).alias("gecos"), F.get("f", F.lit(5)).alias("home"), F.get("f", F.lit(6)).alias("shell"))
    return out.filter("uid is not null and gid is not null").withColumn("privileged", F.col("uid") == 0)


def group(lines: DataFrame) -> DataFrame:
    """4 fields; members as an array."""
    rows = of_file(lines, r"(^|/)etc/group$").withColumn("f", F.split("line", ":", -1)).filter(F.size("f") == 4)
    members = F.filter(F.transform(F.split(F.get("f", F.lit(3)), ","), strip), lambda m: m != "")
    return rows.select("source_path", "line_number", F.get("f", F.lit(0)).alias("group_name"), F.get("f", F.lit(2)).try_cast("long").alias("gid"), members.alias("members")).filter("gid is not null")


def shadow(lines: DataFrame) -> DataFrame:
    """Locked, empty, has a password, hash family; the hash itself is not shown."""
    rows = of_file(lines, r"(^|/)etc/shadow$").withColumn("f", F.split("line", ":", -1)).filter(F.size("f") >= 2)
    h = F.get("f", F.lit(1))
    family = F.coalesce(*(F.when(F.ltrim(h, F.lit("!")).startswith(k), v) for k, v in HASHES.items()), F.when(h.rlike(r"^[./0-9A-Za-z]{13}$"), "des"))
    locked = h.startswith("!") | h.startswith("*")
    return rows.select("source_path", "line_number", F.get("f", F.lit(0)).alias("username"), locked.alias("locked"), (h == "").alias("empty"), (~locked & (h != "")).alias("has_password"), family.alias("hash_family"), F.when(h == "", "").when(h.isin("*", "!", "!!", "x"), h).otherwise("[REDACTED]").alias("hash"))


def sudoers(lines: DataFrame) -> DataFrame:
    """user, host, runas, tags, commands; aliases stay as UNPARSED; Defaults are left out."""
    rule = r"^(\S+)\s+([^=\s]+)\s*=\s*(?:\(([^)]*)\)\s*)?((?:[A-Z_]+:\s*)*)(.*)$"
    line = strip(F.col("line"))
    rows = of_file(lines, r"(^|/)etc/sudoers").filter(~line.startswith("Defaults"))
    parsed = line.rlike(rule) & ~line.rlike(r"^(User|Host|Cmnd|Runas)_Alias\b")
    part = lambda n: F.when(parsed, F.nullif(F.regexp_extract(line, rule, n), F.lit("")))
    tags = F.filter(F.split(F.regexp_replace(F.coalesce(part(4), F.lit("")), r"\s", ""), ":"), lambda t: t != "")
    commands = F.filter(F.transform(F.split(F.coalesce(part(5), F.lit("")), ","), strip), lambda c: c != "")
    return rows.select("source_path", "line_number", F.when(parsed, "RULE").otherwise("UNPARSED").alias("kind"), part(1).alias("principal"), part(2).alias("host"), part(3).alias("runas"), tags.alias("tags"), commands.alias("commands"))


def authorized_keys(lines: DataFrame) -> DataFrame:
    """Key type among the known ones, comment, owner by the path."""
    rows = of_file(lines, r"\.ssh/authorized_keys").withColumn("w", F.split(strip(F.col("line")), r"\s+"))
    kind = F.filter("w", lambda x: x.isin(KEY_TYPES))
    at = F.array_position("w", F.get(kind, F.lit(0)))
    owner = F.coalesce(F.nullif(F.regexp_extract("source_path", r"home/([^/]+)/", 1), F.lit("")), F.when(F.col("source_path").rlike(r"(^|/)root/"), "root"))
    comment = F.array_join(F.slice("w", (at + 2).cast("int"), 100), " ")
    return rows.filter(F.size(kind) > 0).select("source_path", "line_number", owner.alias("owner"), F.get(kind, F.lit(0)).alias("key_type"), F.nullif(comment, F.lit("")).alias("comment"))


def relationships(users: DataFrame, groups: DataFrame) -> DataFrame:
    """Each user's primary group by gid (the last line of a repeated gid) and its further groups, sorted."""
    primary = groups.groupBy("gid").agg(F.max_by("group_name", "line_number").alias("primary_group"))
    member = groups.select("group_name", F.explode("members").alias("username")).groupBy("username").agg(F.array_sort(F.collect_set("group_name")).alias("further"))
    return users.join(primary, "gid", "left").join(member, "username", "left").select("username", "uid", "gid", "primary_group", F.coalesce("further", F.array().cast("array<string>")).alias("further"))


def totals(lines: DataFrame) -> DataFrame:
    users, groups = passwd(lines), group(lines)
    return users.agg(F.count("*").alias("users"), F.count_if("privileged").alias("privileged")).crossJoin(groups.agg(F.count("*").alias("groups"), F.sum(F.size("members")).alias("memberships")))  # one row each
