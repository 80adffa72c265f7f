"""Rows of memory tools to processes, sockets and modules, with the reason for each row refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import ids
from tidelog.functions.once import once
from tidelog.functions.times import strip

# Names of credentials in flags (`--name value`), and those that stand for themselves (`name=value`).
BARE_SECRETS = ["password", "passwd", "client[-_]secret", "access[-_]token", "auth[-_]token", "api[-_]token", "session[-_]token", "api[-_]key", "apikey", "secret[-_]key", "private[-_]key"]
FLAG_SECRETS = [*BARE_SECRETS, "secret", "token", "key"]
#: A value: quoted, with blanks inside, or up to a blank, comma, semicolon or quote.
SECRET_VALUE = r"""('[^']*'|"[^"]*"|[^\s,;'"]+)"""
SECRET_FLAGS = rf"(?i)(?<![\w-])(--?(?:{'|'.join(FLAG_SECRETS)})(?![\w-])(?:\s*[:=]\s*|\s+)){SECRET_VALUE}"
SECRET_PAIRS = rf"(?i)(?<![\w-])((?:{'|'.join(BARE_SECRETS)})(?![\w-])\s*[:=]\s*){SECRET_VALUE}"


def clean(text: Column) -> Column:
    """Without control characters and blanks around; null if nothing is left. Most values are a word, which one look tells."""
    full = F.nullif(strip(F.regexp_replace(text, r"\p{Cntrl}", "")), F.lit(""))
    return F.when(text.rlike(r"^[!-~]+$"), text).otherwise(full)


def alias(*columns: str) -> tuple[Column, Column]:
    """The first present of several columns for one field, and whether they disagree."""
    values = [clean(F.col(c).cast("string")) for c in columns]
    return F.coalesce(*values), F.size(F.array_distinct(F.array_compact(F.array(*values)))) > 1


def number(text: Column) -> Column:
    """Decimal or 0x hexadecimal, null if neither."""
    return F.when(text.rlike(r"^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(text, 3, 15), 16, 10).try_cast("long")).when(text.rlike(r"^\d{1,18}$"), text.try_cast("long"))


def redact(text: Column) -> Column:
    """Credential values replaced, the name in front of them kept. Bare `key`, `secret` and `token` are ordinary words."""
    return F.regexp_replace(F.regexp_replace(text, SECRET_FLAGS, "$1[REDACTED]"), SECRET_PAIRS, "$1[REDACTED]")


def read_tool_json(text: DataFrame) -> DataFrame:
    """Rows (source, row_index, row map, reason) of tool output (source, value).

    The document is a list of rows, an object with such a list under `rows` or `data`, or one row by itself;
    lines before the first that begins with a bracket or brace are log lines. Where no such line begins a document
    that can be read, a list may begin and end inside lines: from the first bracket to the last. A text without a
    document, or with one that cannot be read, gives one row with a reason and no map.
    """
    body = F.regexp_extract("value", r"(?s)(?:^|\n)[ \t]*([\[{].*)", 1)
    mode = {"mode": "PERMISSIVE", "allowNonNumericNumbers": "true"}
    as_list = F.from_json("_body", "array<map<string,string>>", mode)
    inner = F.from_json("_body", "struct<rows: array<map<string,string>>, data: array<map<string,string>>>", mode)
    alone = F.from_json("_body", "map<string,string>", mode)
    parsed = (
        F.when(F.col("_body").startswith("["), as_list)
        .otherwise(F.coalesce(inner["rows"], inner["data"], F.when(F.size(alone) > 0, F.array(alone))))
    )
    inside = F.from_json(F.regexp_extract("value", r"(?s)(\[.*\])", 1), "array<map<string,string>>", mode)
    read = text.withColumn("_body", body).withColumn("_body", F.when(F.col("_body") == "", F.regexp_extract("value", r"(?s)([\[{].*)", 1)).otherwise(F.col("_body")))
    read = read.select("source", "_body", F.coalesce(parsed, inside).alias("_rows"))
    good = read.filter("_rows is not null").select("source", F.posexplode("_rows").alias("row_index", "row"), F.lit(None).cast("string").alias("reason"))
    reason = F.when(F.col("_body") == "", "NO_DOCUMENT").otherwise("UNREADABLE_DOCUMENT")
    bad = read.filter("_rows is null").select("source", F.lit(None).cast("int").alias("row_index"), F.lit(None).cast("map<string,string>").alias("row"), reason.alias("reason"))
    return good.unionByName(bad)


def split_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows, and refused rows with their reason."""
    return rows.filter("reason is null").drop("reason"), rows.filter("reason is not null")


def collapse(rows: DataFrame, content: list[str]) -> DataFrame:
    """Exact duplicates as one row with the list of their row indices and their number."""
    return rows.groupBy(*content).agg(F.array_sort(F.collect_list("row_index")).alias("row_indices"), (F.count("*") - 1).alias("duplicates"))


def processes(rows: DataFrame) -> DataFrame:
    """pid, ppid, name, created_us, image_path with the reason for refusal (null: accepted)."""
    pid_text, conflict = alias("pid_upper", "pid_mixed")
    fields = F.struct(pid_text.alias("pid_text"), conflict.alias("conflict"), number(pid_text).alias("pid"), number(clean(F.col("ppid_text"))).alias("ppid"), clean(F.col("image_name")).alias("name"), clean(F.col("image_path")).alias("path"))
    rows = once(rows, "_f", fields)
    pid_text, conflict, pid, ppid, name, path = (F.col(f"_f.{c}") for c in ("pid_text", "conflict", "pid", "ppid", "name", "path"))
    reason = F.when(conflict, "CONFLICTING_ALIASES").when(pid_text.isNull(), "MISSING_PID").when(pid.isNull(), "INVALID_PID").when(name.isNull(), "MISSING_NAME")
    return rows.select("evidence_id", "plugin", "execution_id", "row_index", pid.alias("pid"), ppid.alias("ppid"), name.alias("name"), (F.col("created_sec") * 1_000_000).alias("created_us"), path.alias("image_path"), reason.alias("reason"))


PROCESS = ["evidence_id", "plugin", "execution_id", "pid", "ppid", "name", "created_us", "image_path"]


def process_artifacts(rows: DataFrame) -> DataFrame:
    """Accepted processes, duplicates collapsed, with a deterministic id."""
    kept, _ = split_rows(processes(rows))
    return collapse(kept, PROCESS).withColumn("artifact_id", ids.uuid5(ids.namespace("process"), ids.joined(*map(F.col, PROCESS))))


def sockets(rows: DataFrame) -> DataFrame:
    """protocol, addresses, ports, state, pid with the reason for refusal."""
    rows = once(rows, "_f", F.struct(number(clean(F.col("local_port"))).alias("port"), number(clean(F.col("pid_text"))).alias("pid")))
    port, pid = F.col("_f.port"), F.col("_f.pid")
    reason = F.when(port.isNull() | ~port.between(0, 65535), "INVALID_PORT").when(pid.isNull(), "INVALID_PID")
    return rows.select("evidence_id", "row_index", F.regexp_extract(F.upper("proto"), r"^(TCP|UDP)", 1).alias("protocol"), "local_addr", port.alias("local_port"), "foreign_addr", F.upper("state").alias("state"), pid.alias("pid"), reason.alias("reason"))


SOCKET = ["evidence_id", "row_index", "protocol", "local_addr", "local_port", "foreign_addr", "state", "pid"]


def socket_artifacts(rows: DataFrame) -> DataFrame:
    kept, _ = split_rows(sockets(rows))
    return kept.withColumn("artifact_id", ids.uuid5(ids.namespace("socket"), ids.joined(*map(F.col, SOCKET))))


def modules(rows: DataFrame) -> DataFrame:
    """name, path, base, size with the reason for refusal."""
    rows = once(rows, "_f", F.struct(number(F.col("base_text")).alias("base"), number(clean(F.col("size_text"))).alias("size")))
    base, size = F.col("_f.base"), F.col("_f.size")
    reason = F.when(base.isNull(), "INVALID_BASE").when(size.isNull(), "INVALID_SIZE")
    return rows.select("evidence_id", "row_index", clean(F.col("name_text")).alias("name"), clean(F.col("path_text")).alias("path"), base.alias("base"), size.alias("size"), reason.alias("reason"))


def module_artifacts(rows: DataFrame) -> DataFrame:
    kept, _ = split_rows(modules(rows))
    return kept.withColumn("artifact_id", ids.uuid5(ids.namespace("module"), ids.joined(*(F.col(c) for c in ("evidence_id", "row_index", "name", "path", "base", "size")))))


def totals(rows: DataFrame) -> DataFrame:
    """Per evidence: rows, valid, rejected."""
    return rows.groupBy("evidence_id").agg(F.count("*").alias("n_rows"), F.count_if(F.col("reason").isNull()).alias("valid"), F.count_if(F.col("reason").isNotNull()).alias("rejected"))
