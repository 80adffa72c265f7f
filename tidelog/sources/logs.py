"""System log lines to typed rows, and authentication rows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import times
from tidelog.functions.once import once
from tidelog.functions.times import group, strip

# Header and message patterns, event types, authentication services.
ISO_HEADER = r"(?U)^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?)\s+([^\s:]+)\s+([^:\[\s]+)(?:\[(\d+)\])?:\s*(.*)$"
BSD_HEADER = r"(?U)^([A-Z][a-z]{2}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+([^\s:]+)\s+([^:\[\s]+)(?:\[(\d+)\])?:\s*(.*)$"
ACCEPTED = r"(?U)^Accepted\s+(password|publickey|keyboard-interactive(?:/pam)?)\s+for\s+(\S+)\s+from\s+(\S+)\s+port\s+(\d+)"
FAILED_INVALID = r"(?U)^Failed\s+(password|publickey)\s+for\s+invalid\s+user\s+(\S+)\s+from\s+(\S+)\s+port\s+(\d+)"
FAILED = r"(?U)^Failed\s+(password|publickey)\s+for\s+(\S+)\s+from\s+(\S+)\s+port\s+(\d+)"
INVALID_USER = r"(?U)^Invalid\s+user\s+(\S+)\s+from\s+(\S+)(?:\s+port\s+(\d+))?"
SUDO = r"(?U)^\s*(\S+)\s*:\s*TTY=(\S+)\s*;\s*PWD=(\S+)\s*;\s*USER=(\S+)\s*;\s*COMMAND=(.*)$"
OPENED = r"(?U)session opened for user\s+(\S+)"
CLOSED = r"(?U)session closed for user\s+(\S+)"
PAM_FAILURE = r"(?U)authentication failure;\s*(?:logname=(\S*))?\s*(?:uid=(\S*))?\s*(?:euid=(\S*))?\s*(?:tty=(\S*))?\s*(?:ruser=(\S*))?\s*(?:rhost=(\S*))?\s*(?:user=(\S*))?"
AUTH_SERVICES = ["sshd", "sudo", "su", "login", "pam", "pam_unix", "polkit"]
AUTH_FILES = ["auth.log", "secure"]
STATUS = {
    "ssh_login_success": "SUCCESS",
    "ssh_login_failure": "FAILURE",
    "ssh_invalid_user": "FAILURE",
    "sudo_command": "INFO",
    "session_open": "SUCCESS",
    "session_close": "INFO",
    "authentication_failure": "FAILURE",
    "unknown_auth_event": "UNKNOWN",
}


#: Stands between fields taken from one text that does not hold it.
SEPARATOR = "\u0001"


def take(text: Column, pattern: str, groups) -> Column:
    """The groups of the first match (0: an empty text) as an array; an array of the text alone where nothing matches.

    All groups are taken in one pass over the text, with separators between them that are split at again. A text
    that holds the separator itself (nobody but the writer of a line decides what is in it) has each group taken
    by its own pass. On ASCII text the classes of the plain pattern are those of the Unicode one, and much faster.
    """
    body = pattern.removeprefix("(?U)").removesuffix("$")
    whole = (body if body.startswith("^") else "^.*?" + body) + ".*$"
    put = SEPARATOR.join(f"${g}" if g else "" for g in groups)
    ascii_only = F.octet_length(text) == F.char_length(text)
    joined = F.when(ascii_only, F.regexp_replace(text, "(?s)" + whole, put)).otherwise(F.regexp_replace(text, "(?sU)" + whole, put))
    apart = F.array(*(F.regexp_extract(text, "(?sU)" + whole, g) if g else F.lit("") for g in groups))
    slow = F.when(text.rlike("(?sU)" + whole), apart).otherwise(F.array(text))
    return F.when(text.contains(SEPARATOR), slow).otherwise(F.split(joined, SEPARATOR))


def matches(text: Column, pattern: str) -> Column:
    plain = pattern.removeprefix("(?U)")
    return F.when(F.octet_length(text) == F.char_length(text), text.rlike(plain)).otherwise(text.rlike("(?U)" + plain))


def parse_header(lines: DataFrame, year: int | None = None) -> DataFrame:
    """lines with raw_timestamp, ts_class, ts_us, hostname, service, pid, message; the ISO header is tried first."""
    line, first = F.col("line"), F.substring("line", 1, 1)
    # an ISO header begins with a digit (of any script), one without a year with an ASCII capital
    capital = first.between("A", "Z")
    header = F.when(capital, take(line, BSD_HEADER, range(1, 6))).otherwise(take(line, ISO_HEADER, range(1, 6)))
    out = once(lines, "_f", header)
    part = lambda n: F.nullif(F.get("_f", F.lit(n)), F.lit(""))
    held = F.size("_f") > 1
    out = out.withColumn("raw_timestamp", F.when(held, part(0))).withColumn("hostname", part(1)).withColumn("service", part(2)).withColumn("pid", part(3).try_cast("long"))
    message = F.when(held, F.get("_f", F.lit(4))).otherwise(line)
    raw = F.col("raw_timestamp")
    # the header has checked the form of an ISO time: only its zone and the digits of its fraction are left to tell
    zone = F.when(raw.endswith("Z"), 1).when(F.substring(raw, -6, 1).isin("+", "-"), 6).otherwise(0)
    plain = ~F.substring(raw, 1, 1).between("A", "Z") & (F.char_length(raw) - zone <= 26)
    quick_us = F.unix_micros(F.try_to_timestamp(F.when(zone == 0, F.concat(raw, F.lit("+00:00"))).otherwise(raw)))
    quick = F.when(plain & quick_us.isNotNull(), F.struct(F.when(zone == 0, times.NAIVE).otherwise(times.AWARE).alias("c"), quick_us.alias("us")))
    out = once(out.withColumn("message", message).drop("_f"), "_q", quick)
    ts_class, ts_us = times.normalize(raw)
    slow_us = F.coalesce(ts_us, times.normalize_bsd(raw, year))
    slow = F.struct(F.when(ts_us.isNull(), times.NAIVE).otherwise(ts_class).alias("c"), slow_us.alias("us"))
    out = once(out, "_t", F.coalesce(F.col("_q"), F.when(raw.isNotNull(), slow)))
    us = F.col("_t.us")
    return out.withColumn("ts_us", us).withColumn("ts_class", F.when(us.isNull(), times.MISSING).otherwise(F.col("_t.c"))).drop("_t", "_q")


def classify(parsed: DataFrame, strip_uid: bool = False) -> DataFrame:
    """parsed with event_type and user, src_ip, src_port, auth_method, tty, pwd, target_user, command; first match wins.

    `session opened for user alice(uid=1000)` keeps the user text as written; strip_uid removes `(uid=...)`.
    """
    m, service = F.col("message"), F.lower(F.coalesce("service", F.lit("")))
    ssh, sudo, known = service.contains("sshd"), service.contains("sudo"), F.col("service").isNotNull()
    kinds = [  # type, condition with the pattern's literal words, pattern, {column: group}
        ("ssh_login_success", ssh & m.startswith("Accepted"), ACCEPTED, {"auth_method": 1, "user": 2, "src_ip": 3, "src_port": 4}),
        ("ssh_invalid_user", ssh & m.startswith("Failed") & m.contains("invalid"), FAILED_INVALID, {"auth_method": 1, "user": 2, "src_ip": 3, "src_port": 4}),
        ("ssh_login_failure", ssh & m.startswith("Failed"), FAILED, {"auth_method": 1, "user": 2, "src_ip": 3, "src_port": 4}),
        ("ssh_invalid_user", ssh & m.startswith("Invalid"), INVALID_USER, {"user": 1, "src_ip": 2, "src_port": 3}),
        ("sudo_command", sudo & m.contains("COMMAND="), SUDO, {"user": 1, "tty": 2, "pwd": 3, "target_user": 4, "command": 5}),
        ("session_open", m.contains("session opened for user"), OPENED, {"user": 1}),
        ("session_close", m.contains("session closed for user"), CLOSED, {"user": 1}),
    ]
    named = ["user", "src_ip", "src_port", "auth_method", "tty", "pwd", "target_user", "command"]
    found = None
    for name, test, pattern, at in kinds:  # one match and one rewrite a row
        fields = F.concat(F.array(F.lit(name)), take(m, pattern, [at.get(c, 0) for c in named]))
        test = test & matches(m, pattern)
        found = F.when(test, fields) if found is None else found.when(test, fields)
    out = once(parsed, "_f", F.when(known, found))
    out = out.withColumn("event_type", F.coalesce(F.col("_f")[0], F.when(known, F.lit("generic_syslog")).otherwise("unknown_format")))
    for k, col in enumerate(named):
        value = F.nullif(F.col("_f")[k + 1], F.lit(""))
        value = F.regexp_replace(value, r"\(uid=\d+\)$", "") if col == "user" and strip_uid else strip(value) if col == "command" else value
        out = out.withColumn(col, value.try_cast("int") if col == "src_port" else value)
    return out.drop("_f")


def parse_logs(lines: DataFrame, year: int | None = None) -> DataFrame:
    """Every line as a typed row; blank and unrecognised lines stay as `unknown_format`."""
    return classify(parse_header(lines, year))


def log_counts(logs: DataFrame) -> DataFrame:
    """Per file: total, parsed, unrecognised."""
    return logs.groupBy("source_path").agg(
        F.count("*").alias("total"), F.count_if(F.col("event_type") != "unknown_format").alias("parsed"), F.count_if(F.col("event_type") == "unknown_format").alias("unrecognised")
    )


def log_counts_by_type(logs: DataFrame) -> DataFrame:
    return logs.groupBy("source_path", "event_type").agg(F.count("*").alias("n"))


def is_auth_source(path: Column) -> Column:
    name = F.lower(F.substring_index(path, "/", -1))
    return name.contains(AUTH_FILES[0]) | name.contains(AUTH_FILES[1])


def is_auth_service(service: Column) -> Column:
    s = F.lower(F.coalesce(service, F.lit("")))
    return s.rlike("|".join(AUTH_SERVICES))


def with_authentication(logs: DataFrame) -> DataFrame:
    """logs with auth_type, status, username, source_ip; auth_type is null where a row is no authentication activity.

    A PAM failure takes the user, else the remote user, and the remote host as its source.
    """
    m = F.col("message")
    pam = m.contains("authentication failure")
    direct = F.col("event_type").isin("ssh_login_success", "ssh_login_failure", "ssh_invalid_user", "sudo_command", "session_open", "session_close")
    auth_type = F.when(direct, F.col("event_type")).when(pam, "authentication_failure").when(is_auth_source(F.col("source_path")) | is_auth_service(F.col("service")), "unknown_auth_event")
    status = F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv))
    pam_user = F.coalesce(group(m, PAM_FAILURE, 7), group(m, PAM_FAILURE, 5))
    return (
        once(logs, "auth_type", auth_type)
        .withColumn("status", status[F.col("auth_type")])
        .withColumn("username", F.when(F.col("auth_type") == "authentication_failure", pam_user).when(direct, F.col("user")))
        .withColumn("source_ip", F.when(F.col("auth_type") == "authentication_failure", group(m, PAM_FAILURE, 6)).when(direct, F.col("src_ip")))
    )


def authentication_rows(logs: DataFrame) -> DataFrame:
    """The rows of authentication activity."""
    return with_authentication(logs).filter(F.col("auth_type").isNotNull())


def pam_detail(logs: DataFrame) -> DataFrame:
    """source_path, line_number and the seven fields of PAM failures."""
    names = ["logname", "uid", "euid", "tty", "ruser", "rhost", "pam_user"]
    rows = logs.filter(F.col("message").contains("authentication failure"))
    return rows.select("source_path", "line_number", *(group(F.col("message"), PAM_FAILURE, k + 1).alias(n) for k, n in enumerate(names)))


def authentication_summary(auth: DataFrame) -> DataFrame:
    return auth.groupBy("auth_type", "status").agg(F.count("*").alias("n"), F.count("username").alias("with_user"), F.count("source_ip").alias("with_source"))


def uncovered(logs: DataFrame) -> DataFrame:
    """Rows that are no authentication activity, told in the pass that reads them."""
    return with_authentication(logs).filter(F.col("auth_type").isNull())


def without_covered_logs(logs: DataFrame, auth: DataFrame) -> DataFrame:
    """logs whose path and line no authentication row has."""
    return logs.join(auth.select("source_path", "line_number").distinct(), ["source_path", "line_number"], "left_anti")


def first_lines(lines: DataFrame, most: int = 25) -> DataFrame:
    """The shebang and the first significant lines of each script, `most` of them."""
    rows = lines.filter((strip(F.col("line")) != "") & (~strip(F.col("line")).startswith("#") | F.col("line").startswith("#!")))
    w = Window.partitionBy("source_path").orderBy("line_number")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)
