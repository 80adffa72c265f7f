"""Rows of memory tools that list sockets, whatever their columns are called, to sockets with both ends, or a reason why not."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import ids, times
from tidelog.functions.once import once_each
from tidelog.sources.memory import collapse

# Names of columns by field, first to last, for plugins of Linux and for all others; texts that stand for nothing.
LINUX = {
    "protocol": ["Proto", "Protocol", "Family"],
    "local_address": ["Local Address", "LocalAddr", "Local IP", "LocalIP", "LAddr"],
    "local_port": ["Local Port", "LocalPort", "LPort"],
    "remote_address": ["Foreign Address", "ForeignAddr", "Remote Address", "RemoteAddr", "Remote IP", "RemoteIP", "RAddr"],
    "remote_port": ["Foreign Port", "ForeignPort", "Remote Port", "RemotePort", "RPort"],
    "state": ["State", "Status"],
    "pid": ["PID", "Pid", "pid"],
    "process_name": ["COMM", "Process", "Process Name", "ImageFileName", "Name"],
    "offset": ["Offset", "Offset(V)", "Offset(P)"],
    "created": ["Created", "CreateTime", "CreationTime"],
}
OTHERS = LINUX | {
    "protocol": ["Proto", "Protocol"],
    "remote_address": ["ForeignAddr", "Foreign Address", "RemoteAddr", "Remote Address", "Remote IP", "RAddr"],
    "pid": ["PID", "Pid", "OwnerPID", "pid"],
    "process_name": ["Owner", "Process", "Process Name", "ImageFileName", "Name"],
    "created": ["Created", "CreateTime", "CreationTime", "TimeCreated"],
}
NOTHING = ["", "n/a", "none", "null", "-"]
SOCKET = ["evidence_id", "plugin", "execution_id", "protocol", "local_address", "local_port", "remote_address", "remote_port", "state", "pid", "process_name", "offset", "created_class", "created_us"]


def word(value: Column, also: tuple[str, ...] = ()) -> Column:
    """Without control characters and blanks around; null if it stands for nothing."""
    bare = times.strip(value)
    clean = F.nullif(times.strip(F.regexp_replace(bare, r"[\x00-\x1f\x7f-\x9f]", "")), F.lit(""))
    return F.when(~F.lower(bare).isin(*NOTHING, *also), clean)


def whole(value: Column) -> Column:
    """A decimal or 0x hexadecimal number; null if it is neither."""
    v = times.strip(value)
    return F.when(v.rlike("^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(v, 3, 15), 16, 10).try_cast("long")).when(v.rlike("^[0-9]{1,18}$"), v.try_cast("long"))


#: Stands for what is no port.
NO_PORT = 65536


def port(value: Column) -> Column:
    """A port; null for none, NO_PORT for what is no port."""
    return F.when(value.isNotNull() & ~F.lower(times.strip(value)).isin(*NOTHING, "*"), F.least(F.coalesce(whole(value), F.lit(NO_PORT)), F.lit(NO_PORT).cast("long")))


def address(value: Column) -> Column:
    clean = word(value, ("*:*",))
    return F.nullif(F.lower(times.strip(F.regexp_replace(clean, r"^\[(.*)\]$", "$1"))), F.lit(""))


def in_two(raw: Column) -> tuple[Column, Column]:
    """An address without blanks around, and the port inside it, if it is written as `[v6]:port` or `v4:port`."""
    bracketed, brackets = raw.startswith("[") & raw.contains("]:"), r"(?s)^\[(.*?)\]:(.*)$"
    joined = ~raw.startswith(":") & (F.length(raw) - F.length(F.replace(raw, F.lit(":"))) == 1)
    split = F.when(bracketed, F.regexp_extract(raw, brackets, 1)).when(joined, F.substring_index(raw, ":", 1)).otherwise(raw)
    return split, F.when(bracketed, F.regexp_extract(raw, brackets, 2)).when(joined, F.substring_index(raw, ":", -1))


def _field(name: str, normal: Callable[[Column], Column]) -> tuple[Column, Column]:
    """The first of a field's columns that a row has, normalised, and whether others of them disagree."""
    def of(names: list[str]) -> Column:
        given = F.filter(F.array(*(F.try_element_at("row", F.lit(n)) for n in names)), lambda v: v.isNotNull() & (times.strip(v) != ""))
        return F.transform(given, lambda v: F.struct(normal(v).alias("v")))

    linux = F.lower("plugin").contains("linux") | F.lower("plugin").contains("sockstat")
    found = of(LINUX[name]) if LINUX[name] == OTHERS[name] else F.when(linux, of(LINUX[name])).otherwise(of(OTHERS[name]))
    return F.get(found, F.lit(0))["v"], F.size(F.array_distinct(found)) > 1


def sockets(rows: DataFrame) -> DataFrame:
    """evidence_id, plugin, execution_id, row_index, the fields of a socket and the reason for refusal (null: accepted) of rows (row: a map of texts)."""
    same = lambda v: v
    upper = lambda v: F.upper(word(v))
    number = lambda v: F.when(word(v).isNotNull(), whole(v))
    hexadecimal = lambda v: F.concat(F.lit("0x"), F.lower(F.conv(number(v), 10, 16)))
    moment = lambda v: F.struct(*(x.alias(n) for x, n in zip(times.normalize(F.when(word(v) != "0", word(v))), ("c", "us"))))
    normal = {"protocol": upper, "state": lambda v: F.upper(word(v, ("*",))), "pid": number, "process_name": word, "offset": hexadecimal, "created": moment}
    read = {n: _field(n, normal.get(n, same)) for n in LINUX}
    kept = rows.select("evidence_id", "plugin", "execution_id", "row_index", "row")
    out = once_each(kept, {f"_{n}": v for n, (v, _) in read.items()} | {f"_{n}_differs": c for n, (_, c) in read.items()} | {"_given": _pid_given()})
    f = lambda n: F.col(f"_{n}")
    # step by step, each evaluated once a row: a port of its own comes before one inside the address
    out = once_each(out, {"_l": times.strip(f("local_address")), "_r": times.strip(f("remote_address"))})
    (la, lh), (ra, rh) = in_two(F.col("_l")), in_two(F.col("_r"))
    out = once_each(out, {"_la": la, "_lh": lh, "_ra": ra, "_rh": rh})
    ends = {"_local": address(F.col("_la")), "_remote": address(F.col("_ra")), "_lp": F.coalesce(port(f("local_port")), port(F.col("_lh"))), "_rp": F.coalesce(port(f("remote_port")), port(F.col("_rh")))}
    out = once_each(out, ends)
    differs = lambda *names: F.coalesce(*(F.when(f(f"{n}_differs"), "CONFLICTING_ALIASES") for n in names), F.lit(None).cast("string"))
    reason = F.coalesce(
        differs("protocol"), F.when(f("protocol").isNull(), "MISSING_PROTOCOL"), differs("local_address", "local_port"), F.when(F.col("_lp") == NO_PORT, "INVALID_PORT"),
        differs("remote_address", "remote_port"), F.when(F.col("_rp") == NO_PORT, "INVALID_PORT"), differs("state", "pid"), F.when(f("given") & f("pid").isNull(), "INVALID_PID"), differs("process_name", "offset", "created"),
    )
    created = F.when(F.col("_created.us").isNotNull(), F.col("_created.c"))
    return out.select(
        "evidence_id", "plugin", "execution_id", "row_index", f("protocol").alias("protocol"), F.col("_local").alias("local_address"), F.nullif(F.col("_lp"), F.lit(NO_PORT)).alias("local_port"), F.col("_remote").alias("remote_address"), F.nullif(F.col("_rp"), F.lit(NO_PORT)).alias("remote_port"),
        f("state").alias("state"), f("pid").alias("pid"), f("process_name").alias("process_name"), f("offset").alias("offset"), created.alias("created_class"), F.col("_created.us").alias("created_us"), F.when(F.col("row").isNull(), "MALFORMED_RECORD").otherwise(reason).alias("reason"),
    )


def _pid_given() -> Column:
    """Whether any column of the pid holds something."""
    names = sorted({*LINUX["pid"], *OTHERS["pid"]})
    linux = F.lower("plugin").contains("linux") | F.lower("plugin").contains("sockstat")
    held = lambda ns: F.exists(F.array(*(F.try_element_at("row", F.lit(n)) for n in ns)), lambda v: F.coalesce(~F.lower(times.strip(v)).isin(NOTHING), F.lit(False)))
    return F.when(linux, held(LINUX["pid"])).otherwise(held(names))


def artifacts(rows: DataFrame) -> DataFrame:
    """Accepted sockets, exact duplicates as one with the rows they came from, with a deterministic id."""
    kept = sockets(rows).filter("reason is null")
    return collapse(kept, SOCKET).withColumn("artifact_id", ids.uuid5(ids.namespace("socket"), ids.joined(*map(F.col, SOCKET))))
