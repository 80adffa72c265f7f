"""The timeline: one row an event, ordered and without exact duplicates, filtered and summarised."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.functions import ids, times
from tidelog.functions.shared import materialize
from tidelog.sources import logs as log_rows

COLUMNS = ["event_id", "ts_class", "ts_us", "category", "event_type", "description", "source_path", "source_line", "source_artifact_id", "source_event_id", "raw_data", "username", "source_ip", "session_id", "status"]
#: An event's fingerprint has all columns but its own id.
FINGERPRINT = [c for c in COLUMNS if c != "event_id"]


def sort_key() -> list[Column]:
    """Aware, then naive, then missing; then time, path, line (missing first), ids, type, description, id."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return [F.col("ts_class"), F.coalesce("ts_us", F.lit(0)), text("source_path"), F.coalesce("source_line", F.lit(-1)), text("source_artifact_id"), text("source_event_id"), text("event_type"), text("description"), F.col("event_id")]


def order(events: DataFrame) -> DataFrame:
    """A total order by range partitions; no row goes through a single task."""
    return events.orderBy(*sort_key())


#: Events of a block of positions, the most that one window task holds of a key.
BLOCK = 1 << 16


def with_position(events: DataFrame, partitions: int | None = None, key: list[Column] | None = None) -> DataFrame:
    """The events with position: 1, 2, 3... in the order of the timeline, or of another key.

    Range partitions are sorted, and written with each event's place in its partition; an event's position is its
    place behind the counts of the partitions before. What is gathered is one count a partition. Events that are
    alike in all of the order but are not one are told apart by nothing: remove duplicates first.
    """
    key = [k.alias(f"_k{i}") for i, k in enumerate(sort_key() if key is None else key)]
    names = [f"_k{i}" for i in range(len(key))]
    keyed = events.select("*", *key)
    ranged = keyed.repartitionByRange(partitions, *names) if partitions else keyed.repartitionByRange(*names)
    place = F.monotonically_increasing_id()  # the partition in its upper bits, the row in it in the lower 33
    sorted_rows = ranged.sortWithinPartitions(*names).withColumn("_id", place).drop(*names)
    rows = materialize(sorted_rows.withColumn("_part", F.shiftright("_id", 33)).withColumn("_place", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id"), "positions")
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return rows.join(F.broadcast(before), "_part").withColumn("position", F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")


def counts_around(ticks: DataFrame, key: str = "key", block: int = BLOCK) -> DataFrame:
    """ticks (key, position, two counts a and b) with a_before and b_after: a of the key's rows at smaller positions, b of those at larger.

    Prefix sums on two levels: of blocks of positions, whose sums are a row a key and block, and inside a block.
    No task holds more of a key than a block of positions, or a row for each of its blocks.
    """
    rows = ticks.withColumn("_block", F.floor(F.col("position") / block))
    sums = rows.groupBy(key, "_block").agg(F.sum("a").alias("_a"), F.sum("b").alias("_b"))
    over = Window.partitionBy(key).orderBy("_block")
    earlier = over.rowsBetween(Window.unboundedPreceding, -1)
    upto = over.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(key)
    sums = sums.select(key, "_block", F.coalesce(F.sum("_a").over(earlier), F.lit(0)).alias("_a_before"), (F.sum("_b").over(whole) - F.sum("_b").over(upto)).alias("_b_after"))
    inside = Window.partitionBy(key, "_block").orderBy("position")
    strictly = inside.rangeBetween(Window.unboundedPreceding, -1)
    with_own = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumn("_a_in", F.coalesce(F.sum("a").over(strictly), F.lit(0))).withColumn("_b_in", F.sum("b").over(Window.partitionBy(key, "_block")) - F.sum("b").over(with_own))
    out = local.join(sums, [key, "_block"])
    return out.withColumn("a_before", F.col("_a_before") + F.col("_a_in")).withColumn("b_after", F.col("_b_after") + F.col("_b_in")).drop("_block", "_a_in", "_b_in", "_a_before", "_b_after")


def digest(columns: list[str]) -> Column:
    """128 bits of the SHA-256 of these columns' values, nulls told apart: it stands for them where only equality counts."""
    return F.substring(F.unhex(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)), 1, 16)


def deduplicate(events: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row of each fingerprint: that with the smallest id. An aggregate, one shuffle, partial sums in each task.

    keep: the columns that are needed besides the id; the others are shuffled as their digest only.
    """
    cols = [c for c in COLUMNS if c in events.columns]
    alike = [c for c in cols if c != "event_id"]
    if keep is not None:
        rest = [c for c in alike if c not in keep]
        events = events.withColumn("_rest", digest(rest) if rest else F.lit(0))
        cols, alike = [c for c in cols if c in keep or c == "event_id"], [*(c for c in alike if c in keep), "_rest"]
    return events.groupBy(*alike).agg(F.min("event_id").alias("event_id")).select(cols)


def filesystem_events(files: DataFrame) -> DataFrame:
    """path, artifact_id and epoch seconds created, modified, accessed, changed to one event a present time."""
    kinds = [("created_s", "file_created"), ("modified_s", "file_modified"), ("accessed_s", "file_accessed"), ("changed_s", "file_metadata_changed")]
    present = F.filter(F.array(*(F.struct(F.lit(t).alias("event_type"), times.epoch_seconds(F.col(c)).alias("ts_us")) for c, t in kinds if c in files.columns)), lambda x: x["ts_us"].isNotNull())
    return files.select("path", "artifact_id", F.explode(present).alias("e")).select(
        ids.uuid5(ids.namespace("event"), ids.joined(F.col("artifact_id"), F.col("path"), F.col("e.event_type"), F.col("e.ts_us"))).alias("event_id"),
        F.lit(times.AWARE).alias("ts_class"), "e.ts_us", F.lit("filesystem").alias("category"), "e.event_type",
        F.concat(F.col("e.event_type"), F.lit(": "), F.col("path")).alias("description"), F.col("path").alias("source_path"), F.lit(None).cast("long").alias("source_line"), F.col("artifact_id").alias("source_artifact_id"),
    )


def _log_event(rows: DataFrame, category: Column, kind: Column) -> DataFrame:
    col = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c)
    text = F.when(F.coalesce("message", F.lit("")) != "", F.col("message")).otherwise(F.concat(F.lit("log entry: "), kind))
    return rows.select(
        ids.uuid5(ids.namespace("event"), ids.joined(category, F.col("source_path"), F.col("line_number"), kind)).alias("event_id"),
        "ts_class", "ts_us", category.alias("category"), kind.alias("event_type"), text.alias("description"), "source_path", F.col("line_number").alias("source_line"),
        col("source_artifact_id"), F.concat_ws(":", "source_path", "line_number").alias("source_event_id"), F.col("line").alias("raw_data"), col("username"), col("source_ip"), col("session_id"), col("status"),
    )


def log_events(logs: DataFrame) -> DataFrame:
    """One event a log row; the description is the message, else a label."""
    rows = logs.withColumn("username", F.col("user")).withColumn("source_ip", F.col("src_ip")) if "user" in logs.columns else logs
    return _log_event(rows, F.lit("log"), F.col("event_type"))


def authentication_events(auth: DataFrame) -> DataFrame:
    """One event an authentication row, with its identity and status."""
    return _log_event(auth, F.lit("authentication"), F.col("auth_type"))


def of_lines(lines: DataFrame, year: int | None = None) -> DataFrame:
    """An event a log line: an authentication row where a line is one, else a log row."""
    rows = log_rows.with_authentication(log_rows.parse_logs(lines, year))
    is_auth = F.col("auth_type").isNotNull()
    rows = rows.withColumn("username", F.when(is_auth, F.col("username")).otherwise(F.col("user"))).withColumn("source_ip", F.when(is_auth, F.col("source_ip")).otherwise(F.col("src_ip")))
    category = F.when(is_auth, "authentication").otherwise("log")
    return _log_event(rows, category, F.coalesce("auth_type", "event_type"))


def build(lines: DataFrame, year: int | None = None) -> DataFrame:
    """Timeline of log lines without duplicates. One pass, one shuffle."""
    return deduplicate(of_lines(lines, year))


def central(events: DataFrame) -> DataFrame:
    """Events of any source with the columns of the timeline; columns beyond them, and an attributes map, as one map of texts without nulls."""
    text = lambda c: F.col(c).cast("string")
    typed = [c for c in COLUMNS if c in events.columns]
    more = [c for c in events.columns if c not in COLUMNS and c != "attributes"]
    entries = F.filter(F.array(*(F.struct(F.lit(c).alias("key"), text(c).alias("value")) for c in more)), lambda x: x["value"].isNotNull()) if more else None
    maps = [F.map_from_entries(entries)] if more else []
    maps += [F.coalesce(F.col("attributes"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))] if "attributes" in events.columns else []
    whole = maps[0] if len(maps) == 1 else F.map_from_entries(F.concat(F.map_entries(maps[0]), F.filter(F.map_entries(maps[1]), lambda x: ~x["key"].isin(more)))) if maps else F.lit(None).cast("map<string,string>")
    kinds = {"ts_class": "int", "ts_us": "long", "source_line": "long"}
    columns = [F.col(c).cast(kinds.get(c, "string")).alias(c) if c in typed else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS]
    return events.select(*columns, whole.cast("map<string,string>").alias("attributes"))


def unite(*tables: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One timeline of events of all sources (logs, files, packets, memory), without duplicates: fields beyond the columns are in `attributes`.

    keep: the columns that are needed besides the id; the others are shuffled as their digest only.
    """
    every = reduce(lambda a, b: a.unionByName(b), map(central, tables))
    # maps have no order of their own and cannot be grouped by; sorted entries can
    every = every.withColumn("_entries", F.array_sort(F.map_entries(F.coalesce("attributes", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))))
    if keep is not None:
        kept = [c for c in FINGERPRINT if c in keep]
        every = every.select("event_id", *kept, digest([*(c for c in FINGERPRINT if c not in keep), "_entries"]).alias("_rest"))
        return every.groupBy(*kept, "_rest").agg(F.min("event_id").alias("event_id")).select("event_id", *kept)
    one = every.groupBy(*FINGERPRINT, "_entries").agg(F.min("event_id").alias("event_id"))
    return one.select(*COLUMNS, F.map_from_entries("_entries").alias("attributes"))


def resolve_parents(logs: DataFrame, catalogue: DataFrame, root: str = "") -> DataFrame:
    """source_artifact_id of each row's file: by the given id, else by path, else by the path below root. Of several files of one path, the smallest id."""
    files = catalogue.groupBy(F.col("relative_path").alias("_path")).agg(F.min("artifact_id").alias("_by_path"))
    path = F.when(F.col("source_path").startswith(root), F.expr(f"substring(source_path, {len(root) + 1})")).otherwise(F.col("source_path")) if root else F.col("source_path")
    out = logs.withColumn("_rel", F.regexp_replace(path, "^/+", ""))
    given = F.col("source_artifact_id") if "source_artifact_id" in logs.columns else F.lit(None).cast("string")
    return out.join(files, F.col("_rel") == F.col("_path"), "left").withColumn("source_artifact_id", F.coalesce(given, "_by_path")).withColumn("relative_path", F.col("_rel")).drop("_rel", "_path", "_by_path")


def query(
    events: DataFrame, start_us: int | None = None, end_us: int | None = None, aware: bool = True, categories: list[str] | None = None, event_types: list[str] | None = None,
    path: str | None = None, artifact_id: str | None = None, source_event_id: str | None = None, text: str | None = None, case: bool = False,
) -> DataFrame:
    """AND of all given predicates. A time range never crosses classes; bounds are included."""
    wanted: list[Column] = []
    if start_us is not None or end_us is not None:
        wanted.append(F.col("ts_class") == (times.AWARE if aware else times.NAIVE))
    if start_us is not None:
        wanted.append(F.col("ts_us") >= start_us)
    if end_us is not None:
        wanted.append(F.col("ts_us") <= end_us)
    for col, values in (("category", categories), ("event_type", event_types)):
        if values:
            wanted.append(F.col(col).isin(values))
    for col, value in (("source_path", path), ("source_artifact_id", artifact_id), ("source_event_id", source_event_id)):
        if value is not None:
            wanted.append(F.col(col) == value)
    if text is not None:
        found = contains_text(["description", "raw_data", "event_type", "username", "source_ip", "session_id", "status"], text, case)
        if "attributes" in events.columns:  # keys and values
            part = lambda x: x.contains(text) if case else F.lower(x).contains(text.lower())
            found = found | F.coalesce(F.exists(F.map_entries("attributes"), lambda x: part(x["key"]) | F.coalesce(part(x["value"]), F.lit(False))), F.lit(False))
        wanted.append(found)
    return events.filter(reduce(lambda a, b: a & b, wanted)) if wanted else events


def contains_text(columns: list[str], text: str, case: bool = False) -> Column:
    """Whether any column holds the text."""
    whole = F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return F.exists(whole, lambda x: x.contains(text) if case else F.lower(x).contains(text.lower()))


def summary(events: DataFrame, deduplicated: DataFrame) -> DataFrame:
    """One row: events before and after, removed, by class."""
    after = deduplicated.agg(F.count("*").alias("kept"), *(F.count_if(F.col("ts_class") == k).alias(n) for k, n in ((0, "aware"), (1, "naive"), (2, "missing"))))
    return events.agg(F.count("*").alias("total")).crossJoin(after).withColumn("removed", F.col("total") - F.col("kept"))  # one row each


def summary_by(events: DataFrame, column: str = "category") -> DataFrame:
    """Per category (or another column): events before, kept and removed by de-duplication, in one pass."""
    alike = events.groupBy(*[c for c in COLUMNS if c in events.columns and c != "event_id"]).agg(F.count("*").alias("_n"))
    return alike.groupBy(column).agg(F.sum("_n").alias("total"), F.count("*").alias("kept"), (F.sum("_n") - F.count("*")).alias("removed"))


def coverage(events: DataFrame) -> DataFrame:
    """Per category and type: events, with a time, by class."""
    return events.groupBy("category", "event_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("ts_class") != 2).alias("timestamped"), F.count_if(F.col("ts_class") == 2).alias("missing"), F.count_if(F.col("ts_class") == 0).alias("aware"), F.count_if(F.col("ts_class") == 1).alias("naive")
    )
