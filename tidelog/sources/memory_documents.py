"""Documents of extracted memory artifacts: every object to a process, module, socket or event, or to a row with the reason why not."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import times
from tidelog.functions.once import once

# The prefixes of ids, by kind of object.
PREFIXES = {"process": "MEMPROC-", "module": "MEMMOD-", "socket": "MEMNET-", "event": "MEMEVT-"}
#: Text fields, and numbers, of all kinds.
TEXTS = [
    "process_name", "module_name", "protocol", "source_plugin", "execution_id", "created_at", "exit_time", "offset", "base_address", "driver_path",
    "local_address", "remote_address", "state", "timestamp", "event_type", "description", "artifact_category", "raw_timestamp",
]
NUMBERS = ["pid", "ppid", "local_port", "remote_port", "size_bytes"]


def objects_of(documents: DataFrame) -> DataFrame:
    """source, position, object (a variant), reason of documents (source, value).

    A document is a list of objects, an object with such a list under `artifacts`, or one object by itself. A text
    that is no document gives one row with a reason and no object. Each element is a variant of its own, so only
    one object, not a document, must fit into one.
    """
    whole = F.from_json("value", "struct<artifacts:array<variant>>")["artifacts"]
    alone = F.try_parse_json("value")
    kind = F.when(F.json_array_length("value").isNotNull(), "list").when(F.json_object_keys("value").isNotNull(), "object")
    read = documents.select("source", "value", kind.alias("_kind"))
    listed = F.when(F.col("_kind") == "list", F.from_json("value", "array<variant>")).when(F.col("_kind") == "object", F.coalesce(whole, F.array(alone)))
    read = read.select("source", listed.alias("_objects"))
    good = read.filter("_objects is not null").select("source", F.posexplode("_objects").alias("position", "object"), F.lit(None).cast("string").alias("reason"))
    bad = read.filter("_objects is null").select("source", F.lit(None).cast("int").alias("position"), F.lit(None).cast("variant").alias("object"), F.lit("UNREADABLE_DOCUMENT").alias("reason"))
    return good.unionByName(bad)


def field(name: str) -> Column:
    return F.try_variant_get("object", F.lit(f"$.{name}"), "variant")


def text(name: str) -> Column:
    """A field as text; null where it is null or missing."""
    return F.try_variant_get("object", F.lit(f"$.{name}"), "string")


def is_text(name: str) -> Column:
    return F.coalesce(F.schema_of_variant(field(name)) == "STRING", F.lit(False))


def number(name: str) -> Column:
    """A field as a whole number: a number without its fraction, or a text of digits."""
    return F.try_variant_get("object", F.lit(f"$.{name}"), "long")


def kind_of() -> Column:
    """By the prefix of its id, else by the fields that are there; null where neither tells."""
    by_id = F.lit(None).cast("string")
    for name in ("process", "module", "socket"):
        by_id = F.coalesce(by_id, F.when(is_text("artifact_id") & text("artifact_id").startswith(PREFIXES[name]), name))
    by_id = F.coalesce(by_id, F.when(is_text("event_id") & text("event_id").startswith(PREFIXES["event"]), "event"))
    has = lambda *names: [field(n).isNotNull() for n in names]
    pid, process_name, evidence, protocol, module_name = has("pid", "process_name", "evidence_id", "protocol", "module_name")
    by_fields = F.when(pid & process_name & evidence & ~protocol, "process").when(module_name & evidence, "module").when(protocol & evidence, "socket")
    return F.coalesce(by_id, by_fields)


def clean(value: Column) -> Column:
    """Without control characters and blanks around; null if nothing is left."""
    return F.nullif(times.strip(F.regexp_replace(value, r"[\x00-\x1f\x7f-\x9f]", "")), F.lit(""))


def reason_of() -> Column:
    """Why an object of a kind is refused; null if it is accepted. The first that holds counts."""
    kind = F.col("kind")
    name = F.when(kind == "process", F.col("process_name")).when(kind == "module", F.col("module_name"))
    prefix = F.create_map(*(F.lit(x) for kv in PREFIXES.items() for x in kv))[kind]
    key = F.when(kind == "event", F.col("event_id")).otherwise(F.col("artifact_id"))
    digits = F.lower(F.replace(F.right(key, F.length(key) - F.length(prefix)), F.lit("-"), F.lit("")))
    good_id = key.startswith(prefix) & digits.rlike("^[0-9a-f]{32}$")
    bad_number = lambda n: field(n).isNotNull() & ~F.is_variant_null(field(n)) & (F.col(n).isNull() | (F.col(n) < 0))
    port = lambda n: bad_number(n) | F.coalesce(F.col(n) > 65535, F.lit(False))
    return (
        F.when(~F.startswith(F.schema_of_variant("object"), F.lit("OBJECT")), "NO_OBJECT").when(kind.isNull(), "UNKNOWN_SHAPE").when(key.isNull(), "MISSING_ID").when(~good_id, "INVALID_ID")
        .when(clean(F.col("evidence_id")).isNull(), "MISSING_EVIDENCE")
        .when(kind.isin("process", "module") & clean(name).isNull(), "MISSING_NAME").when((kind == "socket") & clean(F.col("protocol")).isNull(), "MISSING_PROTOCOL")
        .when(((kind == "process") & F.col("pid").isNull()) | bad_number("pid"), "INVALID_PID").when(bad_number("ppid"), "INVALID_PPID")
        .when(port("local_port") | port("remote_port"), "INVALID_PORT").when(bad_number("size_bytes"), "INVALID_SIZE")
    )


def load(documents: DataFrame) -> DataFrame:
    """One row an object, in one pass: source, position, kind, reason (null: accepted), its ids and all fields of all kinds.

    row_indices are the rows of the tool that it came from, `attributes` its open fields as texts. Refused objects
    keep their kind where it is known; a refused object never hides the others of its document.
    """
    found = once(objects_of(documents), "kind", F.when(F.startswith(F.schema_of_variant("object"), F.lit("OBJECT")), kind_of()))
    columns = [text(c).alias(c) for c in ("artifact_id", "event_id", "evidence_id", *TEXTS)] + [number(c).alias(c) for c in NUMBERS]
    indices = F.filter(F.try_variant_get("object", F.lit("$.source_row_indices"), "array<long>"), lambda x: x >= 0)
    open_fields = F.coalesce(*(F.try_variant_get("object", F.lit(f"$.{n}"), "map<string,string>") for n in ("raw_attributes", "attributes")))
    rows = found.select("source", "position", "kind", "object", F.col("reason").alias("_reason"), *columns, F.coalesce(indices, F.array().cast("array<long>")).alias("row_indices"), open_fields.alias("attributes"))
    rows = once(rows, "reason", F.coalesce("_reason", reason_of()))
    return rows.withColumns({c: clean(F.col(c)) for c in ("process_name", "module_name", "protocol", "evidence_id")}).withColumn("source_plugin", F.coalesce("source_plugin", F.lit("unknown"))).drop("object", "_reason")


def of_kind(kind: str) -> Callable[[DataFrame], DataFrame]:
    def accepted(objects: DataFrame) -> DataFrame:
        return objects.filter(F.col("reason").isNull() & (F.col("kind") == kind))

    return accepted


processes, modules, sockets, stored_events = map(of_kind, PREFIXES)


def refused(objects: DataFrame) -> DataFrame:
    return objects.filter(F.col("reason").isNotNull()).select("source", "position", "kind", "reason")
