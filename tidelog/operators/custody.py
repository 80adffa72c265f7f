"""Ledgers of custody with all their fields: sealing, chain problems, and the audit of each item's history.

Records: ledger_id, sequence_number (from 0), event_id, timestamp (text), timestamp_source, action_type, evidence_id,
actor (declared_identity, role, organization, contact_info), source_location, destination_location, hashes (map),
verification_method, notes, prev_event_hash, record_hash. Only sealing reads a ledger in one task, as each hash needs
the one before; verification joins a record with the one before it, and an item's state is carried by blocks, so a
ledger or item that holds most of all records is spread like any other.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, NullType, StringType, StructField, StructType

from tidelog.functions import times
from tidelog.functions.carry import BLOCK, last_before

GENESIS = "0" * 64
# The fields under a record's hash (its canonical JSON has sorted keys, no blanks, ASCII only).
HASHED = ["action_type", "actor", "destination_location", "evidence_id", "event_id", "hashes", "notes", "prev_event_hash", "sequence_number", "source_location", "timestamp", "timestamp_source", "verification_method"]
ACTOR = ["declared_identity", "role", "organization", "contact_info"]
EVENT_ID = "^COCEVT-[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
TRANSFER_ID = "(?i)^COCTRAN-[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
INTAKE = ["EVIDENCE_RECEIVED", "EVIDENCE_REGISTERED"]
TRANSFER = "CUSTODY_TRANSFERRED"
SEVERITY = {
    "SEQUENCE": "TAMPERED", "DUPLICATE_ID": "TAMPERED", "INVALID_ID": "TAMPERED", "BROKEN_LINK": "TAMPERED", "ALTERED_RECORD": "TAMPERED",
    "EMPTY_LEDGER": "INCOMPLETE", "MISSING_INTAKE_EVENT": "INCOMPLETE", "UNVERIFIED_INITIAL_CUSTODIAN": "INCOMPLETE", "UNVERIFIABLE_LEGACY_TRANSFER": "INCOMPLETE",
    "TIMESTAMP_TIMEZONE_AMBIGUITY": "DISCREPANCY", "CHRONOLOGICAL_INVERSION_MANUAL_ENTRY": "DISCREPANCY", "CHRONOLOGICAL_INVERSION_HOST_CLOCK_SKEW": "DISCREPANCY", "MALFORMED_EVENT_TIMESTAMP": "DISCREPANCY",
    "POSSESSION_CONTINUITY_BREAK": "DISCREPANCY", "DIGEST_MISMATCH": "DISCREPANCY", "DIGEST_MATCH": "INFO", "DIGEST_UNTRUSTED_OBSERVATION": "INFO",
}
STATUS = ["VERIFIED", "INCOMPLETE_HISTORY", "DISCREPANCY_DETECTED", "TAMPERED"]
NOTES = f"transfer_id string, releasing_actor struct<{', '.join(f'{c}: string' for c in ACTOR)}>, receiving_actor struct<{', '.join(f'{c}: string' for c in ACTOR)}>, source_location string, destination_location string"


def canonical(record: dict, prev_event_hash: str | None) -> str:
    """The text under a record's hash."""
    content = {c: record[c] for c in HASHED if c not in ("actor", "hashes", "prev_event_hash")}
    actor = record["actor"]
    content |= {"actor": None if actor is None else {c: actor.get(c) for c in ACTOR}, "hashes": dict(record["hashes"] or ()), "prev_event_hash": prev_event_hash}
    return json.dumps(content, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def _json(value: Column, kind: DataType) -> Column:
    """A text or whole number as JSON in ASCII, as json.dumps writes it."""
    if isinstance(kind, IntegralType):
        return F.coalesce(value.cast("string"), F.lit("null"))
    if not isinstance(kind, (StringType, NullType)):
        raise ValueError(f"a record holds texts and whole numbers, no {kind.simpleString()}")
    text = value.cast("string")
    unit = lambda code: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code), 4, "0")))
    named = {"\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}

    def escaped(char: Column) -> Column:
        code = F.ascii(char).cast("long")
        out = F.when(char == '"', '\\"')
        for c, form in named.items():
            out = out.when(char == c, form)
        pair = F.concat(unit(F.shiftright(code - 0x10000, 10) + 0xD800), unit((code - 0x10000).bitwiseAND(0x3FF) + 0xDC00))
        return out.when(code.between(0x20, 0x7E), char).when(code < 0x10000, unit(code)).otherwise(pair)

    plain = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    body = F.when(text.rlike(r"\A[\x20-\x7E]*\z"), plain).otherwise(F.array_join(F.transform(F.split(text, ""), escaped), ""))
    return F.coalesce(F.concat(F.lit('"'), body, F.lit('"')), F.lit("null"))


def _content(events: DataFrame) -> tuple[Column, Column]:
    """The text under a record's hash before and behind the hash of the record before, as `canonical` writes it."""
    schema = events.schema
    actor = schema["actor"].dataType
    person: list[Column] = []
    for c in sorted(ACTOR):
        person += [F.lit(f'{"," if person else ""}"{c}":'), _json(F.col("actor")[c], actor[c].dataType) if c in actor.fieldNames() else F.lit("null")]
    entry = lambda x: F.concat(_json(x["key"], StringType()), F.lit(":"), _json(x["value"], StringType()))
    digests = F.array_join(F.transform(F.array_sort(F.map_entries("hashes")), entry), ",")
    value = {"actor": F.when(F.col("actor").isNotNull(), F.concat(F.lit("{"), *person, F.lit("}"))).otherwise("null"), "hashes": F.concat(F.lit("{"), F.coalesce(digests, F.lit("")), F.lit("}"))}
    before, behind = [F.lit("{")], []
    for c in sorted(HASHED):
        at = behind if c > "prev_event_hash" else before
        at.append(F.lit(("" if c == "action_type" else ",") + f'"{c}":'))
        if c != "prev_event_hash":
            at.append(value[c] if c in value else _json(F.col(c), schema[c].dataType))
    return F.concat(*before), F.concat(*behind, F.lit("}"))


def seal(events: DataFrame) -> DataFrame:
    """events (records without hashes) with prev_event_hash and record_hash: each ledger is read in order, only the last hash is carried on. The texts that are hashed are made before, by Spark."""

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ledger, last = object(), GENESIS
        for batch in batches:
            previous, own = [], []
            for of, before, behind in zip(batch.column(names.index("ledger_id")).to_pylist(), *(batch.column(len(names) + k).to_pylist() for k in (0, 1))):
                if of != ledger:
                    ledger, last = of, GENESIS
                previous.append(last)
                last = hashlib.sha256(f'{before}"{last}"{behind}'.encode()).hexdigest()
                own.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(previous, pa.string()), pa.array(own, pa.string())], [*names, "prev_event_hash", "record_hash"])

    names = events.columns
    schema = StructType([*events.schema.fields, StructField("prev_event_hash", StringType()), StructField("record_hash", StringType())])
    before, behind = _content(events)
    ordered = events.repartition("ledger_id").sortWithinPartitions("ledger_id", "sequence_number")
    return ordered.select("*", before.alias("_before"), behind.alias("_behind")).mapInArrow(carry, schema)


def own_hashes(ledger: DataFrame) -> DataFrame:
    """ledger_id, sequence_number, event_id, prev_event_hash, record_hash, and own_hash: what the record's fields give."""
    before, behind = _content(ledger)
    text = F.concat(before, _json(F.col("prev_event_hash"), StringType()), behind)
    return ledger.select("ledger_id", "sequence_number", "event_id", "prev_event_hash", "record_hash", F.sha2(text, 256).alias("own_hash"))


def chain_problems(ledger: DataFrame) -> DataFrame:
    """ledger_id, sequence_number, event_id, finding: a row for each problem of a record.

    SEQUENCE: its number is there twice, or the one before is missing; DUPLICATE_ID; INVALID_ID; BROKEN_LINK: it names
    another hash than that of the record before (or of the beginning); ALTERED_RECORD: its hash is not that of its fields.
    """
    own = own_hashes(ledger)
    by_number = own.groupBy("ledger_id", "sequence_number").agg(F.count("*").alias("_alike"), F.max("record_hash").alias("_hash"))
    by_id = own.groupBy("ledger_id", "event_id").agg(F.count("*").alias("_same_id"))
    before = by_number.select("ledger_id", (F.col("sequence_number") + 1).alias("sequence_number"), F.col("_hash").alias("_before"))
    told = own.withColumn("_altered", ~F.col("record_hash").eqNullSafe(F.col("own_hash"))).drop("record_hash", "own_hash")  # two hashes less to shuffle
    rows = told.join(by_number.drop("_hash"), ["ledger_id", "sequence_number"]).join(by_id, ["ledger_id", "event_id"]).join(before, ["ledger_id", "sequence_number"], "left")
    first = F.col("sequence_number") == 0
    found = [
        ("SEQUENCE", (F.col("_alike") > 1) | (~first & F.col("_before").isNull())), ("DUPLICATE_ID", F.col("_same_id") > 1), ("INVALID_ID", ~F.col("event_id").rlike(EVENT_ID)),
        ("BROKEN_LINK", F.when(first, F.col("prev_event_hash") != GENESIS).otherwise(F.col("prev_event_hash") != F.col("_before"))), ("ALTERED_RECORD", F.col("_altered")),
    ]
    named = F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), name) for name, cond in found)))
    return rows.select("ledger_id", "sequence_number", "event_id", F.explode(named).alias("finding"))


def _transfers(ledger: DataFrame) -> DataFrame:
    """ledger with _transfer: releasing, receiving and destination of a transfer whose notes tell them; null for any other record."""
    notes = F.from_json("notes", NOTES)
    told = F.struct(
        notes["releasing_actor"]["declared_identity"].alias("releasing"), notes["receiving_actor"]["declared_identity"].alias("receiving"),
        F.coalesce(F.nullif(notes["destination_location"], F.lit("")), F.nullif("destination_location", F.lit("")), F.lit("UNKNOWN")).alias("destination"),
    )
    structured = (F.col("action_type") == TRANSFER) & notes["transfer_id"].rlike(TRANSFER_ID) & (F.trim(told["releasing"]) != "") & (F.trim(told["receiving"]) != "")
    return ledger.withColumn("_transfer", F.when(structured, told))


def _takes_over(ledger: DataFrame) -> tuple[Column, Column]:
    """The custodian and (in a struct, as it may be null) the place that a record sets; null where it sets none."""
    moved, transfer = F.col("_transfer"), F.col("action_type") == TRANSFER
    own_place = F.coalesce(F.nullif("destination_location", F.lit("")), F.nullif("source_location", F.lit("")))
    takes = F.col("action_type").isin(INTAKE) | (transfer & moved.isNull())
    relocated = moved["releasing"] == moved["receiving"]
    holder = F.when(takes, F.col("actor.declared_identity")).when(moved.isNotNull() & ~relocated, moved["receiving"])
    place = F.when(takes, F.struct(own_place.alias("at"))).when(moved.isNotNull(), F.struct(moved["destination"].alias("at")))
    return holder, place


def history(ledger: DataFrame, block: int = BLOCK) -> DataFrame:
    """ledger with what was known before each record of its item: holder, place (struct), clock (class and time of the latest readable timestamp), begun."""
    rows = _transfers(ledger)
    ts_class, us = times.normalize(F.col("timestamp"))
    rows = rows.withColumn("_clock", F.when(us.isNotNull(), F.struct(ts_class.alias("ts_class"), us.alias("ts_us"))))
    holder, place = _takes_over(rows)
    return last_before(rows, ["ledger_id", "evidence_id"], "sequence_number", {"holder": holder, "place": place, "clock": F.col("_clock"), "begun": F.lit(True)}, block)


def item_findings(ledger: DataFrame, block: int = BLOCK) -> DataFrame:
    """ledger_id, evidence_id, sequence_number, event_id, finding about intake, time and possession of each item."""
    rows, moved = history(ledger, block), F.col("_transfer")
    transfer = F.col("action_type") == TRANSFER
    same_clock = F.col("_clock.ts_class") == F.col("clock.ts_class")
    manual = F.col("timestamp_source") == "MANUAL_ENTRY"
    earlier = same_clock & (F.col("_clock.ts_us") < F.col("clock.ts_us"))
    handover = moved.isNotNull() & (moved["releasing"] != moved["receiving"])
    found = [
        ("MISSING_INTAKE_EVENT", F.col("begun").isNull() & ~F.col("action_type").isin(INTAKE)), ("MALFORMED_EVENT_TIMESTAMP", F.col("_clock").isNull()), ("TIMESTAMP_TIMEZONE_AMBIGUITY", ~same_clock),
        ("CHRONOLOGICAL_INVERSION_MANUAL_ENTRY", earlier & manual), ("CHRONOLOGICAL_INVERSION_HOST_CLOCK_SKEW", earlier & ~F.coalesce(manual, F.lit(False))),
        ("POSSESSION_CONTINUITY_BREAK", handover & (moved["releasing"] != F.col("holder"))), ("UNVERIFIED_INITIAL_CUSTODIAN", handover & F.col("holder").isNull()), ("UNVERIFIABLE_LEGACY_TRANSFER", transfer & moved.isNull()),
    ]
    named = F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), name) for name, cond in found)))
    return rows.select("ledger_id", "evidence_id", "sequence_number", "event_id", F.explode(named).alias("finding"))


def digest_findings(ledger: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Digests of records against a trusted baseline (evidence_id, algorithm, digest): equal, different, or of an item that has none (a row a record)."""
    columns = ["ledger_id", "evidence_id", "sequence_number", "event_id"]
    seen = ledger.filter(F.size("hashes") > 0)
    if baseline is None:
        return seen.select(*columns, F.lit("DIGEST_UNTRUSTED_OBSERVATION").alias("finding"))
    trusted = baseline.select("evidence_id", F.lower("algorithm").alias("algorithm"), F.lower("digest").alias("trusted"))
    each = seen.select(*columns, F.explode("hashes").alias("algorithm", "digest")).withColumn("algorithm", F.lower("algorithm"))
    compared = each.join(trusted, ["evidence_id", "algorithm"]).select(*columns, F.when(F.lower("digest") == F.col("trusted"), "DIGEST_MATCH").otherwise("DIGEST_MISMATCH").alias("finding"))
    alone = seen.join(trusted.select("evidence_id").distinct(), "evidence_id", "left_anti").select(*columns, F.lit("DIGEST_UNTRUSTED_OBSERVATION").alias("finding"))
    return compared.unionByName(alone)


def audit(ledger: DataFrame, baseline: DataFrame | None = None, ledgers: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """ledger_id, evidence_id, sequence_number, event_id, finding, severity: all findings. ledgers (ledger_id) names those that may have no record."""
    parts = chain_problems(ledger).withColumn("evidence_id", F.lit(None).cast("string"))
    out = item_findings(ledger, block).unionByName(digest_findings(ledger, baseline)).unionByName(parts)
    if ledgers is not None:
        empty = ledgers.select("ledger_id").distinct().join(ledger.select("ledger_id").distinct(), "ledger_id", "left_anti")
        out = out.unionByName(empty.withColumn("finding", F.lit("EMPTY_LEDGER")), allowMissingColumns=True)
    severity = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))
    return out.withColumn("severity", severity[F.col("finding")])


def status(findings: DataFrame, ledgers: DataFrame) -> DataFrame:
    """ledger_id, status, and how many findings of each severity: the gravest decides; a ledger without findings is VERIFIED."""
    grave = ["INCOMPLETE", "DISCREPANCY", "TAMPERED"]
    counts = findings.groupBy("ledger_id").agg(*(F.count_if(F.col("severity") == s).alias(s.lower()) for s in grave))
    out = ledgers.select("ledger_id").distinct().join(counts, "ledger_id", "left").fillna(0, [s.lower() for s in grave])
    rank = F.when(F.col("tampered") > 0, STATUS[3]).when(F.col("discrepancy") > 0, STATUS[2]).when(F.col("incomplete") > 0, STATUS[1]).otherwise(STATUS[0])
    return out.withColumn("status", rank)


def current(ledger: DataFrame) -> DataFrame:
    """ledger_id, evidence_id, holder, location and the number of the last record of each item."""
    rows = _transfers(ledger)
    holder, place = _takes_over(rows)
    rows = rows.withColumn("_holder", holder).withColumn("_place", place)
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("sequence_number")))
    out = rows.groupBy("ledger_id", "evidence_id").agg(latest("_holder").alias("holder"), latest("_place").alias("_place"), F.max("sequence_number").alias("last_number"))
    return out.select("ledger_id", "evidence_id", "holder", F.col("_place.at").alias("location"), "last_number")


def heads(ledger: DataFrame) -> DataFrame:
    """ledger_id, records, terminal_hash: what an outside anchor keeps of each ledger."""
    return ledger.groupBy("ledger_id").agg(F.count("*").alias("records"), F.max_by("record_hash", "sequence_number").alias("terminal_hash"))
