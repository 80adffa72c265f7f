"""Ledgers of custody against a plain loop over their records."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions.carry import last_before
from tidelog.operators import custody

ACTOR = "struct<declared_identity: string, role: string, organization: string, contact_info: string>"
EVENT = f"ledger_id string, sequence_number long, event_id string, timestamp string, timestamp_source string, action_type string, evidence_id string, actor {ACTOR}, source_location string, destination_location string, hashes map<string,string>, verification_method string, notes string"
TIMES = {"2024-01-01T10:00:00Z": (0, 36000), "2024-01-01T10:00:00+02:00": (0, 28800), "2024-01-01 09:00:00": (1, 32400), "2024-01-01T11:00:00": (1, 39600), "soon": None}


def identifier(prefix, k):
    return f"{prefix}-{k:08x}-0000-4000-8000-000000000000"


def random_ledger(seed, n=80):
    r = random.Random(seed)
    rows = []
    for ledger in ("L0", "L1"):
        for k in range(n):
            action = r.choice(["EVIDENCE_RECEIVED", "EVIDENCE_REGISTERED", "CUSTODY_TRANSFERRED", "CUSTODY_TRANSFERRED", "CUSTODY_TRANSFERRED", "ANALYSIS_STARTED"])
            a, b = r.choice("ab"), r.choice("abc")
            whole = {"transfer_id": identifier("COCTRAN", k), "releasing_actor": {"declared_identity": a}, "receiving_actor": {"declared_identity": b, "role": "x"}, "destination_location": r.choice(["lab", None])}
            notes = r.choice([json.dumps(whole), json.dumps(whole), json.dumps(whole | {"transfer_id": "T-1"}), json.dumps({k: v for k, v in whole.items() if k != "releasing_actor"}), "by hand", "[1]", "", None])
            rows.append((ledger, k, identifier("COCEVT", len(rows)), r.choice(list(TIMES)), r.choice(["MANUAL_ENTRY", "HOST_SYSTEM_CLOCK"]), action, r.choice("XYZ"), (a, None, "é", None), r.choice(["s", None]), r.choice(["d", None, ""]), {"sha256": r.choice("12")} if r.random() < 0.5 else {}, None, notes))
    return rows


def plain_audit(rows, trusted):
    out, state = set(), {}
    for ledger, seq, event, at, source, action, item, actor, src, dst, hashes, _, notes in rows:
        s = state.get((ledger, item))
        add = lambda f: out.add((ledger, item, seq, event, f))  # noqa: E731, B023
        if s is None:
            s = state[(ledger, item)] = {"holder": None, "place": None, "clock": None, "last": seq}
            if action[:9] != "EVIDENCE_":
                add("MISSING_INTAKE_EVENT")
        s["last"] = seq
        clock = TIMES[at]
        if clock is None:
            add("MALFORMED_EVENT_TIMESTAMP")
        else:
            if s["clock"] and s["clock"][0] != clock[0]:
                add("TIMESTAMP_TIMEZONE_AMBIGUITY")
            elif s["clock"] and clock < s["clock"]:
                add("CHRONOLOGICAL_INVERSION_" + ("MANUAL_ENTRY" if source == "MANUAL_ENTRY" else "HOST_CLOCK_SKEW"))
            s["clock"] = clock
        try:
            t = json.loads(notes or "")
            known = action == "CUSTODY_TRANSFERRED" and t["transfer_id"].startswith("COCTRAN-") and (t["releasing_actor"]["declared_identity"], t["receiving_actor"]["declared_identity"], t["destination_location"] or dst or "UNKNOWN")
        except (ValueError, TypeError, KeyError):
            known = None
        if action[:9] == "EVIDENCE_":
            s["holder"], s["place"] = actor[0], dst or src
        elif action == "CUSTODY_TRANSFERRED" and known:
            a, b, place = known
            if a != b:
                if s["holder"] is None:
                    add("UNVERIFIED_INITIAL_CUSTODIAN")
                elif s["holder"] != a:
                    add("POSSESSION_CONTINUITY_BREAK")
                s["holder"] = b
            s["place"] = place
        elif action == "CUSTODY_TRANSFERRED":
            add("UNVERIFIABLE_LEGACY_TRANSFER")
            s["holder"], s["place"] = actor[0], dst or src
        for v in hashes.values():
            add("DIGEST_UNTRUSTED_OBSERVATION" if item not in trusted else "DIGEST_MATCH" if trusted[item] == v else "DIGEST_MISMATCH")
    return out, {k: (s["holder"], s["place"], s["last"]) for k, s in state.items()}


@pytest.mark.parametrize("seed, block", [(1, 1 << 16), (2, 3), (3, 1)])
def test_audit_equals_a_plain_loop(spark, seed, block):
    rows = random_ledger(seed)
    df = custody.seal(spark.createDataFrame(rows, EVENT).repartition(5))
    trusted = {"X": "1", "Y": "2"}
    baseline = spark.createDataFrame([(k, "SHA256", v) for k, v in trusted.items()], "evidence_id string, algorithm string, digest string")
    want, state = plain_audit(rows, trusted)
    out = custody.audit(df, baseline, block=block)
    got = [(r.ledger_id, r.evidence_id, r.sequence_number, r.event_id, r.finding) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want and len({w[4] for w in want}) >= 9
    assert {(r.ledger_id, r.evidence_id): (r.holder, r.location, r.last_number) for r in custody.current(df).collect()} == state


def test_hashes_are_those_of_canonical_json(spark):
    rows = random_ledger(4, 12)
    last, want = {}, []
    for row in rows:
        r = dict(zip([c.split()[0] for c in EVENT.split(", ") if c.split()[0] in custody.HASHED or c.startswith(("ledger", "actor"))], [row[k] for k in range(13)]))
        content = {c: r[c] for c in custody.HASHED if c != "prev_event_hash"} | {"actor": dict(zip(custody.ACTOR, row[7])), "prev_event_hash": last.get(row[0], "0" * 64)}
        last[row[0]] = hashlib.sha256(json.dumps(content, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
        want.append((row[2], content["prev_event_hash"], last[row[0]]))
    sealed = custody.seal(spark.createDataFrame(rows, EVENT))
    assert sorted((r.event_id, r.prev_event_hash, r.record_hash) for r in sealed.collect()) == sorted(want)
    assert custody.chain_problems(sealed).count() == 0
    assert {r.ledger_id: r.terminal_hash for r in custody.heads(sealed).collect()} == last


def test_problems_of_chains(spark):
    rows = random_ledger(5, 12)
    sealed = custody.seal(spark.createDataFrame(rows, EVENT))
    first = (F.col("ledger_id") == "L0")
    at = lambda k: first & (F.col("sequence_number") == k)
    found = lambda d: sorted((r.ledger_id, r.sequence_number, r.finding) for r in custody.chain_problems(d).collect())
    for column, value in (("notes", F.lit("changed")), ("destination_location", F.lit("x")), ("hashes", F.create_map(F.lit("md5"), F.lit("1"))), ("timestamp_source", F.lit("other")), ("verification_method", F.lit("eye"))):
        assert found(sealed.withColumn(column, F.when(at(4), value).otherwise(F.col(column)))) == [("L0", 4, "ALTERED_RECORD")]
    assert found(sealed.filter(~at(4))) == [("L0", 5, "SEQUENCE")]
    assert found(sealed.unionByName(sealed.filter(at(11)))) == [("L0", 11, k) for k in ("DUPLICATE_ID", "DUPLICATE_ID", "SEQUENCE", "SEQUENCE")]
    assert found(sealed.withColumn("prev_event_hash", F.when(at(0), F.lit("1" * 64)).otherwise(F.col("prev_event_hash")))) == [("L0", 0, "ALTERED_RECORD"), ("L0", 0, "BROKEN_LINK")]
    assert found(sealed.withColumn("record_hash", F.when(at(4), F.lit("1" * 64)).otherwise(F.col("record_hash")))) == [("L0", 4, "ALTERED_RECORD"), ("L0", 5, "BROKEN_LINK")]
    assert found(sealed.withColumn("event_id", F.when(at(4), F.lit("E4")).otherwise(F.col("event_id")))) == [("L0", 4, "ALTERED_RECORD"), ("L0", 4, "INVALID_ID")]


def test_status_of_ledgers(spark):
    base = ("A", 0, identifier("COCEVT", 1), "2024-01-01T10:00:00Z", "HOST_SYSTEM_CLOCK", "EVIDENCE_RECEIVED", "X", ("a", None, None, None), None, None, {}, None, None)
    late = ("B", 0, identifier("COCEVT", 2), *base[3:5], "ANALYSIS_STARTED", *base[6:])
    back = [("C", 0, identifier("COCEVT", 3), *base[3:]), ("C", 1, identifier("COCEVT", 4), "2024-01-01T09:00:00Z", *base[4:])]
    sealed = custody.seal(spark.createDataFrame([base, late, *back], EVENT))
    bad = sealed.unionByName(sealed.filter("ledger_id = 'A'").withColumn("ledger_id", F.lit("D")).withColumn("notes", F.lit("n")))
    ledgers = spark.createDataFrame([(x,) for x in "ABCDE"], "ledger_id string")
    got = {r.ledger_id: r.status for r in custody.status(custody.audit(bad, None, ledgers), ledgers).collect()}
    assert got == {"A": "VERIFIED", "B": "INCOMPLETE_HISTORY", "C": "DISCREPANCY_DETECTED", "D": "TAMPERED", "E": "INCOMPLETE_HISTORY"}
    assert custody.audit(sealed.limit(0)).count() == 0


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_last_before(spark, block):
    r = random.Random(block)
    rows = [(r.choice("ab"), k, r.choice([None, "x", "y"])) for k in range(60)]
    out = last_before(spark.createDataFrame(rows, "key string, at long, v string"), ["key"], "at", {"known": F.col("v")}, block)
    want = {(key, at): next((v for k, a, v in reversed(rows) if k == key and a < at and v), None) for key, at, _ in rows}
    assert {(x.key, x.at): x.known for x in out.collect()} == want


def test_texts_of_any_characters_are_hashed_as_json_writes_them(spark):
    nasty = ["", '"', "\\", '\\"', "\x00\x01\x1f", "\b\t\n\f\r", "\x7f\x80", "ü日 ￿", "a😀\U0010ffff", "plain ~", "x\n", None]
    rows = [(k, text) for k, text in enumerate(nasty)]
    df = spark.createDataFrame(rows, "sequence_number long, text string")
    one = lambda c: F.col("text").alias(c)
    actor = F.when(F.col("sequence_number") != 3, F.struct(*(one(c) for c in ("declared_identity", "role", "organization"))))
    hashes = F.when(F.col("sequence_number") % 2 == 0, F.create_map(F.lit("z"), F.col("text"), F.lit("ü"), F.lit("1"), F.lit("a"), F.lit(None).cast("string")))
    columns = [c for c in custody.HASHED if c not in ("actor", "hashes", "prev_event_hash", "sequence_number")]
    sealed = custody.seal(df.select(F.lit("L").alias("ledger_id"), "sequence_number", *(one(c) for c in columns), actor.alias("actor"), hashes.alias("hashes")))
    found = sealed.orderBy("sequence_number").collect()
    for r in found:
        assert r.record_hash == hashlib.sha256(custody.canonical(r.asDict(recursive=True), r.prev_event_hash).encode()).hexdigest()
    assert {r.finding for r in custody.chain_problems(sealed).collect()} <= {"DUPLICATE_ID", "INVALID_ID"} and len(found) == len(nasty)


def test_records_are_sealed_once_and_verified_without_python(spark, sf):
    from tidelog.plans.custody_queries import QUERIES

    for name in ("custody_full_chain", "custody_audit_status"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan


def test_own_hashes_are_compared_before_the_joins(spark, sf):
    from tidelog.plans.custody_queries import QUERIES

    lines = QUERIES["custody_full_chain"](spark, sf)._jdf.queryExecution().executedPlan().toString().split("\n")
    joined = next(k for k, line in enumerate(lines) if "Join" in line)
    assert not any("sha2" in line or "own_hash" in line for line in lines[:joined]) and any("sha2" in line for line in lines[joined:])
