"""Queries over ledgers of custody with all their fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.shared import materialize
from tidelog.operators import custody
from tidelog.plans.registry import Registry
from tidelog.plans.views import view

REGISTRY = Registry()
QUERIES, SQL = REGISTRY.queries, REGISTRY.sql
query = REGISTRY.query

#: Records by item with what was known before: each finding has its own branch.
ITEMS = """t AS (
  SELECT *, CASE WHEN timestamp = 'no time' THEN NULL WHEN timestamp LIKE '%Z' THEN epoch_us(CAST(replace(timestamp, 'Z', '') AS TIMESTAMP)) WHEN timestamp LIKE '%+02:00' THEN epoch_us(CAST(replace(timestamp, '+02:00', '') AS TIMESTAMP)) - 7200000000 ELSE epoch_us(CAST(timestamp AS TIMESTAMP)) END AS us,
    timestamp LIKE '%Z' OR timestamp LIKE '%+02:00' AS aware, action_type = 'CUSTODY_TRANSFERRED' AND notes LIKE '%transfer_id%' AS structured, action_type = 'CUSTODY_TRANSFERRED' AND notes = 'by hand' AS legacy FROM custody_events
), s AS (
  SELECT *, CASE WHEN action_type = 'EVIDENCE_RECEIVED' OR legacy THEN actor_name WHEN structured AND releasing <> receiving THEN receiving END AS sets,
    CASE WHEN action_type = 'EVIDENCE_RECEIVED' OR legacy THEN {'at': coalesce(destination_location, source_location)} WHEN structured THEN {'at': 'lab ' || CAST(k % 2 AS VARCHAR)} END AS puts FROM t
), h AS (
  SELECT *, last_value(sets IGNORE NULLS) OVER w AS holder, last_value(CASE WHEN us IS NOT NULL THEN {'aware': aware, 'us': us} END IGNORE NULLS) OVER w AS clock, row_number() OVER (PARTITION BY ledger_id, evidence_id ORDER BY sequence_number) AS place FROM s
  WINDOW w AS (PARTITION BY ledger_id, evidence_id ORDER BY sequence_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT *, 'MISSING_INTAKE_EVENT' AS finding, 'INCOMPLETE' AS severity FROM h WHERE place = 1 AND action_type <> 'EVIDENCE_RECEIVED' UNION ALL SELECT *, 'MALFORMED_EVENT_TIMESTAMP', 'DISCREPANCY' FROM h WHERE us IS NULL
  UNION ALL SELECT *, 'TIMESTAMP_TIMEZONE_AMBIGUITY', 'DISCREPANCY' FROM h WHERE us IS NOT NULL AND aware <> clock.aware
  UNION ALL SELECT *, CASE WHEN timestamp_source = 'MANUAL_ENTRY' THEN 'CHRONOLOGICAL_INVERSION_MANUAL_ENTRY' ELSE 'CHRONOLOGICAL_INVERSION_HOST_CLOCK_SKEW' END, 'DISCREPANCY' FROM h WHERE aware = clock.aware AND us < clock.us
  UNION ALL SELECT *, 'POSSESSION_CONTINUITY_BREAK', 'DISCREPANCY' FROM h WHERE structured AND releasing <> receiving AND holder <> releasing UNION ALL SELECT *, 'UNVERIFIED_INITIAL_CUSTODIAN', 'INCOMPLETE' FROM h WHERE structured AND releasing <> receiving AND holder IS NULL
  UNION ALL SELECT *, 'UNVERIFIABLE_LEGACY_TRANSFER', 'INCOMPLETE' FROM h WHERE legacy
  UNION ALL SELECT *, CASE WHEN evidence_id IN ('I5', 'I6') THEN 'DIGEST_UNTRUSTED_OBSERVATION' WHEN digest = sha256(evidence_id) THEN 'DIGEST_MATCH' ELSE 'DIGEST_MISMATCH' END, CASE WHEN evidence_id NOT IN ('I5', 'I6') AND digest <> sha256(evidence_id) THEN 'DISCREPANCY' ELSE 'INFO' END FROM h WHERE digest IS NOT NULL
), tampered AS (SELECT ledger_id, sequence_number, event_id, k FROM custody_events WHERE k % 700 = 0)"""


def _ledger(spark, sf) -> DataFrame:
    """Sealed records; the notes of some are changed afterwards."""
    rows = view(spark, sf, "custody_events")
    none = F.lit(None).cast("string")
    actor = F.struct(F.col("actor_name").alias("declared_identity"), F.lit("analyst").alias("role"), none.alias("organization"), none.alias("contact_info"))
    hashes = F.when(F.col("digest").isNotNull(), F.create_map(F.lit("sha256"), "digest")).otherwise(F.create_map().cast("map<string,string>"))
    rows = rows.withColumn("actor", actor).withColumn("hashes", hashes).withColumn("verification_method", none).drop("actor_name", "digest", "releasing", "receiving")
    changed = F.col("k") % 700 == 0
    sealed = materialize(custody.seal(rows), "ledger", clean=True)  # an audit reads it several times
    return sealed.withColumn("verification_method", F.when(changed, "none at all").otherwise(F.col("verification_method"))).drop("k")


def _baseline(spark, sf) -> DataFrame:
    return view(spark, sf, "nation").filter("n_nationkey < 5").select(F.concat(F.lit("I"), F.col("n_nationkey").cast("string")).alias("evidence_id"), F.lit("SHA256").alias("algorithm")).withColumn("digest", F.upper(F.sha2("evidence_id", 256)))


@query("custody_full_chain", f"WITH {ITEMS} SELECT ledger_id, sequence_number, event_id, 'ALTERED_RECORD' AS finding FROM tampered", "custody_events")
def custody_full_chain(spark, sf):
    """Problems of chains: the records that were changed after sealing."""
    return custody.chain_problems(_ledger(spark, sf))


@query("custody_audit", f"WITH {ITEMS} SELECT ledger_id, evidence_id, sequence_number, finding, severity FROM f UNION ALL SELECT ledger_id, NULL, sequence_number, 'ALTERED_RECORD', 'TAMPERED' FROM tampered", "custody_events")
def custody_audit(spark, sf):
    """Every finding of every record."""
    return custody.audit(_ledger(spark, sf), _baseline(spark, sf)).select("ledger_id", "evidence_id", "sequence_number", "finding", "severity")


@query("custody_audit_status", f"""WITH {ITEMS}, a AS (SELECT ledger_id, severity FROM f UNION ALL SELECT ledger_id, 'TAMPERED' FROM tampered)
SELECT ledger_id, count(*) FILTER (severity = 'INCOMPLETE') AS incomplete, count(*) FILTER (severity = 'DISCREPANCY') AS discrepancy, count(*) FILTER (severity = 'TAMPERED') AS tampered,
  CASE WHEN bool_or(severity = 'TAMPERED') THEN 'TAMPERED' WHEN bool_or(severity = 'DISCREPANCY') THEN 'DISCREPANCY_DETECTED' WHEN bool_or(severity = 'INCOMPLETE') THEN 'INCOMPLETE_HISTORY' ELSE 'VERIFIED' END AS status FROM a GROUP BY ledger_id""", "custody_events")
def custody_audit_status(spark, sf):
    """The status of each ledger."""
    ledger = _ledger(spark, sf)
    return custody.status(custody.audit(ledger, _baseline(spark, sf)), ledger)


@query("custody_current_state", f"WITH {ITEMS} SELECT ledger_id, evidence_id, arg_max(sets, sequence_number) FILTER (sets IS NOT NULL) AS holder, (arg_max(puts, sequence_number) FILTER (puts IS NOT NULL)).at AS location, max(sequence_number) AS last_number FROM s GROUP BY ledger_id, evidence_id", "custody_events")
def custody_current_state(spark, sf):
    """Who holds each item, and where."""
    return custody.current(_ledger(spark, sf))
