"""Manifests and hash-linked custody ledgers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidelog.functions.paths import entry_path_status

GENESIS = "0" * 64
# Algorithms of manifest entries.
KNOWN_ALGORITHMS = ["md5", "sha256"]


def manifest_of(docs: DataFrame, key: Column, content: Column) -> DataFrame:
    """relative_path, size and digests of a file set."""
    return docs.select(key.alias("relative_path"), F.octet_length(content).cast("long").alias("size_bytes"), F.md5(content).alias("md5"), F.sha2(content.cast("binary"), 256).alias("sha256"), F.sha2(content.cast("binary"), 512).alias("sha512"))


def verify_manifest(entries: DataFrame, files: DataFrame) -> DataFrame:
    """relative_path, status of each entry (relative_path, algorithm, digest): a left join with the files found.

    Entries of one path with several algorithms verify only if all do; an algorithm other than
    KNOWN_ALGORITHMS is unsupported. Files that are links, or that could not be read, say so in the columns
    `is_link` and `unreadable` where the table has them.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in files.columns else F.lit(False)
    catalogue = files.select("relative_path", F.create_map(F.lit("md5"), F.col("md5"), F.lit("sha256"), F.col("sha256")).alias("_have"), F.lit(True).alias("_found"), flag("is_link").alias("_link"), flag("unreadable").alias("_closed"))
    one = entries.groupBy("relative_path").agg(F.collect_set(F.struct(F.lower("algorithm").alias("a"), F.lower("digest").alias("d"))).alias("_want"))
    safe = entry_path_status(F.col("relative_path")) == "ok"
    known = F.forall("_want", lambda w: w["a"].isin(KNOWN_ALGORITHMS))
    equal = F.forall("_want", lambda w: F.coalesce(F.col("_have")[w["a"]] == w["d"], F.lit(False)))
    # Names of the statuses.
    status = (
        F.when(~safe, "PATH_TRAVERSAL_DETECTED").when(~known, "UNSUPPORTED_ALGORITHM").when(F.col("_link"), "SYMLINK_REJECTED")
        .when(F.col("_found").isNull(), "FILE_MISSING").when(F.col("_closed"), "PERMISSION_DENIED").when(equal, "VERIFIED").otherwise("MISMATCH")
    )
    return one.join(catalogue, "relative_path", "left").select("relative_path", status.alias("status"))


def verification_counts(verified: DataFrame) -> DataFrame:
    ok = F.col("status") == "VERIFIED"
    return verified.agg(F.count("*").alias("entries"), F.count_if(ok).alias("verified"), F.count_if(~ok).alias("failed"), F.when(F.bool_and(ok), "VERIFIED").otherwise("FAILED").alias("overall"))


FIELDS = ["ledger_id", "seq", "event_id", "happened", "action_type", "item_id", "actor", "recipient"]


def build_chain(actions: DataFrame) -> DataFrame:
    """actions with previous_hash and record_hash: each ledger is read in order as a stream, and only the
    last hash is carried on; ledgers run side by side, one ledger within one task (its sort may spill)."""

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ledger, last = object(), GENESIS
        for batch in batches:
            previous, own = [], []
            for of, content in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if of != ledger:
                    ledger, last = of, GENESIS
                previous.append(last)
                last = hashlib.sha256((last + content).encode()).hexdigest()
                own.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(previous, pa.string()), pa.array(own, pa.string())], [*names, "previous_hash", "record_hash"])

    names = actions.columns
    at = names.index("ledger_id")
    schema = StructType([*actions.schema.fields, StructField("previous_hash", StringType()), StructField("record_hash", StringType())])
    rows = actions.withColumn("_content", F.to_json(F.struct(*sorted(FIELDS)), {"ignoreNullFields": "false"}))
    return rows.repartition("ledger_id").sortWithinPartitions("ledger_id", F.col("seq").asc_nulls_last(), "_content").mapInArrow(carry, schema)


def verify_chain(ledger: DataFrame) -> DataFrame:
    """ledger_id, seq, problem (null: none): sequence, unique ids, genesis, link to the previous hash, own hash."""
    w = Window.partitionBy("ledger_id").orderBy("seq")
    content = F.to_json(F.struct(*sorted(FIELDS)), {"ignoreNullFields": "false"})
    own = F.sha2(F.concat("previous_hash", content).cast("binary"), 256)
    before = F.lag("record_hash").over(w)
    problem = (
        F.when(F.col("seq") != F.row_number().over(w), "SEQUENCE").when(F.count("*").over(Window.partitionBy("ledger_id", "event_id")) > 1, "DUPLICATE_ID")
        .when(F.coalesce(before, F.lit(GENESIS)) != F.col("previous_hash"), "BROKEN_LINK").when(own != F.col("record_hash"), "ALTERED_RECORD")
    )
    return ledger.select("ledger_id", "seq", problem.alias("problem"))


def ledger_heads(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("ledger_id").agg(F.count("*").alias("records"), F.max_by("record_hash", "seq").alias("head_hash"))


def audit_intake(actions: DataFrame) -> DataFrame:
    """Items of a ledger whose first action is no receipt or registration."""
    first = actions.groupBy("ledger_id", "item_id").agg(F.min_by("action_type", "seq").alias("first_action"))
    return first.withColumn("accepted", F.col("first_action").isin("RECEIVED", "REGISTERED"))


def audit_chronology(actions: DataFrame) -> DataFrame:
    """Rows whose time is before that of the item's row before."""
    w = Window.partitionBy("ledger_id", "item_id").orderBy("seq")
    rows = actions.withColumn("before", F.lag("happened").over(w)).withColumn("inverted", F.coalesce(F.col("happened") < F.col("before"), F.lit(False)))
    return rows.select("ledger_id", "item_id", "seq", "inverted")


def custodian() -> Column:
    return F.when(F.col("action_type") == "TRANSFERRED", F.col("recipient")).when(F.col("action_type").isin("RECEIVED", "REGISTERED"), F.col("actor"))


def audit_possession(actions: DataFrame) -> DataFrame:
    """Transfers whose actor is not the item's custodian at that point."""
    w = Window.partitionBy("ledger_id", "item_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = actions.withColumn("holder", F.last(custodian(), ignorenulls=True).over(w)).filter(F.col("action_type") == "TRANSFERRED")
    return rows.select("ledger_id", "item_id", "seq", "holder", "actor", F.coalesce(F.col("holder") != F.col("actor"), F.lit(False)).alias("discrepancy"))


def current_custodians(actions: DataFrame) -> DataFrame:
    rows = actions.withColumn("holder", custodian()).filter("holder is not null")
    return rows.groupBy("ledger_id", "item_id").agg(F.max_by("holder", "seq").alias("holder"), F.max("seq").alias("since_seq"))


# Statuses by precedence.
PRECEDENCE = ["VERIFIED", "INCOMPLETE", "DISCREPANCY", "TAMPERED"]


def audit_status(ledger: DataFrame) -> DataFrame:
    """Per ledger the gravest status: chain problems, then possession or time, then intake."""
    rank = lambda df, cond, k: df.select("ledger_id", F.when(cond, k).otherwise(0).alias("k"))
    ranks = (
        rank(verify_chain(ledger), F.col("problem").isNotNull(), 3).unionByName(rank(audit_possession(ledger), F.col("discrepancy"), 2))
        .unionByName(rank(audit_chronology(ledger), F.col("inverted"), 2)).unionByName(rank(audit_intake(ledger), ~F.col("accepted"), 1))
    )
    return ranks.groupBy("ledger_id").agg(F.array(*map(F.lit, PRECEDENCE))[F.max("k")].alias("status"))


def audit_digests(recorded: DataFrame, baseline: DataFrame) -> DataFrame:
    """relative_path, algorithm, outcome of recorded digests against a trusted baseline (relative_path, md5, sha256)."""
    trusted = baseline.select("relative_path", F.explode(F.create_map(F.lit("md5"), F.col("md5"), F.lit("sha256"), F.col("sha256"))).alias("algorithm", "trusted"))
    joined = recorded.select("relative_path", F.lower("algorithm").alias("algorithm"), F.lower("digest").alias("digest")).join(trusted, ["relative_path", "algorithm"], "left")
    return joined.select("relative_path", "algorithm", F.when(F.col("trusted").isNull(), "NO_BASELINE").when(F.col("trusted") == F.col("digest"), "EQUAL").otherwise("DIFFERENT").alias("outcome"))


def inventory(entries: DataFrame, verified: DataFrame) -> DataFrame:
    """Manifest entries with their verification status and a warning where it is not VERIFIED."""
    one = entries.groupBy("relative_path").agg(F.count("*").alias("digests"))
    out = one.join(verified, "relative_path", "left").withColumn("status", F.coalesce("status", F.lit("NOT_VERIFIED")))
    return out.withColumn("warning", F.col("status") != "VERIFIED")
