"""Deterministic identifiers as plain column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Own namespace of this library.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:tidelog")


def namespace(kind: str) -> uuid.UUID:
    return uuid.uuid5(NAMESPACE, kind)


def uuid5(space: uuid.UUID, key: Column) -> Column:
    """UUID version 5 of a text in a namespace."""
    d = F.sha1(F.concat(F.lit(space.bytes), key.cast("binary")))
    variant = F.translate(F.substring(d, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(d, 1, 8), F.lit("-"), F.substring(d, 9, 4), F.lit("-5"), F.substring(d, 14, 3), F.lit("-"), variant, F.substring(d, 18, 3), F.lit("-"), F.substring(d, 21, 12))


def joined(*parts: Column, sep: str = "|") -> Column:
    """Present parts with a separator; a null part leaves an empty place."""
    return F.concat_ws(sep, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def artifact_id(path: Column, sha256: Column) -> Column:
    return uuid5(namespace("artifact"), joined(path, F.lower(sha256)))


def edge_id(kind: Column, a: Column, b: Column) -> Column:
    """Id of an edge: its type and its two event ids in order."""
    return F.concat(F.lit("CORR-"), uuid5(namespace("edge"), joined(kind, F.least(a, b), F.greatest(a, b))))


def detection_id(rule_id: Column, event_ids: Column) -> Column:
    return F.concat(F.lit("DET-"), uuid5(namespace("detection"), joined(rule_id, F.array_join(event_ids, ","))))
