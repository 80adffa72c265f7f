"""Token ids in binary shards, with a minimal perfect hash index for keyed access.

File format: two Parquet tables in the shared folder.

* `segments`: one row a segment, in ascending doc_id order. `payload` holds the raw ids (little-endian
  unsigned 32 bit) of whole documents one after the other, about SEGMENT_IDS a segment (a longer document
  has a segment of its own). `seeds` and `slots` are the segment's index: a key's bucket gives a seed, seed
  and key give a slot, and the slot has the key's fingerprint, the offset and the number of ids.
* `directory`: one row for each hash part of the doc_ids, with an index of the same kind from doc_id to
  the segments that hold it.

So a lookup costs two hashes and one comparison in the directory and as many in the segment, whatever the
number of documents; a foreign key is refused by a fingerprint (2**-32 pass).

The key in a segment is the doc_id (its kind and its text: a null differs from an empty string) with the
number of the copy (repeated doc_ids follow each other in the order of their text's hash). Null doc_ids come
first; a null or empty text has the end id only. An empty table gives an empty store. Columns beyond
doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidelog.llm.common import new_path, read_table, write_table
from tidelog.llm.encode import encoder as kept_encoder
from tidelog.llm.encode import vocabulary
from tidelog.llm.text import rows

SEGMENT_IDS = 1 << 18
TEXTS = 1024
#: offset and count: of ids in a segment's payload, of places in the directory.
SLOT = np.dtype([("fingerprint", "<u4"), ("offset", "<u8"), ("count", "<u4")])
PLACE = np.dtype([("shard", "<i4"), ("seg", "<i8")])
#: Keys of a bucket, about: with fewer, more buckets hold one key, which takes any slot left, and few seeds are tried.
BUCKET = 2
#: doc_ids of a part of the directory, about.
PART_KEYS = 1 << 16
#: Seeds tried for a bucket; keys that differ need a few hundred at most.
SEEDS = 1 << 20


def key_hash(doc_id, copy: int = 0) -> int:
    return xxhash.xxh3_128_intdigest(f"{'null' if doc_id is None else type(doc_id).__name__}:{'' if doc_id is None else doc_id}#{copy}".encode("utf-8", "surrogatepass"))


def slot_of(h: int, seed: int, n: int) -> int:
    """A seed below 0 names the slot itself (buckets of one key)."""
    return -seed - 1 if seed < 0 else ((h & (2**64 - 1)) * (2 * seed + 1) + (h >> 64) * (seed + 1) & (2**64 - 1)) * n >> 64


def build_index(hashes: list[int]) -> tuple[np.ndarray, list[int]]:
    """Seeds of the buckets and the slot of each key: every slot has one key."""
    n = len(hashes)
    buckets: dict[int, list[int]] = {}
    count = max(1, n // BUCKET)
    for i, h in enumerate(hashes):
        buckets.setdefault((h >> 96) % count, []).append(i)
    seeds, slot, free = np.zeros(count, "<i4"), [0] * n, [True] * n
    singles = []
    for b, keys in sorted(buckets.items(), key=lambda x: -len(x[1])):
        if len(keys) == 1:
            singles.append((b, keys[0]))
            continue
        for seed in range(SEEDS):
            at = [slot_of(hashes[i], seed, n) for i in keys]
            if len(set(at)) == len(at) and all(free[s] for s in at):
                break
        else:
            raise ValueError("keys of an index must differ")
        seeds[b] = seed
        for i, s in zip(keys, at):
            slot[i], free[s] = s, False
    left = iter([s for s in range(n) if free[s]])
    for b, i in singles:
        slot[i] = next(left)
        seeds[b] = -slot[i] - 1
    return seeds, slot


def find(seeds: np.ndarray, slots: np.ndarray, doc_id, copy: int = 0) -> tuple[int, int] | None:
    """Offset and count of a key of this index; None for a foreign key."""
    h = key_hash(doc_id, copy)
    s = slots[slot_of(h, int(seeds[(h >> 96) % len(seeds)]), len(slots))]
    return (int(s["offset"]), int(s["count"])) if int(s["fingerprint"]) == h & 0xFFFFFFFF else None


def write(docs: DataFrame, vocabulary_path: str, kind: str = "byte") -> str:
    """Encode docs (doc_id, text) and write the store; returns its path."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    id_type = docs.schema["doc_id"].dataType
    arrow_id = to_arrow_type(id_type)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, shard, seg = kept_encoder(vocabulary_path, kind), TaskContext.get().partitionId(), 0
        ids: list = []
        payload: list[bytes] = []
        size = 0

        def segment() -> pa.RecordBatch:
            hashes, copy, before = [], 0, object()
            for k in ids:
                copy = copy + 1 if k == before else 0
                before = k
                hashes.append(key_hash(k, copy))
            seeds, slot = build_index(hashes)
            slots = np.zeros(len(ids), SLOT)
            count = np.array([len(p) // 4 for p in payload])
            slots["count"][slot] = count
            slots["offset"][slot] = np.cumsum(count) - count
            slots["fingerprint"][slot] = [h & 0xFFFFFFFF for h in hashes]
            values = [shard, seg, len(ids), int(count.sum()), ids, seeds.tobytes(), slots.tobytes(), b"".join(payload)]
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(arrow_id), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], ["shard", "seg", "n_docs", "n_ids", "doc_ids", "seeds", "slots", "payload"])

        def encoded() -> Iterator[tuple]:
            held: list[tuple] = []
            for row in rows(batches, "doc_id", "text"):
                held.append(row)
                if len(held) == TEXTS:
                    yield from zip((r[0] for r in held), encoder.encode([r[1] for r in held]))
                    held = []
            yield from zip((r[0] for r in held), encoder.encode([r[1] for r in held]))

        for doc_id, b in encoded():
            if ids and size + len(b) > 4 * SEGMENT_IDS:
                yield segment()
                seg += 1
                ids, payload, size = [], [], 0
            ids.append(doc_id)
            payload.append(b)
            size += len(b)
        if ids:
            yield segment()

    schema = f"shard int, seg long, n_docs long, n_ids long, doc_ids array<{id_type.simpleString()}>, seeds binary, slots binary, payload binary"
    order = ["doc_id", F.xxhash64("text")]
    ranged = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    write_table(ranged.mapInArrow(pack, schema), f"{path}/segments")
    write_directory(spark, path)
    return path


def write_directory(spark: SparkSession, path: str) -> None:
    """The index from doc_id to segments, in hash parts of about PART_KEYS documents."""
    stored = spark.read.parquet(f"{path}/segments")
    parts = max(1, -(-(stored.agg(F.sum("n_docs")).first()[0] or 0) // PART_KEYS))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, seg, ids in rows(batches, "shard", "seg", "doc_ids"):
            h = [key_hash(k) for k in dict.fromkeys(ids)]
            cols = [[(x >> 64) % parts for x in h], [x.to_bytes(16, "big") for x in h], [shard] * len(h), [seg] * len(h)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.binary(), pa.int32(), pa.int64()])], ["part", "hash", "shard", "seg"])

    def build(table: pa.Table) -> pa.Table:
        found = sorted(zip(*(table[c].to_pylist() for c in ("hash", "shard", "seg"))))
        places = np.array([x[1:] for x in found], PLACE)
        first = [i for i, x in enumerate(found) if not i or x[0] != found[i - 1][0]]
        hashes = [int.from_bytes(found[i][0], "big") for i in first]
        seeds, slot = build_index(hashes)
        slots = np.zeros(len(first), SLOT)
        slots["fingerprint"][slot] = [h & 0xFFFFFFFF for h in hashes]
        slots["offset"][slot], slots["count"][slot] = first, np.diff([*first, len(found)])
        return pa.table({"part": table["part"][:1], "parts": pa.array([parts], pa.int64()), **{k: pa.array([v.tobytes()], pa.binary()) for k, v in (("seeds", seeds), ("slots", slots), ("places", places))}})

    dealt = stored.select("shard", "seg", "doc_ids").mapInArrow(keys, "part long, hash binary, shard int, seg long")
    dealt.groupBy("part").applyInArrow(build, "part long, parts long, seeds binary, slots binary, places binary").write.option("compression", "zstd").parquet(f"{path}/directory")


def segment_starts(spark: SparkSession, path: str) -> DataFrame:
    """shard, seg, start: ids before each segment. Shards are summed first, so no window holds all segments."""
    segs = spark.read.parquet(f"{path}/segments").select("shard", "seg", "n_ids")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = segs.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", before(Window.orderBy("shard")).alias("shard_start"))  # a row a shard
    inner = segs.withColumnRenamed("n_ids", "n").withColumn("in_shard", before(Window.partitionBy("shard").orderBy("seg")))
    return inner.join(shards, "shard").select("shard", "seg", (F.col("shard_start") + F.col("in_shard")).alias("start"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, each fetched by key through the index."""
    stored = spark.read.parquet(f"{path}/segments")
    id_type = stored.schema["doc_ids"].dataType.elementType

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow_id = to_arrow_type(id_type)
        for shard, seg, ids, seeds, slots, payload in rows(batches, "shard", "seg", "doc_ids", "seeds", "slots", "payload"):
            seeds, slots = np.frombuffer(seeds, "<i4"), np.frombuffer(slots, SLOT)
            copy, before, found = 0, object(), []
            for k in ids:
                copy = copy + 1 if k == before else 0
                before = k
                at, n = find(seeds, slots, k, copy)
                found.append((at, n, zlib.crc32(payload[4 * at : 4 * (at + n)])))
            cols = [[shard] * len(ids), [seg] * len(ids), ids, *zip(*found)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.int64(), arrow_id, pa.int64(), pa.int64(), pa.int64()])], ["shard", "seg", "doc_id", "at", "n_tokens", "ids_crc32"])

    cols = stored.select("shard", "seg", "doc_ids", "seeds", "slots", "payload")
    docs = cols.mapInArrow(fetch, f"shard int, seg long, doc_id {id_type.simpleString()}, at long, n_tokens long, ids_crc32 long")
    return docs.join(segment_starts(spark, path), ["shard", "seg"]).select("doc_id", (F.col("start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """doc_id, ids (array of long) of the keys (doc_id) that the store holds, a row for each copy.

    A key goes to its hash part of the directory, from there to the segments that hold it (one, or several
    where a doc_id repeats), and there through the segment's index to its ids.
    """
    stored, table = spark.read.parquet(f"{path}/segments"), spark.read.parquet(f"{path}/directory")
    id_type = stored.schema["doc_ids"].dataType.elementType
    arrow_id, parts = to_arrow_type(id_type), table.agg(F.max("parts")).first()[0] or 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = [(key_hash(k) >> 64) % parts for k in batch.column("doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(part, pa.int64())], ["doc_id", "part"])

    def route(asked: pa.Table, index: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for seeds, slots, places in zip(*(index[c].to_pylist() for c in ("seeds", "slots", "places"))):
            seeds, slots, places = np.frombuffer(seeds, "<i4"), np.frombuffer(slots, SLOT), np.frombuffer(places, PLACE)
            for k in asked["doc_id"].to_pylist():
                if (at := find(seeds, slots, k)) is not None:
                    out += [(k, int(p["shard"]), int(p["seg"])) for p in places[at[0] : at[0] + at[1]]]
        cols = list(zip(*out)) or [(), (), ()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, [arrow_id, pa.int32(), pa.int64()])], names=["doc_id", "shard", "seg"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for wanted, seeds, slots, payload in rows(batches, "wanted", "seeds", "slots", "payload"):
            seeds, slots = np.frombuffer(seeds, "<i4"), np.frombuffer(slots, SLOT)
            for k in (w["doc_id"] for w in wanted):
                got, copy = [], 0
                while (place := find(seeds, slots, k, copy)) is not None:
                    got.append(np.frombuffer(payload, "<u4", place[1], 4 * place[0]).astype(np.int64))
                    copy += 1
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(got), arrow_id), pa.array(got, pa.list_(pa.int64()))], ["doc_id", "ids"])

    name = id_type.simpleString()
    dealt = keys.select(F.col("doc_id").cast(id_type).alias("doc_id")).distinct().mapInArrow(deal, f"doc_id {name}, part long")
    routed = dealt.groupBy("part").cogroup(table.groupBy("part")).applyInArrow(route, f"doc_id {name}, shard int, seg long")
    # keys of a segment meet in one row, so its payload is read once; structs keep a null doc_id
    wanted = routed.groupBy("shard", "seg").agg(F.collect_list(F.struct("doc_id")).alias("wanted"))
    held = wanted.join(stored.select("shard", "seg", "seeds", "slots", "payload"), ["shard", "seg"])
    return held.select("wanted", "seeds", "slots", "payload").mapInArrow(fetch, f"doc_id {name}, ids array<long>")


def op4(spark, sf_dir: str) -> DataFrame:
    return read(spark, write(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))
