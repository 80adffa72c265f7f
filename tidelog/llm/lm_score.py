"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

1. Token counts of the training texts are summed exactly (table `vocab`).
2. Texts are dealt to chunks, and each chunk sends its distinct 1- and 2-grams, with their counts in
   training texts, to the hash part they belong to. Counts of a part are summed; a 2-gram's count c
   becomes the level 1 + floor(log2 c), and the part's filter gets one membership for each level up to it.
3. A part's filter is as large as its 2-grams need (MAX_FILL), so the filter grows with the corpus and
   every counted 2-gram is in it; nothing of it is broadcast. The part probes it for what the chunks have
   asked, and sends levels (for 1-grams: exact counts) back to the chunks, a byte for each 2-gram.
4. A level is read off by probing level after level until one is missing:
   P(w|h) = (c(hw) + MU P(w)) / (c(h) + MU), P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)).

The exact base score needs the exact count of every token. Tokens of high counts (HEAVY of them at
most, found from a histogram of counts) are broadcast; the others, rare by choice, are joined.
A hot word is therefore never shuffled for each document.

Defined results: null or empty text has the end token only. Repeated rows count and are scored as
they come. An empty training set has N = V = 0. Columns beyond doc_id and text are not read. Hashes have 56 bits; only the n-gram score uses them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import fold, materialize, read_table
from tidelog.llm.text import HashedWords, WordHashes, join_hashes, mix, raw, rows

#: Bytes of the filters of eight parts, about, and the share of bits set in a filter: at 0.1, one in a hundred
#: n-grams reads a level too high.
FILTER_BYTES, MAX_FILL = 1 << 26, 0.1
#: Probes of the first level, and of each further one.
PROBES, MORE_PROBES = 4, 2
HEAVY = 200_000
MU = 30.0
#: n-grams of a part (4.75 bytes of filter each, or less where they repeat), and tokens of a chunk.
PART, CHUNK = FILTER_BYTES >> 5, 1_000_000
KEPT = np.uint64(2**64 - 256)  # bits of a hash; the lowest ones count the training texts
END = b"\n"  # no word holds a line end
ENDS, STARTS = np.uint64(0xD1B54A32D192ED03), np.uint64(0x94D049BB133111EB)  # in place of hashes


def count_tokens(docs: DataFrame) -> DataFrame:
    """token, c: exact counts, summed in each task before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(c: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["token", "c"])

        c: Counter = Counter()
        for (text,) in rows(batches, "text"):
            c.update(raw(text).lower().split())
            c[END] += 1
            if len(c) > WordHashes.BOUND:
                yield out(c)
                c = Counter()
        yield out(c)

    return docs.select("text").mapInArrow(count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def grams(words: HashedWords, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens (words, then the end), of what stands before each, and tokens a text."""
    found, size = words.of(texts)
    flat = np.insert(found, np.cumsum(size), ENDS)
    before = np.empty_like(flat)
    before[1:] = flat[:-1]
    size = size + 1
    before[np.cumsum(size) - size] = STARTS
    return flat, before, size


def level(c: np.ndarray) -> np.ndarray:
    return np.frexp(c.astype(float))[1]


def count_of(level: np.ndarray) -> np.ndarray:
    """Middle of the counts of a level; 0 for none."""
    top = np.exp2(level)
    return np.where(level > 1, (0.5 * top + top - 1) / 2, level)


def positions(hashes: np.ndarray, lv: int, probe: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte and bit of a probe in a filter of size bytes."""
    x = mix(hashes + np.uint64((lv * PROBES + probe + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    bit = ((x >> np.uint64(32)) * np.uint64(8 * size)) >> np.uint64(32)
    return (bit >> np.uint64(3)).astype(np.int64), np.uint8(1) << (bit & np.uint64(7)).astype(np.uint8)


def insert(bits: np.ndarray, hashes: np.ndarray, lv: np.ndarray) -> None:
    """Membership of every level up to lv."""
    k = 1
    while len(hashes):
        for probe in range(PROBES if k == 1 else MORE_PROBES):
            byte, bit = positions(hashes, k, probe, len(bits))
            np.bitwise_or.at(bits, byte, bit)
        k += 1
        more = lv >= k
        hashes, lv = hashes[more], lv[more]


def probe_levels(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Highest level with all levels up to it in the filter."""
    out = np.zeros(len(hashes), np.int64)
    at, k = np.arange(len(hashes)), 1
    while len(at):
        for probe in range(PROBES if k == 1 else MORE_PROBES):
            byte, bit = positions(hashes[at], k, probe, len(bits))
            at = at[(bits[byte] & bit) != 0]
        out[at] = k
        k += 1
    return out


def build_filter(hashes: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The filter of n-grams counted c times: as large as MAX_FILL asks."""
    lv = level(c)
    set_bits = int((PROBES + MORE_PROBES * (lv - 1)).sum())
    bits = np.zeros(max(64, math.ceil(set_bits / -math.log(1 - MAX_FILL) / 8)), np.uint8)
    insert(bits, hashes, lv)
    return bits


def distinct(hashes: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes (56 bits) and how often learn holds for each."""
    h = np.sort(hashes & KEPT | learn)
    first = np.flatnonzero(np.r_[True, h[1:] & KEPT != h[:-1] & KEPT])
    return h[first] & KEPT, np.add.reduceat((h & ~KEPT).astype(np.int64), first)


def pack(h: np.ndarray, c: np.ndarray) -> bytes:
    """Sorted hashes as steps, byte plane by byte plane (the high ones are nearly all zero and compress), and counts."""
    over = np.flatnonzero(c >= 255)
    steps = np.diff(h, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)
    return np.int64(len(over)).tobytes() + over.tobytes() + c[over].tobytes() + steps.T.tobytes() + np.minimum(c, 255).astype(np.uint8).tobytes()


def unpack(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    m = int(np.frombuffer(b, np.int64, 1)[0])
    over, many = np.frombuffer(b, np.int64, m, 8), np.frombuffer(b, np.int64, m, 8 + 8 * m)
    n = (len(b) - 8 - 16 * m) // 9
    c = np.frombuffer(b, np.uint8, n, 8 + 16 * m + 8 * n).astype(np.int64)
    c[over] = many
    steps = np.ascontiguousarray(np.frombuffer(b, np.uint8, 8 * n, 8 + 16 * m).reshape(8, n).T)
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64), c


def answers(dealt: DataFrame, parts: int) -> DataFrame:
    """chunk, kind, part, payload: for each chunk's distinct 1-grams of a part (kind 0) their exact counts,
    for its 2-grams (kind 1) their levels, in order of the hashes; grams, admitted: those of the part in training texts, and those found again, in one row."""
    shift = np.uint64(64 - parts.bit_length() + 1)

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        flat, before, size = grams(HashedWords(), [raw(t).lower() for t in table["text"].to_pylist()])
        learn = np.repeat(np.array(table["learn"].to_pylist(), np.uint64), size)
        kinds, which, payload = [], [], []
        for kind, h in enumerate((mix(flat), join_hashes(before, flat))):
            one, c = distinct(h, learn)
            cut = np.searchsorted(one >> shift, np.arange(parts + 1, dtype=np.uint64))
            for p in np.flatnonzero(np.diff(cut)):
                s = slice(cut[p], cut[p + 1])
                payload.append(pack(one[s], c[s]))
                kinds.append(kind)
                which.append(p)
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(which), pa.int64()), "kind": pa.array(kinds, pa.int32()), "part": pa.array(which, pa.int32()), "payload": pa.array(payload, pa.binary())})

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        got = [unpack(b) for b in table["payload"].to_pylist()]
        asked, c = np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])
        order = np.argsort(asked)
        h, c = asked[order], c[order]
        new = np.r_[True, h[1:] != h[:-1]]
        first = np.flatnonzero(new)
        h, c = h[first], np.add.reduceat(c, first)
        counted = c > 0
        value = c
        if key[0].as_py():
            value = probe_levels(build_filter(h[counted], c[counted]), h).astype(np.uint8)
        out = np.empty(len(asked), value.dtype)
        out[order] = value[np.cumsum(new) - 1]
        cut = np.cumsum([0] + [len(x) for x, _ in got])
        once = lambda n: pa.array([int(n)] + [0] * (len(got) - 1), pa.int64())
        return pa.table({
            "chunk": table["chunk"], "kind": table["kind"], "part": table["part"],
            "payload": pa.array([out[i:j].tobytes() for i, j in zip(cut, cut[1:])], pa.binary()), "grams": once(counted.sum()), "admitted": once((value[counted] > 0).sum()),
        })

    asked = dealt.groupBy("chunk").applyInArrow(ask, "chunk long, kind int, part int, payload binary")
    return asked.groupBy("kind", "part").applyInArrow(answer, "chunk long, kind int, part int, payload binary, grams long, admitted long")


def heavy_tokens(vocab: DataFrame) -> tuple[dict[bytes, int], int]:
    """The most frequent tokens, HEAVY at most, and the count from which a token is one of them."""
    hist = dict(vocab.groupBy(F.floor(F.log2("c")).cast("int").alias("b")).count().collect())  # 64 rows at most
    total, b = 0, max(hist, default=0) + 1
    while b > 0 and total + hist.get(b - 1, 0) <= HEAVY:
        b -= 1
        total += hist.get(b, 0)
    return {bytes(r.token): r.c for r in vocab.filter(F.col("c") >= (1 << b)).toLocalIterator()}, 1 << b


def score(docs: DataFrame, rows_to_learn: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    learn = docs.filter(F.coalesce(rows_to_learn, F.lit(False)))
    vocab = materialize(count_tokens(learn), "vocab")
    n, v, d = (x or 0 for x in vocab.agg(F.sum("c"), F.count("*"), F.max(F.when(F.col("token") == F.lit(END), F.col("c")))).first())
    heavy, _ = heavy_tokens(vocab)
    logs_of_heavy = {w: math.log10(c + 0.1) for w, c in heavy.items()}
    shared_logs = spark.sparkContext.broadcast(logs_of_heavy)
    norm = n + 0.1 * (v + 1)
    size, texts = (x or 0 for x in docs.agg(F.sum(F.octet_length("text")), F.count("*")).first())
    tokens = size / 5 + texts  # about
    chunk = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(max(8, math.ceil(tokens / CHUNK))))
    dealt = materialize(docs.select("doc_id", "text", F.coalesce(rows_to_learn, F.lit(False)).cast("int").alias("learn"), chunk.cast("long").alias("chunk")), "dealt")
    parts = 1 << max(3, math.ceil(math.log2(max(1, tokens / PART))))

    def read(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        logs = shared_logs.value
        texts = [raw(t).lower() for t in left["text"].to_pylist()]
        flat, before, size = grams(HashedWords(), texts)
        first = np.r_[0, np.cumsum(size)[:-1]]
        told = sorted(zip(*(right[c].to_pylist() for c in ("kind", "part", "payload"))))

        def values(h: np.ndarray, kind: int, dtype: type) -> np.ndarray:
            h = h & KEPT
            return np.frombuffer(b"".join(x for k, _, x in told if k == kind), dtype)[np.searchsorted(np.unique(h), h)]

        of_word = values(mix(flat), 0, np.int64)
        history = np.empty_like(of_word)
        history[1:] = of_word[:-1]
        history[first] = max(1, d)
        pair = np.minimum(count_of(values(join_hashes(before, flat), 1, np.uint8).astype(np.int64)), history)
        p = (pair + MU * (of_word + 0.1) / norm) / (history + MU)
        total = np.add.reduceat(np.log10(p), first)
        known, partial, ends, tokens, times = [], [], [0], [], []
        for w in map(bytes.split, texts):
            found = [logs[t] for t in w if t in logs]
            found += [logs[END]] if END in logs else []
            rest = Counter(t for t in w if t not in logs)
            if END not in logs:
                rest[END] += 1
            known.append(len(found))
            partial.append(math.fsum(found))
            tokens += rest
            times += rest.values()
            ends.append(len(tokens))
        counted = pa.StructArray.from_arrays([pa.array(tokens, pa.binary()), pa.array(times, pa.int64())], ["token", "k"])
        rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), counted)
        once = lambda c: pa.array([sum(right[c].to_pylist())] + [0] * (len(texts) - 1), pa.int64())
        return pa.table({
            "row": pa.array((key[0].as_py() << 33) + np.arange(len(texts)), pa.int64()), "doc_id": left["doc_id"], "n_tokens": pa.array(size, pa.int64()), "heavy": pa.array(known, pa.int64()),
            "partial": pa.array(partial, pa.float64()), "score": pa.array(total, pa.float64()), "rare": rare, "grams": once("grams"), "admitted": once("admitted"),
        })

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = dealt.groupBy("chunk").cogroup(answers(dealt, parts).groupBy("chunk")).applyInArrow(
        read, f"row long, doc_id {kind}, n_tokens long, heavy long, partial double, score double, rare array<struct<token:binary,k:long>>, grams long, admitted long"
    )
    out = materialize(scored, "lm")
    counted, admitted = (x or 0 for x in out.agg(F.sum("grams"), F.sum("admitted")).first())
    found = (
        out.select("row", F.explode("rare").alias("t")).select("row", "t.token", "t.k")
        .join(vocab, "token")
        .groupBy("row").agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("c") + 0.1)).alias("part"))
    )
    known = F.col("heavy") + F.coalesce("more", F.lit(0))
    return out.drop("rare", "grams", "admitted").join(found, "row", "left").select(
        "doc_id", "n_tokens", known.alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("partial") + F.coalesce("part", F.lit(0.0)) + F.lit(math.log10(0.1)) * (F.col("n_tokens") - known) - F.col("n_tokens") * F.lit(math.log10(norm))).alias("base_score"),
        "score", F.lit(counted).cast("long").alias("model_grams"), F.lit(admitted).cast("long").alias("model_admitted"), F.lit(1).cast("long").alias("model_least_count"),
    )


def op1(spark, sf_dir: str) -> DataFrame:
    out = score(read_table(spark, sf_dir, "documents"), fold("doc_id", 10) != 0)
    return out.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), *[c for c in out.columns if c != "doc_id"])
