"""N-gram Jaccard join, size-aware: fixed-size subsets for light sets, inverted lists for heavy ones.

A document's set is its distinct word shingles. Two sets of a and b shingles link when
100 * |A & B| >= 80 * |A | B|, that is |A & B| >= ceil(4 (a + b) / 9).

1. One pass gives every document its set's size and 64-bit id (equal sets are one node from here on)
   and a fixed-size sketch of how many documents hold each shingle.
2. Light sets (size up to a boundary) emit, for every size they may link with, all subsets of the
   size that a link must share: two sets with a common subset are linked. The boundary is where the
   subsets of a set outnumber what its inverted lists cost (`boundary`).
3. Heavy sets are looked up in inverted lists. In any common order of shingles, linked sets share one
   of the first prefix(n). The order used: half of all shingles (by a bit of their hash) first, rarest
   first; then the others by hash. So half of the shingles are dealt to their lists, lists of one set
   are dropped, and a set with prefix(n) shingles of its own has no partner and drops out. Of the
   other sets the rarest shared shingles up to prefix(n) stay.
4. Parity bitmaps of the sets bound the overlap of a pair from above; only pairs that they leave room for
   are compared, exactly, on their texts. In short lists all pairs are looked at and kept once, and every
   set is compared with one of its mates first; those of different components follow. Long lists are
   searched block against block inside tasks. In the first rounds a block gives the pairs that join its
   components without a circle, nearest first, and links are united to components; the last round gives all
   pairs of different components that are left. A list of near copies therefore gives rows by its length,
   not its square, and no link between components is missed.

5. The links of a set are counted inside its component (`links`): exactly, block against block inside tasks,
   with sums as their only rows.

Shingles that very many documents hold (by the sketch) are known to be shared: they skip the dealing
to lists, so no task gets a hot list whole.

Defined results: null texts and texts without words have an empty set and are alone; texts of fewer
than WORDS words have one shingle, the whole sequence. Repeated rows have equal sets and share a
component. component_id is the smallest non-null doc_id of the component. An empty table gives no
rows. Set ids are 64-bit hashes: with 10**9 different texts two collide with probability 0.03.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidelog.llm.common import give_back, lean, materialize, read_table
from tidelog.llm.text import HashedWords, mix, raw, rows

WORDS = 5
CELLS, SLICES = 1 << 21, 64
CHUNK = 400_000
#: A shingle of so many documents by the sketch (and of HOT_SHARE times a cell's mean) counts as shared without a list.
HOT, HOT_SHARE = 4096, 8
#: Sketches that are added in one group.
TREE = 256
#: Entries of a part of the lists.
PART = 600_000
#: Shingles of a block of sets whose links are counted.
LINK_BLOCK = 2_000_000
#: Rounds of comparisons; all but the last take pairs that join components without a circle.
TURNS = 3
#: All pairs of a list of so many sets are looked at; longer ones are searched in tasks, in blocks of BLOCK sets.
LONG, BLOCK = 64, 4096
#: Pairs of a block that are held before they are reduced to those that join components.
HELD = 1_000_000
#: Bits of a set's parity bitmap.
BITS = 2048
MAX_LIGHT = 16


def needed(a: int, b: int) -> int:
    """Shared shingles that a link of sets of a and b shingles takes."""
    return -(-4 * (a + b) // 9)


def sizes_linked(n: int) -> range:
    """Sizes that a set of n shingles can link with."""
    return range(-(-4 * n // 5), 5 * n // 4 + 1)


def prefix(n):
    """Linked sets share one of the first prefix(n) shingles of any common order."""
    return n - (4 * n + 4) // 5 + 1


def light_cost(n: int) -> int:
    return sum(comb(n, needed(n, m)) for m in sizes_linked(n))


def boundary(list_length: float) -> int:
    """Largest size up to which subsets cost no more rows than list entries, comparisons and a set's own text."""
    x = 0
    while x < MAX_LIGHT and light_cost(x + 1) <= prefix(x + 1) * (1 + list_length) + x + 1:
        x += 1
    return x


def shingle_hashes(flat: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on, from the words' hashes."""
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += flat[at + k]
    return mix(out ^ np.uint64(n))


def doc_sets(words: HashedWords, texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, text by text and ascending in each, and how many each has."""
    flat, size = words.of([raw(t).lower() for t in texts])
    first = np.cumsum(size) - size
    count = np.where(size < WORDS, np.minimum(size, 1), size - WORDS + 1)
    end = np.cumsum(count)
    begin = end - count
    h = np.empty(int(count.sum()), np.uint64)
    for n in range(1, WORDS + 1):
        of = np.flatnonzero(size == n) if n < WORDS else np.flatnonzero(size >= n)
        run = count[of]
        inner = np.arange(int(run.sum())) - np.repeat(np.cumsum(run) - run, run)
        h[np.repeat(begin[of], run) + inner] = shingle_hashes(flat, np.repeat(first[of], run) + inner, n)
    for a, b in zip(begin.tolist(), end.tolist()):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[begin[count > 0]] = True
    upto = np.r_[0, np.cumsum(new)]
    return h[new], upto[end] - upto[begin]


def set_ids(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set; sets of 0 shingles get 0."""
    total = np.zeros(len(n), np.uint64)
    have = np.flatnonzero(n)
    first = (np.cumsum(n) - n)[have]
    if len(have):
        total[have] = mix(np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), first) + n[have].astype(np.uint64))
    return total.view(np.int64)


def text_chunks(batches: Iterator[pa.RecordBatch], *cols: str) -> Iterator[list[tuple]]:
    """Rows, about CHUNK words at a time; the last column is the text."""
    held, size = [], 0
    for row in rows(batches, *cols):
        held.append(row)
        size += len(row[-1] or "") // 6 + 1
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def cells(h: np.ndarray) -> np.ndarray:
    return (mix(h) & np.uint64(CELLS - 1)).astype(np.int64)


def survey(docs: DataFrame) -> DataFrame:
    """Table of members (doc_id, key, n, set_id) and of each task's sketch (task, slice, counts)."""
    id_type = docs.schema["doc_id"].dataType
    names = ["doc_id", "key", "n", "set_id", "task", "slice", "counts"]
    types = [to_arrow_type(id_type), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, sketch = HashedWords(), np.zeros(CELLS, np.uint32)
        for held in text_chunks(batches, "doc_id", "key", "text"):
            h, n = doc_sets(words, [r[2] for r in held])
            sketch += np.bincount(cells(h), minlength=CELLS).astype(np.uint32)
            ids = set_ids(h, n)
            k = len(held)
            cols = [[r[0] for r in held], [r[1] for r in held], n.astype(np.int64), ids, [None] * k, [None] * k, [None] * k]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
        part = np.minimum(sketch, 65535).astype("<u2").reshape(SLICES, -1)
        cols = [[None] * SLICES] * 4 + [[TaskContext.get().partitionId()] * SLICES, np.arange(SLICES), [p.tobytes() for p in part]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    cols = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    return materialize(cols.mapInArrow(lean(scan), f"doc_id {id_type.simpleString()}, key long, n long, set_id long, task int, slice int, counts binary"), "sets")


def frequency_sketch(surveyed: DataFrame) -> tuple[np.ndarray, float, int]:
    """Level of each cell (4 log2 of its count), the mean length of a shingle's list beyond the cells' own noise, and the number of shingles."""

    def some(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CELLS // SLICES, "<u4")
        for b in pdf["counts"]:
            total += np.frombuffer(b, "<u2")
        return pd.DataFrame({"slice": [key[0]], "counts": [total.tobytes()]})

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(CELLS // SLICES, np.int64)
        for b in pdf["counts"]:
            total += np.frombuffer(b, "<u4")
        level = np.minimum(255, np.round(4 * np.log2(1 + total))).astype(np.uint8)
        return pd.DataFrame({"slice": [key[0]], "level": [level.tobytes()], "s1": [float(total.sum())], "s2": [float((total**2).sum())]})

    # tasks by TREE first, so that no group holds the sketches of all tasks
    parts = surveyed.filter(F.col("slice").isNotNull()).select("slice", F.floor(F.col("task") / TREE).alias("some"), "counts")
    merged = parts.groupBy("slice", "some").applyInPandas(some, "slice int, counts binary")
    got = merged.groupBy("slice").applyInPandas(add, "slice int, level binary, s1 double, s2 double").collect()
    level, s1, s2 = np.zeros(CELLS, np.uint8), 0.0, 0.0
    for r in got:  # CELLS bytes in all
        level[r.slice * (CELLS // SLICES) : (r.slice + 1) * (CELLS // SLICES)] = np.frombuffer(r.level, np.uint8)
        s1, s2 = s1 + r.s1, s2 + r.s2
    return level, max(0.0, s2 / s1 - s1 / CELLS) if s1 else 0.0, int(s1)


def subset_keys(h: np.ndarray) -> list[tuple[int, int]]:
    """(key, size linked with) of all subsets of a light set."""
    n, out = len(h), []
    values = sorted(int(x) for x in h)  # ordered, so equal subsets give equal keys
    for m in sizes_linked(n):
        salt = (min(n, m) << 8 | max(n, m)) * 0x9E3779B97F4A7C15
        for sub in combinations(values, needed(n, m)):
            key = salt
            for v in sub:
                key = ((key ^ v) * 0xBF58476D1CE4E5B9 + 0x94D049BB133111EB) & (2**64 - 1)
                key ^= key >> 29
            out.append((key, m))
    return out


def pack(kind: int, *columns: np.ndarray) -> bytes:
    return bytes([kind]) + b"".join(np.ascontiguousarray(c).tobytes() for c in columns)


def unpack(b: bytes, *types: str) -> list[np.ndarray]:
    kinds = [np.dtype(t) for t in types]
    n = (len(b) - 1) // sum(t.itemsize for t in kinds)
    out, at = [], 1
    for t in kinds:
        out.append(np.frombuffer(b, t, n, at))
        at += n * t.itemsize
    return out


def reported(docs: DataFrame, level: np.ndarray, light: int, shingles: int) -> DataFrame:
    """key, set_id, n, first, df, pos, other of all shared entries.

    other: size linked with for subsets of light sets, 0 for shingles. pos: place in the set's order, -1
    where it follows from df. first: how many of the set's shingles are in the first half of all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(level)  # CELLS bytes
    parts = 1 << max(3, int(np.ceil(np.log2(max(1, shingles / 2 / PART)))))
    shift = np.uint64(64 - parts.bit_length() + 1)
    heavy_from = -(-4 * (light + 1) // 5)  # the smallest size that links with a heavy set
    hot_level = 4 * np.log2(1 + max(HOT, HOT_SHARE * shingles / CELLS))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, level, seen = HashedWords(), shared.value, set()
        for held in text_chunks(batches, "text"):
            h, n = doc_sets(words, [r[0] for r in held])
            ids = set_ids(h, n)
            begin = np.cumsum(n) - n
            fresh = np.zeros(len(n), bool)
            for i in np.flatnonzero(n):
                if ids[i] not in seen:
                    seen.add(ids[i])
                    fresh[i] = True
            out: list[tuple[int, bytes]] = []
            owner = np.repeat(np.arange(len(n)), n)
            heavy = (fresh & (n >= heavy_from))[owner]
            front = (h & np.uint64(1)) == 0
            first = np.bincount(owner[front], minlength=len(n))
            hot = level[cells(h)] >= hot_level
            pos = np.full(len(h), -1, np.int32)
            for i in np.flatnonzero(fresh & (n >= heavy_from) & (first < prefix(n))):  # too few in the first half: the others by hash
                own = np.arange(begin[i], begin[i] + n[i])
                rest = own[~front[own]]
                rest = rest[: int(prefix(n[i]) - first[i])]  # ascending
                pos[rest] = first[i] + np.arange(len(rest))
            dealt = heavy & (front | (pos >= 0))
            at = np.flatnonzero(dealt & hot)
            if len(at):
                who = owner[at]
                to = (ids[who] % parts).astype(np.int64)
                for p in np.unique(to):
                    x = at[to == p]
                    w = owner[x]
                    out.append((int(p), pack(1, h[x], ids[w], n[w].astype("<i4"), first[w].astype("<i4"), np.exp2(level[cells(h[x])] / 4.0).astype("<i8"), pos[x])))
            at = np.flatnonzero(dealt & ~hot)
            part = (h[at] >> shift).astype(np.int64)
            at, part = at[np.argsort(part, kind="stable")], np.sort(part, kind="stable")
            cut = np.searchsorted(part, np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cut)):
                x = at[cut[p] : cut[p + 1]]
                w, local = np.unique(owner[x], return_inverse=True)
                head = pack(0, np.array([len(w)], "<i8"), ids[w], n[w].astype("<i4"), first[w].astype("<i4"))
                out.append((int(p), head + pack(0, h[x], local.astype("<i4"), pos[x])[1:]))
            for i in np.flatnonzero(fresh & (n <= light) & (n > 0)):
                keys = subset_keys(h[begin[i] : begin[i] + n[i]])
                out.append((int(ids[i] % parts), pack(2, np.array([k for k, _ in keys], np.uint64), np.full(len(keys), ids[i]), np.full(len(keys), n[i], "<i4"), np.array([m for _, m in keys], "<i4"))))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int32()), pa.array([b for _, b in out], pa.binary())], ["part", "payload"])

    names = ["key", "set_id", "n", "first", "df", "pos", "other"]

    def group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cold: list[list[np.ndarray]] = [[] for _ in range(5)]
        hot: list[list[np.ndarray]] = [[] for _ in range(6)]
        rows_out: list[list[np.ndarray]] = [[] for _ in names]

        def give(*cols) -> None:
            k = len(cols[0])
            for c, v in zip(rows_out, cols):
                c.append(np.broadcast_to(v, k) if np.ndim(v) == 0 else v)

        for b in pdf["payload"]:
            if b[0] == 0:
                m = int(np.frombuffer(b, "<i8", 1, 1)[0])
                ids, n, first = np.frombuffer(b, "<i8", m, 9), np.frombuffer(b, "<i4", m, 9 + 8 * m), np.frombuffer(b, "<i4", m, 9 + 12 * m)
                h, local, pos = unpack(b[8 + 16 * m :], "<u8", "<i4", "<i4")
                for c, v in zip(cold, (h, ids[local], n[local], first[local], pos)):
                    c.append(v)
            elif b[0] == 1:
                for c, v in zip(hot, unpack(b, "<u8", "<i8", "<i4", "<i4", "<i8", "<i4")):
                    c.append(v)
            else:
                h, ids, n, other = unpack(b, "<u8", "<i8", "<i4", "<i4")
                give(h.view(np.int64), ids, n, 0, 0, 0, other)
        if hot[0]:
            h, ids, n, first, df, pos = (np.concatenate(c) for c in hot)
            order = np.lexsort((ids, h))
            new = np.r_[True, (h[order][1:] != h[order][:-1]) | (ids[order][1:] != ids[order][:-1])]  # one set from several tasks
            h, ids, n, first, df, pos = (x[order][new] for x in (h, ids, n, first, df, pos))
            give(h.view(np.int64), ids, n, first, df, pos, 0)
        if cold[0]:
            h, ids, n, first, pos = (np.concatenate(c) for c in cold)
            cold.clear()
            order = np.argsort(h, kind="stable")
            hs = h[order]
            near = hs[1:] == hs[:-1]
            order = order[np.r_[near, False] | np.r_[False, near]]  # lists of one entry go
            order = order[np.lexsort((ids[order], h[order]))]
            h, ids, n, first, pos = (x[order] for x in (h, ids, n, first, pos))
            new = np.r_[True, (h[1:] != h[:-1]) | (ids[1:] != ids[:-1])] if len(h) else np.zeros(0, bool)  # one set from several tasks
            h, ids, n, first, pos = (x[new] for x in (h, ids, n, first, pos))
            run = np.cumsum(np.r_[True, h[1:] != h[:-1]]) - 1 if len(h) else np.zeros(0, int)
            df = np.bincount(run)[run] if len(h) else run
            k = df > 1
            give(h[k].view(np.int64), ids[k], n[k], first[k], df[k], pos[k], 0)
        cold.clear()
        hot.clear()
        give_back()  # a part is large, its worker lives on
        return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in zip(names, rows_out)})

    emitted = docs.select("text").mapInArrow(lean(emit), "part int, payload binary")
    return emitted.groupBy("part").applyInPandas(group, "key long, set_id long, n int, first int, df long, pos int, other int")


def lists(docs: DataFrame, level: np.ndarray, light: int, shingles: int) -> DataFrame:
    """key, set_id, n, pos, other: shared entries of the prefixes, and subsets of light sets."""
    rows = reported(docs, level, light, shingles)
    ranked = rows.withColumn("free", (F.col("other") == 0) & (F.col("pos") < 0))
    of_set = Window.partitionBy("set_id", "free")
    place = F.col("first") - F.count("*").over(of_set) + F.row_number().over(of_set.orderBy("df", "key")) - 1
    ranked = ranked.withColumn("pos", F.when(F.col("free"), place.cast("int")).otherwise(F.col("pos")))
    length = F.col("n") - F.floor((4 * F.col("n") + 4) / 5) + 1
    kept = ranked.filter((F.col("other") > 0) | (F.col("pos") < length))
    return materialize(kept.select("key", "set_id", "n", "pos", "other"), "lists")


def compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts link."""

    @F.pandas_udf("boolean")
    def linked(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        words = HashedWords()
        for left, right in batches:
            out = []
            for at in range(0, len(left), 64):
                one, two = list(left[at : at + 64]), list(right[at : at + 64])
                h, n = doc_sets(words, one + two)
                cut = np.split(h, np.cumsum(n)[:-1])
                for i in range(len(one)):
                    a, b = cut[i], cut[len(one) + i]
                    both = len(a) + len(b) - len(np.union1d(a, b))
                    out.append(bool(len(a) and len(b) and 100 * both >= 80 * (len(a) + len(b) - both)))
            yield pd.Series(out)

    left = pairs.join(texts.select(F.col("set_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("set_id").alias("b"), F.col("text").alias("text_b")), "b")
    return both.filter(linked("text_a", "text_b")).select("a", "b")


def bitmaps(texts: DataFrame) -> DataFrame:
    """set_id, size, bits: for each place whether an odd number of the set's shingles falls on it."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = HashedWords()
        for held in text_chunks(batches, "set_id", "text"):
            for at in range(0, len(held), 512):
                some = held[at : at + 512]
                h, n = doc_sets(words, [t for _, t in some])
                place = np.repeat(np.arange(len(n)), n) * BITS + (mix(h ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(BITS - 1)).astype(np.int64)
                odd = (np.bincount(place, minlength=len(n) * BITS) & 1).astype(np.uint8).reshape(len(n), BITS)
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int64()), pa.array(n, pa.int64()), pa.array([x.tobytes() for x in np.packbits(odd, axis=1)], pa.binary())], ["set_id", "size", "bits"])

    return texts.select("set_id", "text").mapInArrow(lean(draw), "set_id long, size long, bits binary")


def forest(comp: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The pairs (i, j), given best first, that join components of rows (comp) without a circle: every component takes its best pair, again and again."""
    kept, edge = [], np.arange(len(i))
    while len(edge):
        a, b = comp[i[edge]], comp[j[edge]]
        best = np.full(int(comp.max()) + 1, len(edge))
        np.minimum.at(best, a, np.arange(len(edge)))
        np.minimum.at(best, b, np.arange(len(edge)))
        pick = np.unique(best[best < len(edge)])
        kept.append(edge[pick])
        parent = np.arange(len(best))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for x, y in zip(a[pick].tolist(), b[pick].tolist()):
            x, y = root(x), root(y)
            parent[max(x, y)] = min(x, y)
        comp = np.array([root(x) for x in range(len(parent))])[comp]
        edge = edge[comp[i[edge]] != comp[j[edge]]]
    return np.concatenate(kept) if kept else edge


def block_pairs(live: DataFrame, light: int, every: bool) -> DataFrame:
    """set_id, leader: pairs of different labels in long lists whose bitmaps leave room for a link; all, or only
    those that join labels without a circle, nearest first, so no more than the sets of two blocks.

    live: key, cls, held, set_id, n, label, bits. An overlap is at most (n + m - bits that differ) / 2.
    """

    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "set_id"])
        ids, n, part = (pdf[c].to_numpy() for c in ("set_id", "n", "part"))
        label = np.unique(pdf["label"].to_numpy(), return_inverse=True)[1]
        bits = np.frombuffer(b"".join(pdf["bits"]), np.uint64).reshape(len(pdf), -1)
        a, b, far, size = [], [], [], 0

        def gathered() -> list[np.ndarray]:
            x, y, apart = (np.concatenate(c) for c in (a, b, far))
            if every:
                return [x, y, apart]
            # the same order of pairs in all lists, so that lists of the same sets give the same pairs
            order = np.lexsort((np.maximum(ids[x], ids[y]), np.minimum(ids[x], ids[y]), apart))
            return [c[order[forest(label, x[order], y[order])]] for c in (x, y, apart)]

        for i in range(len(ids)):
            to = int(np.searchsorted(n, 5 * n[i] // 4, "right"))
            mate = np.arange(i + 1, to)
            mate = mate[(label[mate] != label[i]) & ((n[mate] > light) | (n[i] > light))]
            if key[2] != key[3]:
                mate = mate[part[mate] != part[i]]
            apart = np.bitwise_count(bits[mate] ^ bits[i]).sum(1, dtype=np.int64)
            room = 9 * (n[i] + n[mate] - apart) >= 8 * (n[i] + n[mate])
            for c, v in zip((a, b, far), (np.full(int(room.sum()), i), mate[room], apart[room])):
                c.append(v)
            size += len(a[-1])
            if size > HELD and not every:
                a, b, far = ([c] for c in gathered())
                size = len(a[0])
        a, b, _ = gathered()
        return pd.DataFrame({"set_id": ids[a], "leader": ids[b]}).astype("int64")

    blocks = F.ceil(F.col("held") / BLOCK).cast("int")
    dealt = live.withColumn("part", F.pmod(F.xxhash64("set_id"), blocks).cast("int")).withColumn("_j", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumn("b0", F.least("part", "_j")).withColumn("b1", F.greatest("part", "_j"))
    return dealt.select("key", "cls", "b0", "b1", "set_id", "n", "label", "part", "bits").groupBy("key", "cls", "b0", "b1").applyInPandas(search, "set_id long, leader long")


def connect(links: DataFrame) -> DataFrame:
    """set_id, label: the smallest set_id reachable, by passing minima along links and jumping to the label's label."""
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = materialize(both.groupBy(F.col("a").alias("set_id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("set_id")).groupBy("a").agg(F.min("label").alias("near"))
        passed = labels.join(near, F.col("set_id") == F.col("a")).select("set_id", F.least("label", "near").alias("to"), F.col("label").alias("old"))
        jump = labels.select(F.col("set_id").alias("to"), F.col("label").alias("further"))
        new = materialize(passed.join(jump, "to", "left").select("set_id", F.least("to", F.coalesce("further", "to")).alias("label"), "old"), "labels")
        if new.filter(F.col("label") != F.col("old")).isEmpty():
            return new.select("set_id", "label")
        labels = new.select("set_id", "label")


def with_label(rows: DataFrame, labels: DataFrame | None, of: str, name: str) -> DataFrame:
    """The label of the set in column `of`: its own id where it has no link yet."""
    if labels is None:
        return rows.withColumn(name, F.col(of))
    return rows.join(labels.select(F.col("set_id").alias(of), F.col("label").alias("_l")), of, "left").withColumn(name, F.coalesce("_l", of)).drop("_l")


def unite(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels with those of newly linked sets made one: only the labels are connected anew, not all links."""
    if labels is None:
        return connect(links)
    ends = with_label(with_label(links, labels, "a", "la"), labels, "b", "lb")
    moved = connect(ends.filter("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    alone = links.select(F.col("a").alias("set_id")).union(links.select("b")).withColumn("label", F.col("set_id"))
    every = labels.unionByName(alone).groupBy("set_id").agg(F.min("label").alias("label"))
    moved = moved.select(F.col("set_id").alias("label"), F.col("label").alias("to"))
    return materialize(every.join(moved, "label", "left").select("set_id", F.coalesce("to", "label").alias("label")), "labels")


def bounded_overlap() -> Column:
    """Whether sizes and places in the two prefixes (n, pos and m, mpos) leave room for a link."""
    room = F.least("pos", "mpos") + 1 + F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("mpos")) - 1
    sizes = (5 * F.least("n", "m") >= 4 * F.greatest("n", "m"))
    return sizes & (9 * room >= 4 * (F.col("n") + F.col("m")))


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("set_id", "leader").alias("a"), F.greatest("set_id", "leader").alias("b")).filter("a <> b").distinct()


def roomy(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and bitmaps leave room for a link."""

    @F.pandas_udf("boolean")
    def room(x: pd.Series, y: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=bool)
        left, right = (np.frombuffer(b"".join(c), np.uint64).reshape(len(c), -1) for c in (x, y))
        apart = np.bitwise_count(left ^ right).sum(1, dtype=np.int64)
        return pd.Series(9 * (n + m - apart) >= 8 * (n + m))

    for end in "ab":
        pairs = pairs.join(bits.select(F.col("set_id").alias(end), F.col("bits").alias(f"bits_{end}"), F.col("size").alias(f"n_{end}")), end)
    return pairs.filter(room("bits_a", "bits_b", "n_a", "n_b")).select("a", "b")


def links_found(entries: DataFrame, texts: DataFrame, light: int) -> DataFrame | None:
    """set_id, label of all sets with a link; None where there is no link."""
    # light lists: every set with the smallest set of the other size (of its own, where the sizes are equal)
    subsets = entries.filter("other > 0").withColumn("lo", F.least("n", "other")).withColumn("hi", F.greatest("n", "other"))
    heads = subsets.groupBy("key").agg(F.min(F.when(F.col("n") == F.col("lo"), F.col("set_id"))).alias("low"), F.min(F.when(F.col("n") == F.col("hi"), F.col("set_id"))).alias("high"))
    light_pairs = subsets.join(heads, "key").select("set_id", F.when(F.col("n") == F.col("lo"), F.col("high")).otherwise(F.col("low")).alias("leader")).filter("leader is not null")

    heavy = entries.filter("other = 0").drop("other")
    heavy = heavy.join(heavy.groupBy("key").agg(F.count("*").alias("held")).filter("held > 1"), "key")
    bits = materialize(bitmaps(texts), "bits")

    # short lists: all pairs with room for a link, once each
    short = heavy.filter(F.col("held") <= LONG)
    mate = short.select("key", F.col("set_id").alias("leader"), F.col("n").alias("m"), F.col("pos").alias("mpos"))
    near = short.join(mate, "key").filter((F.col("set_id") < F.col("leader")) & ((F.col("n") > light) | (F.col("m") > light)) & bounded_overlap())
    near = materialize(roomy(ordered(near), bits), "near")

    # long lists by size: linked sets have a size class in common
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.26))).cast("int")
    long = heavy.filter(F.col("held") > LONG).withColumn("cls", F.explode(F.array(size_class, size_class - 1))).drop("held", "pos")
    long = materialize(long, "long")

    compared = labels = None
    for turn in range(TURNS):
        part = with_label(long, labels, "set_id", "label")
        live = part.groupBy("key", "cls").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.count("*").alias("held")).filter("l0 <> l1").select("key", "cls", "held")
        if turn > 1:  # short lists are done
            live = materialize(live, "live")
            if live.isEmpty():
                break
        new = ordered(block_pairs(part.join(live, ["key", "cls"]).join(bits.drop("size"), "set_id"), light, turn == TURNS - 1))
        if turn == 0:  # one mate a set to begin with: of all its mates that with the lowest hash, which mates of one set have in common
            both = near.select(F.col("a").alias("set_id"), F.col("b").alias("leader")).union(near.select("b", "a"))
            one = both.groupBy("set_id").agg(F.min(F.struct(F.xxhash64("leader"), "leader")).alias("h")).select("set_id", "h.leader")
            new = new.union(ordered(one.unionByName(light_pairs))).distinct()
        else:
            if turn == 1:
                new = new.union(with_label(with_label(near, labels, "a", "la"), labels, "b", "lb").filter("la <> lb").select("a", "b")).distinct()
            new = new.join(compared, ["a", "b"], "left_anti")
        new = materialize(new, "pairs")
        found = materialize(compare(new, texts), "found")
        compared = new if compared is None else compared.unionByName(new)
        if not found.isEmpty():
            labels = unite(labels, found)
    return labels


def join(docs: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Members (doc_id, key: xxhash64 of the text, n, set_id: null without words) of every row of docs; set_id, label of all
    sets with a link to another (None where there is none); set_id, text of all sets that may have one."""
    surveyed = survey(docs)
    members = surveyed.filter(F.col("slice").isNull()).select("doc_id", "key", "n", F.when(F.col("n") > 0, F.col("set_id")).alias("set_id"))
    level, list_length, shingles = frequency_sketch(surveyed)
    light = boundary(list_length)
    entries = lists(docs, level, light, shingles)

    wanted = entries.select("set_id").distinct()
    first = members.join(wanted, "set_id").groupBy("set_id").agg(F.min(F.struct("doc_id", "key")).alias("r")).select("set_id", F.col("r.doc_id").alias("rid"), F.col("r.key").alias("rkey"))
    source = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    texts = source.join(first, F.col("doc_id").eqNullSafe(F.col("rid")) & (F.col("key") == F.col("rkey")))
    texts = materialize(texts.groupBy("set_id").agg(F.min("text").alias("text")), "texts")
    return members, links_found(entries, texts, light), texts


def with_component(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    node = with_label(members, labels, "set_id", "label")
    smallest = node.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    return node.join(smallest, "label", "left").withColumn("component_id", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))).drop("least")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, key (xxhash64 of the text), n, set_id, label (null without words), component_id of every row of docs."""
    members, labels, _ = join(docs)
    return with_component(members, labels)


def link_sums(sets: DataFrame) -> DataFrame:
    """set_id, linked: how many rows the sets linked with this one have; of label, set_id, n, copies, text of all sets with a link.

    Links lie inside components, so the sets of a component are compared block against block inside tasks,
    every pair of fitting sizes exactly and once, and only sums come out.
    """

    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "set_id"])
        ids, n, part, copies = (pdf[c].to_numpy() for c in ("set_id", "n", "part", "copies"))
        h, _ = doc_sets(HashedWords(), list(pdf["text"]))
        number = np.unique(h, return_inverse=True)[1]
        end = np.cumsum(n)
        begin, linked, mine = end - n, np.zeros(len(ids), np.int64), np.zeros(len(h) + 1, bool)
        for i in range(len(ids) - 1):
            to = int(np.searchsorted(n, 5 * n[i] // 4, "right"))
            if to <= i + 1:
                continue
            own = number[begin[i] : end[i]]
            mine[own] = True
            both = np.add.reduceat(mine[number[end[i] : end[to - 1]]], begin[i + 1 : to] - end[i], dtype=np.int64)
            mine[own] = False
            mate = np.arange(i + 1, to)
            hit = 9 * both >= 4 * (n[i] + n[mate])
            if key[1] != key[2]:
                hit &= part[mate] != part[i]
            linked[i] += copies[mate[hit]].sum()
            linked[mate[hit]] += copies[i]
        return pd.DataFrame({"set_id": ids[linked > 0], "linked": linked[linked > 0]}).astype("int64")

    blocks = sets.groupBy("label").agg(F.ceil(F.sum("n") / LINK_BLOCK).cast("int").alias("blocks"))
    dealt = sets.join(blocks, "label").withColumn("part", F.pmod(F.xxhash64("set_id"), "blocks").cast("int")).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("b0", F.least("part", "_j")).withColumn("b1", F.greatest("part", "_j"))
    found = dealt.select("label", "b0", "b1", "set_id", "n", "part", "copies", "text").groupBy("label", "b0", "b1").applyInPandas(search, "set_id long, linked long")
    return found.groupBy("set_id").agg(F.sum("linked").alias("linked"))


def links(docs: DataFrame) -> DataFrame:
    """components with n_links: the number of other rows that each row is linked with, copies included."""
    members, labels, texts = join(docs)
    sets = members.filter("set_id is not null").groupBy("set_id").agg(F.first("n").alias("n"), F.count("*").alias("copies"))
    node = with_component(members, labels).join(sets.select("set_id", "copies"), "set_id", "left")
    if labels is not None:
        linked = materialize(link_sums(sets.join(labels, "set_id").join(texts, "set_id")), "linked")
        node = node.join(linked, "set_id", "left")
    else:
        node = node.withColumn("linked", F.lit(0))
    return node.withColumn("n_links", F.coalesce(F.col("copies") - 1, F.lit(0)) + F.coalesce("linked", F.lit(0))).drop("copies", "linked")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component (smallest doc_id, null last, then smallest key); rows without words stay."""
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    kept = components(docs).filter("label is not null").groupBy("label").agg(best.alias("r")).select(F.col("r.doc_id").alias("_id"), F.col("r.key").alias("_key"))
    rows = docs.filter(has_words).withColumn("_text_key", F.xxhash64("text"))
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(kept["_id"]) & (rows["_text_key"] == kept["_key"]), "left_semi")
    return rows.dropDuplicates(["doc_id", "_text_key"]).select(docs.columns).unionByName(docs.filter(~has_words))


def op5(spark, sf_dir: str) -> DataFrame:
    return links(read_table(spark, sf_dir, "documents")).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + least(5, len(ws)) - 1], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS i FROM d WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS v, doc_id AS w FROM d UNION SELECT r.v, l.b FROM r JOIN l ON l.a = r.w)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, coalesce(k.n_links, 0) AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM l GROUP BY a) k USING (doc_id) JOIN (SELECT v AS doc_id, min(w) AS component_id FROM r GROUP BY v) c USING (doc_id)
"""
