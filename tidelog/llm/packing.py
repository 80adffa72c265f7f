"""Best-fit packing of documents into sequences of CAPACITY tokens.

Longer documents are cut into full pieces; only the last may be shorter. The plan is made once for
the whole corpus, on the number of pieces of each length (CAPACITY numbers, whatever the corpus):

* lengths above a third of the capacity go two to a sequence at most, by greedy matching: the
  longest first, with the longest partner that still fits;
* shorter pieces, longest first, go to the fullest sequence with room for them (best fit), and to
  new sequences where there is none.

The plan is a list of runs: pieces of one length and a range of ranks go to consecutive sequences at
one offset. Ranks of equal lengths are counted in each task and shifted by the counts of the tasks
before, so no length, however frequent, is gathered in one task.

Defined results: a null or empty text is one piece with the end id only. Repeated rows are packed as
they come. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidelog.llm.common import materialize, read_table
from tidelog.llm.encode import encoder as kept_encoder
from tidelog.llm.encode import vocabulary
from tidelog.llm.text import rows

CAPACITY = 2048
TEXTS = 512


def cut_pieces(docs: DataFrame, vocabulary_path: str, kind: str = "word", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), with the task and the rank in it among its pieces of that length."""
    id_type = docs.schema["doc_id"].dataType
    arrow_id = to_arrow_type(id_type)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, task = kept_encoder(vocabulary_path, kind), TaskContext.get().partitionId()
        seen = np.zeros(CAPACITY + 1, np.int64)

        def out(held: list[tuple]) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in range(8)]
            for (doc_id, _), b in zip(held, encoder.encode([t for _, t in held])):
                for piece, at in enumerate(range(0, len(b), 4 * CAPACITY)):
                    part = b[at : at + 4 * CAPACITY]
                    n = len(part) // 4
                    for c, v in zip(cols, (doc_id, piece, at // 4, n, zlib.crc32(part), task, int(seen[n]), part if with_ids else None)):
                        c.append(v)
                    seen[n] += 1
            types = [arrow_id, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank", "ids"])

        held: list[tuple] = []
        for row in rows(batches, "doc_id", "text"):
            held.append(row)
            if len(held) == TEXTS:
                yield out(held)
                held = []
        yield out(held)

    schema = f"doc_id {id_type.simpleString()}, piece int, start long, length long, ids_crc32 long, task int, rank long, ids binary"
    made = docs.select("doc_id", "text").mapInArrow(cut, schema)
    return made if with_ids else made.drop("ids")


class Gaps:
    """Groups of sequences by the room left in them: gap to a list of (first sequence, how many)."""

    def __init__(self) -> None:
        self.groups: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.sizes: list[int] = []

    def add(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            if not self.groups[gap]:
                insort(self.sizes, gap)
            self.groups[gap].append((first, count))

    def take(self, length: int, most: int) -> tuple[int, int, int] | None:
        """The tightest group with room for length: gap, first sequence, how many of most it takes."""
        at = bisect_left(self.sizes, length)
        if at == len(self.sizes):
            return None
        gap = self.sizes[at]
        first, count = self.groups[gap].pop()
        if count > most:
            self.groups[gap].append((first + most, count - most))
        elif not self.groups[gap]:
            self.sizes.pop(at)
        return gap, first, min(count, most)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, how many, first sequence, offset) for the number of pieces of each length."""
    left = dict(counts)
    runs: list[tuple[int, int, int, int, int]] = []
    used: dict[int, int] = defaultdict(int)
    gaps, bins = Gaps(), 0

    def place(length: int, count: int, first: int, offset: int) -> None:
        runs.append((length, used[length], count, first, offset))
        used[length] += count
        left[length] -= count

    large = sorted((n for n in counts if 3 * n > capacity), reverse=True)
    for length in large:
        while left[length]:
            partners = [p for p in large if p <= min(length, capacity - length) and left[p] - (p == length) > 0]
            partner = partners[0] if partners else None
            if partner is None:
                pairs, gap = left[length], capacity - length
            else:
                pairs = left[length] // 2 if partner == length else min(left[length], left[partner])
                gap = capacity - length - partner
            place(length, pairs, bins, 0)
            if partner is not None:
                place(partner, pairs, bins, length)
            gaps.add(gap, bins, pairs)
            bins += pairs
    for length in sorted((n for n in counts if 3 * n <= capacity), reverse=True):
        while left[length]:
            if (got := gaps.take(length, left[length])) is None:
                fresh = max(1, left[length] // (capacity // length))
                gaps.add(capacity, bins, fresh)
                bins += fresh
                continue
            gap, first, count = got
            place(length, count, first, capacity - gap)
            gaps.add(gap - length, first, count)
    return runs


def pack(docs: DataFrame, vocabulary_path: str, kind: str = "word", with_ids: bool = False) -> DataFrame:
    """One row a piece with its sequence_id and its offset there."""
    pieces = materialize(cut_pieces(docs, vocabulary_path, kind, with_ids), "pieces")
    by_task = pieces.groupBy("length", "task").count()
    runs = sorted(plan(dict(by_task.groupBy("length").agg(F.sum("count")).collect())))
    width = np.int64(1 << 40)
    key = np.array([r[0] * width + r[1] for r in runs], np.int64)
    first, sequence, offset = (np.array([r[i] for r in runs], np.int64) for i in (1, 3, 4))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(key, length.to_numpy() * width + rank.to_numpy(), "right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + rank.to_numpy() - first[at], "offset": offset[at]})

    upto = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.withColumn("before", F.coalesce(F.sum("count").over(upto), F.lit(0))).drop("count")
    ranked = pieces.join(before, ["length", "task"]).withColumn("at", placed("length", F.col("before") + F.col("rank")))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", *(["ids"] if with_ids else []))


def op8(spark, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
