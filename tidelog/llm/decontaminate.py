"""Benchmark decontamination with a distributed positional inverted index.

Index (a Parquet table in the shared folder): documents are dealt into blocks of about BLOCK words;
a row (block, term, n, postings) holds the positions of a term in its block (differences, unsigned
32 bit), a row without a term lists the block's documents. Positions run through the block with one
place free between documents, so a phrase never crosses them.

Search: the index is reduced to the terms of the test items (a join), grouped by block, and each
window of test words starts from its rarest term in that block: its positions, moved by its offset,
are intersected with those of the next rarest term, and so on. With slop 0 the matches are exact
phrases; with slop k each further term may stand up to k words from its place (proximity).

What the tasks get of the items is bounded by ITEM_WORDS; more items are searched in several passes.

Defined results: null or empty text has no words, no hit. Items without words have no window; items
of fewer than WINDOW words are one window. Repeated items count once by item_id, a null item_id is
the empty one. Repeated rows of documents are judged row by row. An empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidelog.llm.common import lean, new_path, read_table, write_table
from tidelog.llm.text import ALNUM, raw, rows

WINDOW = 10
BLOCK = 1_000_000
ITEM_WORDS = 1_000_000


def words_of(text: str | bytes | None) -> list[bytes]:
    return raw(text).translate(ALNUM).split()


def build_index(docs: DataFrame) -> str:
    """Write the positional index of docs (doc_id, text); returns its path."""
    path = new_path(docs.sparkSession, "index")
    id_type = docs.schema["doc_id"].dataType
    doc_type = pa.list_(pa.struct([("doc_id", to_arrow_type(id_type)), ("key", pa.int64()), ("n_words", pa.int64())]))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names = ["block", "term", "n", "postings", "docs"]
        block = TaskContext.get().partitionId() << 32

        def out(held: list[tuple], words: list[list[bytes]]) -> pa.RecordBatch:
            size = np.array([len(w) for w in words], np.int64)
            number: dict[bytes, int] = {}
            get = number.setdefault
            term = np.fromiter((get(w, len(number)) for ws in words for w in ws), np.int64, int(size.sum()))
            place = np.arange(len(term)) + np.repeat(np.arange(len(words)), size)
            order = np.argsort(term, kind="stable")
            n = np.bincount(term, minlength=len(number))
            at = place[order].astype(np.uint32)
            first = np.cumsum(n) - n
            gap = np.diff(at, prepend=np.uint32(0))
            gap[first] = at[first]
            ends = np.r_[0, np.cumsum(n) * 4].astype(np.int32)
            lists = pa.Array.from_buffers(pa.binary(), len(number), [None, pa.py_buffer(ends), pa.py_buffer(gap.astype("<u4"))])
            k = len(number)
            listed = [{"doc_id": d, "key": h, "n_words": int(m)} for (d, h), m in zip(held, size)]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(k + 1, block)), pa.array([*number, None], pa.binary()), pa.array(np.r_[n, len(words)].astype(np.int64)), pa.concat_arrays([lists, pa.nulls(1, pa.binary())]), pa.concat_arrays([pa.nulls(k, doc_type), pa.array([listed], doc_type)])],
                names,
            )

        held, words, total = [], [], 0
        for doc_id, key, text in rows(batches, "doc_id", "key", "text"):
            w = words_of(text)
            held.append((doc_id, key))
            words.append(w)
            total += len(w) + 1
            if total >= BLOCK:
                yield out(held, words)
                held, words, total, block = [], [], 0, block + 1
        if held:
            yield out(held, words)

    schema = f"block long, term binary, n long, postings binary, docs array<struct<doc_id:{id_type.simpleString()},key:long,n_words:long>>"
    cols = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    write_table(cols.mapInArrow(lean(index), schema), path)
    return path


def item_windows(items: list[tuple[str, list[bytes]]], window: int) -> tuple[list[bytes], dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Terms, and for each window length the windows (rows of term numbers) with the item of each."""
    number: dict[bytes, int] = {}
    by_size: dict[int, list] = {}
    for i, (_, words) in enumerate(items):
        ids = [number.setdefault(w, len(number)) for w in words]
        n = min(window, len(ids))
        if n:
            by_size.setdefault(n, []).extend((ids[k : k + n], i) for k in range(len(ids) - n + 1))
    return list(number), {n: (np.array([w for w, _ in v]), np.array([i for _, i in v])) for n, v in by_size.items()}


def near(sorted_places: np.ndarray, want: np.ndarray, slop: int) -> np.ndarray:
    """Which wanted places have a posting at most slop away."""
    at = np.searchsorted(sorted_places, want - slop)
    return (at < len(sorted_places)) & (sorted_places[np.minimum(at, len(sorted_places) - 1)] <= want + slop)


def phrase_starts(lists: list[np.ndarray], slop: int) -> np.ndarray:
    """Starts of the phrase whose k-th word has the positions lists[k], from the rarest word on."""
    rarest = sorted(range(len(lists)), key=lambda k: len(lists[k]))
    starts = lists[rarest[0]] - rarest[0]
    for k in rarest[1:]:
        if not len(starts):
            break
        starts = starts[near(lists[k], starts + k, slop)]
    return starts


def matcher(names: list[str], terms: list[bytes], windows: dict[int, tuple[np.ndarray, np.ndarray]], slop: int):
    """The search of one block's postings for all windows."""

    def intersect(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        place: list[np.ndarray | None] = [None] * len(terms)
        have = np.zeros(len(terms), bool)
        sizes = None
        for number, postings, size in zip(pdf["number"], pdf["postings"], pdf["sizes"]):
            if size is not None:
                sizes = np.asarray(size, np.int64)
            else:
                have[int(number)] = True
                place[int(number)] = np.cumsum(np.frombuffer(postings, "<u4").astype(np.int64))
        begin = np.cumsum(sizes + 1) - sizes - 1
        hits = []
        for n, (rows_of_terms, item) in windows.items():
            for w in np.flatnonzero(have[rows_of_terms].all(1)):
                starts = phrase_starts([place[t] for t in rows_of_terms[w]], slop)
                if len(starts):
                    hits.append(np.stack([starts, np.full(len(starts), n), np.full(len(starts), item[w])]))
        if not hits:
            return pd.DataFrame({c: pd.Series([], dtype=t) for c, t in (("block", "int64"), ("doc_no", "int32"), ("item_id", object), ("spans", object))})
        start, n, item = np.concatenate(hits, 1)
        doc = np.searchsorted(begin, start, "right") - 1
        start = start - begin[doc]
        inside = (start >= 0) & (start + n <= sizes[doc])  # a near match may reach over its document
        out: dict[tuple[int, str], list] = {}
        for d, i, s, e in sorted(zip(doc[inside], item[inside], start[inside], (start + n)[inside])):
            spans = out.setdefault((int(d), names[i]), [])
            if spans and s <= spans[-1][1]:
                spans[-1][1] = max(int(e), spans[-1][1])
            else:
                spans.append([int(s), int(e)])
        return pd.DataFrame({"block": key[0], "doc_no": [d for d, _ in out], "item_id": [i for _, i in out], "spans": [[{"s": s, "e": e} for s, e in v] for v in out.values()]})

    return intersect


def search(index: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """block, doc_no, item_id, spans (word ranges [s, e) of the document, joined where they meet)."""
    spark = index.sparkSession
    texts = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").filter(F.col("text").isNotNull())
    words = texts.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0  # a word has a letter and a gap
    passes = int(words // ITEM_WORDS) + 1
    found = None
    for k in range(passes):
        part = texts.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k) if passes > 1 else texts
        listed = [(r.item_id, words_of(r.text)) for r in part.orderBy("item_id", "text").collect()]  # ITEM_WORDS at most
        names = [i for i, _ in listed]
        terms, windows = item_windows(listed, window)
        wanted = spark.createDataFrame([(bytearray(t), i) for i, t in enumerate(terms)], "term binary, number long")

        postings = index.filter(F.col("term").isNotNull()).join(F.broadcast(wanted), "term").select("block", "number", "postings", F.lit(None).cast("array<long>").alias("sizes"))
        sizes = index.filter(F.col("term").isNull()).select("block", F.lit(-1).cast("long").alias("number"), F.lit(None).cast("binary").alias("postings"), F.col("docs.n_words").alias("sizes"))
        one = postings.unionByName(sizes).groupBy("block").applyInPandas(matcher(names, terms, windows, slop), "block long, doc_no int, item_id string, spans array<struct<s:int,e:int>>")
        found = one if found is None else found.unionByName(one)
    return found


def covered(spans: Column) -> Column:
    """Words under spans (array of struct(s, e)), counted once."""
    step = lambda acc, x: F.struct(
        F.greatest(acc["upto"], x["e"]).alias("upto"),
        (acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(acc["upto"], x["s"]))).cast("long").alias("n"),
    )
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["n"])


def judge(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """doc_id, key (xxhash64 of the text), n_words, n_hit, item_ids of every row of docs."""
    index = docs.sparkSession.read.parquet(build_index(docs))
    hits = search(index, items, window, slop).groupBy("block", "doc_no").agg(
        covered(F.flatten(F.collect_list("spans"))).alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("item_ids")
    )
    listed = index.filter(F.col("term").isNull()).select("block", F.posexplode("docs").alias("doc_no", "d"))
    empty = F.array().cast("array<string>")
    return listed.join(hits, ["block", "doc_no"], "left").select(
        "d.doc_id", "d.key", "d.n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", empty).alias("item_ids")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that hold a window of an item."""
    hit = judge(docs, items).filter(F.col("n_hit") > 0).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()
    rows = docs.withColumn("_text_key", F.xxhash64("text"))
    return rows.join(hit, rows["doc_id"].eqNullSafe(hit["_id"]) & (rows["_text_key"] == hit["_key"]), "left_anti").select(docs.columns)


def op6(spark, sf_dir: str) -> DataFrame:
    out = judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH tr AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents, tr),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark, tr),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS w
  FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)
),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, ns WHERE len(ws) >= n)
),
hit AS (SELECT doc_id, n, i, item_id FROM dw JOIN bw USING (n, w)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
