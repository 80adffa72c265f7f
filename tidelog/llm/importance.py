r"""Importance resampling towards a target: hashed n-gram features, weights scored by an array, ranks by parallel sorting.

Features are all runs of 1 to `ngrams` words (repeats count), each in one of `buckets` buckets. Each task
counts the buckets of its texts in an array, and a sum by bucket gives the counts of the corpus and of the
target. A bucket's gain is floor(1000 * ln of the ratio of its smoothed shares), so a document is scored by
adding up the gains that its features point to in one array of `buckets` numbers: its weight is the floored mean.
A hash of the id adds Gumbel noise, and the documents of the highest sums are a sample without replacement.

Ranks come from parallel sorting by regular sampling:

1. each task sorts its rows and writes them as a run, each row with its place in the run;
2. rows at regular places of the runs (at most SAMPLES of the whole table and one a run) give regular splitters;
3. rows are exchanged by the segment between splitters that they fall in, and sorted (merged) there;
4. counts of the segments before, plus the place in the segment, are exact ranks.

The sort key ends in run and place, which no two rows share, so splitters also cut through equal rows, however
many. Segments are counted before the exchange; rows of segments that begin past the last rank asked for are not
exchanged, and have a null rank.

Defined results: null or empty texts have no features and weight 0. Ties in score go to the smaller id, a null id
first; rows alike in both by weight and number of features, and equal rows in any order. A null id is the empty
text where it is hashed. An empty target or corpus has counts of 0. An empty table gives no rows. Other columns
of the input are neither read nor returned, whatever their names. Ids are integers.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import materialize, read_table
from tidelog.llm.text import ALNUM, raw, rows

#: Sampled rows from which the driver takes splitters, beyond one a run; rows of a segment that splitters aim at.
SAMPLES = 65_536
SEGMENT_ROWS = 200_000
#: Words whose buckets a task remembers.
REMEMBERED = 400_000
#: Runs are split in stretches of so many words while their n-grams are counted.
STRETCH = 1 << 16


class Buckets(dict):
    """Buckets of features by their bytes, remembered up to a bound."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        at = self[feature] = zlib.crc32(feature) % self.buckets
        return at

    def of(self, words: list[bytes], ngrams: int) -> Iterator[np.ndarray]:
        """The buckets of the features of a text's words, in stretches."""
        for n in range(1, ngrams + 1):
            for at in range(0, len(words) - n + 1, STRETCH):
                part = words[at : at + STRETCH + n - 1]
                features = part if n == 1 else [b" ".join(part[k : k + n]) for k in range(len(part) - n + 1)]
                yield np.fromiter(map(self.__getitem__, features), np.int64, len(features))


def words_of(text: str | None) -> list[bytes]:
    return raw(text).translate(ALNUM).split()


def bucket_counts(texts: DataFrame, ngrams: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket: an array from each task, summed by bucket. buckets numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = Buckets(buckets), np.zeros(buckets, np.int64)
        for (text,) in rows(batches, "text"):
            for at in known.of(words_of(text), ngrams):
                seen += np.bincount(at, minlength=buckets)
        there = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(seen[there], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(target share / corpus share)) of each bucket, with one count more in every bucket."""
    b, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1) * (s + b) / ((x + 1) * (t + b)))) for x, y in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 * Gumbel noise) from the first 8 hex digits of sha256 of seed:id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def score(docs: DataFrame, gain: np.ndarray, ngrams: int, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(len(gain))
        for batch in batches:
            cols: list[list[int]] = [[], [], []]
            for (text,) in rows([batch], "text"):
                n, total, words = 0, 0, words_of(text)
                for at in known.of(words, ngrams):
                    n, total = n + len(at), total + int(gain[at].sum())
                for c, v in zip(cols, (len(words), n, total // n if n else 0)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "n_words", "n_features", "weight"])

    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    return made.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


#: What a run is sorted by: columns of no nulls, ascending.
KEY = ["_down", "_known", "_id", "_weight", "_features", "_run", "_place"]
KEYS = ", ".join(f"{c} long" for c in KEY)


def runs(scored: DataFrame, ranked: Column) -> DataFrame:
    """The rows with their sort key, sorted in each task and written: run is the task, place the row's rank in it. Only rows that are ranked have a place."""
    key = {"_ranked": ranked, "_down": -F.col("score"), "_known": F.col("doc_id").isNotNull().cast("long"), "_id": F.coalesce("doc_id", F.lit(0)), "_weight": F.col("weight"), "_features": F.col("n_features")}
    keyed = scored.withColumns(key).withColumn("_run", F.spark_partition_id().cast("long"))
    in_order = keyed.sortWithinPartitions(F.desc("_ranked"), *KEY[:5])
    columns = in_order.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(at, at + batch.num_rows), pa.int64())], [*columns, "_place"])
            at += batch.num_rows

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in in_order.schema)
    return materialize(in_order.mapInArrow(place, f"{kinds}, _place long"), "runs")


def splitters(run: DataFrame, n: int) -> np.ndarray:
    """Keys that cut n rows into segments of about SEGMENT_ROWS: taken at regular places of the sorted sample of regular places of all runs."""
    step = max(1, -(-n // SAMPLES))
    sample = run.filter(F.col("_ranked") & (F.col("_place") % step == 0)).select(KEY).toPandas().to_numpy(np.int64).reshape(-1, len(KEY))
    sample = sample[np.lexsort(sample.T[::-1])]
    segments = max(1, -(-n // SEGMENT_ROWS))
    cuts = np.unique(np.arange(1, segments) * len(sample) // segments)
    return sample[cuts[cuts > 0]]


def segment_of(keys: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many cuts are at or before each key: all are sorted together, the cuts before equal keys."""
    both = np.concatenate([cuts, keys])
    order = np.lexsort((np.r_[np.zeros(len(cuts)), np.ones(len(keys))], *both.T[::-1]))
    passed = np.cumsum(order < len(cuts))
    out = np.empty(len(both), np.int64)
    out[order] = passed
    return out[len(cuts) :]


def with_segment(run: DataFrame, cuts: np.ndarray) -> DataFrame:
    columns = run.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([batch.column(columns.index(c)).to_numpy(zero_copy_only=False) for c in KEY], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment_of(keys, cuts), pa.int32())], [*columns, "_segment"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in run.schema)
    return run.mapInArrow(cut, f"{kinds}, _segment int")


def with_rank(scored: DataFrame, ranked: Column, percent: int) -> DataFrame:
    """The rows with rank: 1, 2, 3... of the highest scores among the rows that are ranked, percent of 100 of them; null for all others."""
    run = runs(scored, ranked)
    n = run.filter("_ranked").count()
    drawn = percent * n // 100
    dealt = with_segment(run, splitters(run, n))
    sizes = dict(dealt.filter("_ranked").groupBy("_segment").count().collect())  # a row a segment
    before, total = {}, 0
    for s in sorted(sizes):
        before[s], total = total, total + sizes[s]
    last = sum(at < drawn for at in before.values())  # segments with a rank to give
    columns = [*scored.columns, "rank"]
    rest = dealt.filter(~F.col("_ranked") | (F.col("_segment") >= last)).withColumn("rank", F.lit(None).cast("long")).select(columns)
    merged = dealt.filter(F.col("_ranked") & (F.col("_segment") < last)).repartitionById(max(1, last), "_segment").sortWithinPartitions(KEY)
    names = merged.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            if at is None and batch.num_rows:
                at = before[batch.column(names.index("_segment"))[0].as_py()]
            rank = np.arange(at or 0, (at or 0) + batch.num_rows) + 1
            at = (at or 0) + batch.num_rows
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in columns[:-1]), pa.array(rank, pa.int64(), mask=rank > drawn)], columns)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scored.schema)
    return merged.mapInArrow(number, f"{kinds}, rank long").unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, ngrams: int, buckets: int, seed: int, percent: int, min_words: int) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every document, and the rank of those drawn: percent of 100 of the documents of min_words words."""
    gain = gains(bucket_counts(docs, ngrams, buckets), bucket_counts(target, ngrams, buckets))
    return with_rank(score(docs, gain, ngrams, seed), F.col("n_words") >= min_words, percent)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, weighed towards the texts of the benchmark; a tenth of those of 20 words is drawn."""
    found = resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), 1, 10_000, 2024, 10, 20)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


SQL = r"""
WITH tr AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents, tr),
dw AS (SELECT r, unnest(ws) AS w FROM d),
bw AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark, tr),
tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
bytes AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
vals AS (SELECT w, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS bs FROM bytes),
word AS (SELECT w, xor(list_reduce(bs, lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8), 4294967295::BIGINT), 4294967295) % 10000 AS b FROM vals, tab),
dn AS (SELECT b, count(*) AS s FROM dw JOIN word USING (w) GROUP BY b),
bn AS (SELECT b, count(*) AS t FROM bw JOIN word USING (w) GROUP BY b),
tot AS (SELECT (SELECT count(*) FROM dw) AS ss, (SELECT count(*) FROM bw) AS tt),
gain AS (
  SELECT b, floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (ss + 10000) AS DOUBLE) / CAST((s + 1) * (tt + 10000) AS DOUBLE)))::BIGINT AS g FROM dn LEFT JOIN bn USING (b), tot
),
wt AS (SELECT r, floor(sum(g) / count(*))::BIGINT AS weight FROM dw JOIN word USING (w) JOIN gain USING (b) GROUP BY r),
sc AS (
  SELECT r, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN wt USING (r)
),
rk AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM sc WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= n * 10 // 100 THEN k END AS rank FROM sc LEFT JOIN rk USING (r)
"""
