"""Importance resampling against a plain version; ranks against a plain sort."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.data import no_docs, odd_docs, prose
from tidelog.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def features(text, ngrams):
    ws = WORD.findall((text or "").translate(LOWER))
    return len(ws), [" ".join(ws[k : k + n]) for n in range(1, ngrams + 1) for k in range(len(ws) - n + 1)]


def plain(docs, target, ngrams, buckets, seed, percent, min_words):
    at = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(at(f) for _, text in rows for f in features(text, ngrams)[1]) for rows in (docs, target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for doc_id, text in docs:
        n_words, fs = features(text, ngrams)
        weight = sum(gain[at(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, n_words, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    return out, order[: percent * len(order) // 100]


@pytest.mark.parametrize("ngrams, stretch", [(1, 1 << 16), (3, 1 << 16), (2, 3)])
def test_against_a_plain_version(spark, monkeypatch, ngrams, stretch):
    monkeypatch.setattr(importance, "STRETCH", stretch)
    monkeypatch.setattr(importance, "SEGMENT_ROWS", 7)
    monkeypatch.setattr(importance, "REMEMBERED", 50)
    r = random.Random(ngrams)
    docs = [(k, prose(k % 40, r.choice([0, 1, 3, 40]), "abé") + r.choice(["", " 9-X", " 日本"])) for k in range(150)] + [(None, "a b c"), (3, None), (3, "")]
    target = [(k, prose(k, 30, "ab")) for k in range(20)] + [(None, None)]
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [tuple(x) for x in importance.resample(make(docs), make(target), ngrams, 97, 5, 30, 3).collect()]
    want, order = plain(docs, target, ngrams, 97, 5, 30, 3)
    assert sorted((x[:5] for x in got), key=repr) == sorted(want, key=repr)
    assert [x[:5] for x in sorted((x for x in got if x[5]), key=lambda x: x[5])] == order


def test_odd_rows(spark):
    found = importance.resample(odd_docs(spark), no_docs(spark), 1, 100, 1, 50, 1)
    want, order = plain([(r.doc_id, r.text) for r in odd_docs(spark).collect()], [], 1, 100, 1, 50, 1)
    assert found.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    got = [tuple(r) for r in found.collect()]
    assert sorted((r[:5] for r in got), key=repr) == sorted(want, key=repr)
    assert sorted(r[5] for r in got if r[5]) == list(range(1, len(order) + 1))
    assert importance.resample(no_docs(spark), odd_docs(spark), 1, 100, 1, 50, 1).count() == 0


@pytest.mark.parametrize("percent", [0, 10, 100])
def test_ranks_where_a_third_of_all_rows_are_equal(spark, monkeypatch, percent):
    monkeypatch.setattr(importance, "SEGMENT_ROWS", 100)
    monkeypatch.setattr(importance, "SAMPLES", 2_000)
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.lit(9).cast("long").alias("weight"), F.lit(1).cast("long").alias("n_features"), F.when(F.col("id") % 3 == 0, 50).otherwise(F.col("id") % 101).alias("score")).repartition(7)
    out = importance.with_rank(rows, F.lit(True), percent).orderBy("rank").collect()
    drawn = [r for r in out if r["rank"] is not None]
    assert [r["rank"] for r in drawn] == list(range(1, 60 * percent + 1)) and len(out) == 6000
    assert [(r.score, r.doc_id) for r in drawn] == sorted(((r.score, r.doc_id) for r in out), key=lambda x: (-x[0], x[1]))[: 60 * percent]
    cuts = importance.splitters(run := importance.runs(rows, F.lit(True)), 6000)
    sizes = [r["count"] for r in importance.with_segment(run, cuts).groupBy("_segment").count().collect()]
    assert len(sizes) == 60 and max(sizes) < 200  # equal rows are cut too


def test_segments():
    r = np.random.default_rng(1)
    keys, cuts = r.integers(0, 4, (300, 7)), r.integers(0, 4, (9, 7))
    cuts = cuts[np.lexsort(cuts.T[::-1])]
    assert importance.segment_of(keys, cuts).tolist() == [sum(tuple(c) <= tuple(k) for c in cuts) for k in keys]
