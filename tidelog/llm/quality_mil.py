"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of PASSAGE words. Every passage is encoded (character-class pairs
and word statistics through a dense layer), gated attention weighs the passages, and the weighted
representation is scored. Only document labels are used. The fit is on a bounded sample of
PER_CLASS labelled documents a class (of longer texts a stretch of MAX_CHARS characters there); scores cover
whole texts.

Defined results: a null or empty text is a bag of one empty passage and gets that bag's score.
Repeated rows get equal scores. Null labels are left out. Without labels of both kinds the score is
the share of label 1 (0.5 with none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import fold, labelled_texts, lean, read_table
from tidelog.llm.nets import Adam, sigmoid

PASSAGE = 64
PER_CLASS, MAX_CHARS = 1000, 40_000
HIDDEN, GATE = 16, 8
#: Bytes that are encoded side by side.
CHUNK = 1_000_000

CLASSES = 10


def byte_classes() -> np.ndarray:
    """Class of each byte: lower, upper, digit, blank, line end, full stop, comma, ! or ?, other ASCII mark, beyond ASCII."""
    out = np.full(256, 8, np.int64)
    out[97:123], out[65:91], out[48:58], out[128:] = 0, 1, 2, 9
    out[[9, 11, 12, 13, 32]], out[10], out[46], out[44], out[[33, 63]] = 3, 4, 5, 6, 7
    return out


SIZE = CLASSES * CLASSES + 4


def encode(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of all texts, and the first passage of each text; each text has one at least."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    words = [b.split() for b in raw]
    n_words = np.array([len(w) for w in words], np.int64)
    n_pass = np.maximum(1, -(-n_words // PASSAGE))
    first = np.r_[0, np.cumsum(n_pass)[:-1]]
    total = int(n_pass.sum())
    # a blank behind each text keeps words of neighbours apart
    flat = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    cls = byte_classes()[flat]
    blank = (cls == 3) | (cls == 4)
    starts = ~blank & np.r_[True, blank[:-1]]
    doc = np.repeat(np.arange(len(raw)), [len(b) + 1 for b in raw])
    before = np.r_[0, np.cumsum(n_words)[:-1]]
    word = np.maximum(0, np.cumsum(starts) - 1 - before[doc])
    place = first[doc] + np.minimum(word // PASSAGE, n_pass[doc] - 1)
    pair = cls * CLASSES + np.r_[cls[1:], 3]
    hist = np.bincount(place * (CLASSES * CLASSES) + pair, minlength=total * CLASSES * CLASSES).reshape(total, -1)
    size = np.maximum(1, hist.sum(1, keepdims=True))
    ids: dict[bytes, int] = {}
    get = ids.setdefault
    token = np.fromiter((get(w, len(ids)) for ws in words for w in ws), np.int64, int(n_words.sum()))
    owner = first.repeat(n_words) + (np.arange(len(token)) - before.repeat(n_words)) // PASSAGE
    held = np.bincount(owner, minlength=total)
    key = np.unique(owner * max(1, len(ids)) + token)
    distinct = np.bincount(key // max(1, len(ids)), minlength=total)
    long = np.bincount(owner, np.fromiter((len(w) > 12 for ws in words for w in ws), float, len(token)), total)
    most = np.maximum(1, held)
    extra = np.stack([distinct / most, long / most, np.minimum(10, size[:, 0] / most) / 10, np.log1p(held) / 5], 1)
    return np.concatenate([np.sqrt(hist / size), extra], 1).astype(np.float32), first


def encoded_chunks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """encode, about CHUNK characters at a time."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= CHUNK):
            size += len(texts[end] or "")
            end += 1
        yield encode(texts[at:end])
        at = end


def pool(p: dict, x: np.ndarray, first: np.ndarray):
    """Logit of each bag, and what the gradient needs."""
    h = np.tanh(x @ p["w"] + p["b"])
    t, g = np.tanh(h @ p["v"]), sigmoid(h @ p["u"])
    raw = (t * g) @ p["a"]
    bag = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(x)]))
    e = np.exp(raw - np.maximum.reduceat(raw, first)[bag])
    att = e / np.add.reduceat(e, first)[bag]
    z = np.add.reduceat(att[:, None] * h, first, axis=0)
    return z @ p["c"] + p["d"][0], (h, t, g, bag, att, z)


def fit_bags(x: np.ndarray, first: np.ndarray, y: np.ndarray, seed: int = 5, steps: int = 260) -> dict:
    """Gradient descent over all bags at once; both labels weigh alike."""
    rng = np.random.default_rng(seed)
    normal = lambda *s: rng.normal(0, s[0] ** -0.5, s).astype(np.float32)
    p = {"w": normal(x.shape[1], HIDDEN), "b": np.zeros(HIDDEN, np.float32), "v": normal(HIDDEN, GATE), "u": normal(HIDDEN, GATE), "a": normal(GATE), "c": normal(HIDDEN), "d": np.zeros(1, np.float32)}
    weight = (len(y) / 2 / np.maximum(1, np.bincount(y, minlength=2)))[y] / len(y)
    adam = Adam(p, 0.02)
    for step in range(steps):
        adam.rate = 0.02 * (1 - step / steps) + 0.001
        logit, (h, t, g, bag, att, z) = pool(p, x, first)
        dlogit = ((sigmoid(logit) - y) * weight).astype(np.float32)
        dz = dlogit[:, None] * p["c"]
        dh = att[:, None] * dz[bag]
        datt = (h * dz[bag]).sum(1)
        draw = att * (datt - np.add.reduceat(att * datt, first)[bag])
        dtg = draw[:, None] * p["a"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh += dt @ p["v"].T + dg @ p["u"].T
        dh *= 1 - h * h
        grads = {"w": x.T @ dh, "b": dh.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": (t * g).T @ draw, "c": z.T @ dlogit, "d": dlogit.sum(keepdims=True)}
        for k in grads:
            grads[k] = (grads[k] + 1e-4 * p[k]).astype(np.float32)
        adam.update(grads)
    return p


def train(docs: DataFrame, labels: DataFrame, rows: Column | None = None, label: str = "quality") -> dict:
    """Model from labels (doc_id, quality) of the given rows."""
    rows = F.lit(True) if rows is None else rows
    sample = labelled_texts(docs, labels, label, rows, PER_CLASS, MAX_CHARS)
    share = {r[0]: r[1] for r in labels.select("doc_id", label).dropna().filter(rows).groupBy(F.least(F.greatest(label, F.lit(0)), F.lit(1))).count().collect()}
    n0, n1 = share.get(0, 0), share.get(1, 0)
    y = np.array([min(1, max(0, v)) for _, v in sample], int)
    model = {"net": None, "score": n1 / (n0 + n1) if n0 + n1 else 0.5}
    if len(set(y)) == 2:
        parts = list(encoded_chunks([t for t, _ in sample]))
        ends = np.cumsum([0] + [len(x) for x, _ in parts])
        x, first = np.concatenate([x for x, _ in parts]), np.concatenate([f + e for (_, f), e in zip(parts, ends)])
        model["mean"], model["std"] = x.mean(0), x.std(0) + 0.02
        net = fit_bags((x - model["mean"]) / model["std"], first, y)
        net["d"] = net["d"] + np.float32(np.log(n1 / n0))  # labels weighed alike in the fit; here as they occur
        model["net"] = net
    return model


def scores(model: dict, texts: list[str | None]) -> np.ndarray:
    if model["net"] is None:
        return np.full(len(texts), float(model["score"]))
    out = [sigmoid(pool(model["net"], (x - model["mean"]) / model["std"], first)[0].astype(float)) for x, first in encoded_chunks(texts)]
    return np.concatenate(out) if out else np.zeros(0)


def quality(model: dict, text: str | Column = "text") -> Column:
    """Score of a text column, 0 to 1."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return lean(scored)(batches)

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(scores(model, [t if isinstance(t, str) else None for t in s]))

    return score(text)


def op2(spark, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = train(docs, labels, fold("doc_id", 4) != 2)
    out = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), quality(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
