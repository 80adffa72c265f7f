"""Language identification: a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded sample of labelled
documents, labels every byte position, and a document's probabilities are the mean over all its
positions. Texts are cut into segments of SEGMENT bytes only to run many of them side by side;
every byte of every text is labelled.

Defined results: null text or a text without any letter gives `und` with score 0. Repeated rows get
equal results. Rows with a null language or text are not learned from. With no row to learn from,
or a single language, every text with a letter gets that one language (or `und`, score 0).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import class_sample, fold, lean
from tidelog.llm.nets import KEEP, Adam, gru_backward, gru_forward, softmax

SEGMENT = 64
HIDDEN = 8
#: Bound of the training sample: documents a language, and segments a document.
DOCS_PER_LANG, SEGMENTS_PER_DOC = 240, 6
#: The share of right predictions that a bound for clear predictions keeps, and the steps of a score that it is found by.
CLEAR_SHARE, GRID = 0.999, 1 << 16
#: Fewer right predictions than these tell no bound.
CLEAR_LEAST = 30
#: Segments that run side by side.
LANES = 2048
RESULT = "lang_pred string, score double"


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def segments(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of all texts as rows of SEGMENT bytes, 0 behind a text's end; the text of each row."""
    raw = [t.encode("utf-8", "replace").replace(b"\0", b" ") for t in texts]
    rows = [-(-len(b) // SEGMENT) for b in raw]
    padded = b"".join(b.ljust(n * SEGMENT, b"\0") for b, n in zip(raw, rows))
    return np.frombuffer(padded, np.uint8).reshape(-1, SEGMENT), np.repeat(np.arange(len(raw)), rows)


def labelled_rows(docs: DataFrame, rows: Column, per_lang: int) -> DataFrame:
    """lang, text of at most per_lang documents of each language, one row each: of rows that repeat a doc_id and language that with the text of the lowest hash."""
    known = docs.select("doc_id", "text", "lang").filter(rows & F.col("lang").isNotNull() & (F.length("text") > 0))
    picked = F.broadcast(class_sample(known.select("doc_id", "lang").distinct(), "lang", per_lang).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")))
    same = known.join(picked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")))
    return same.groupBy("doc_id", "lang").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("r")).select("lang", "r.text")


def sample_segments(docs: DataFrame, train: Column) -> pd.DataFrame:
    """The bounded training sample: (lang, seg), SEGMENTS_PER_DOC segments spread over each document picked."""
    picked = labelled_rows(docs, train, DOCS_PER_LANG)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lang, seg = [], []
            for text, one in zip(pdf["text"], pdf["lang"]):
                x, _ = segments([text])
                at = np.unique(np.linspace(0, len(x) - 1, SEGMENTS_PER_DOC).round().astype(int))
                seg += [x[i].tobytes() for i in at]
                lang += [one] * len(at)
            yield pd.DataFrame({"lang": lang, "seg": seg})

    got = picked.select("lang", "text").mapInPandas(cut, "lang string, seg binary").toPandas()  # DOCS_PER_LANG * SEGMENTS_PER_DOC a language
    return got.sort_values(["lang", "seg"], ignore_index=True)


def fit_segments(x: np.ndarray, y: np.ndarray, classes: int, seed: int = 7, epochs: int = 14, batch: int = 128) -> dict[str, np.ndarray]:
    """Train on segments x (N, SEGMENT) with class y; cross-entropy at every position, classes weighted alike."""
    rng = np.random.default_rng(seed)
    p = {
        "table": rng.normal(0, 0.3, (2, 256, 3 * HIDDEN)).astype(np.float32),
        "u": rng.normal(0, HIDDEN**-0.5, (2, HIDDEN, 3 * HIDDEN)).astype(np.float32),
        "v": rng.normal(0, 0.3, (2 * HIDDEN, classes)).astype(np.float32),
        "c": np.zeros(classes, np.float32),
    }
    p["table"][:, 0] = 0
    p["table"][:, 0, :HIDDEN] = KEEP
    share = len(y) / (classes * np.maximum(1, np.bincount(y, minlength=classes)))
    adam = Adam(p, 0.02)
    for epoch in range(epochs):
        adam.rate = 0.02 * (1 - epoch / epochs) + 0.001
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = order[at : at + batch]
            idx = x[rows].astype(np.intp)
            out, saved = gru_forward(p["table"], p["u"], idx, keep=True)
            both = np.concatenate([out[0], out[1]], 2)
            d = softmax(both @ p["v"] + p["c"])
            real = (idx.T > 0).astype(np.float32)
            d[:, np.arange(len(rows)), y[rows]] -= 1
            d *= (real * share[y[rows]].astype(np.float32) / max(1.0, float(real.sum())))[:, :, None]
            dboth = d @ p["v"].T
            dtable, du = gru_backward(p["table"], p["u"], idx, saved, np.stack([dboth[:, :, :HIDDEN], dboth[:, :, HIDDEN:]]))
            flat = d.reshape(-1, classes)
            adam.update({"table": dtable, "u": du, "v": both.reshape(-1, 2 * HIDDEN).T @ flat, "c": flat.sum(0)})
    return p


def train(docs: DataFrame, rows: Column | None = None) -> dict:
    """Model from docs (doc_id, text, lang); rows: which to learn from, all where None."""
    sample = sample_segments(docs, F.lit(True) if rows is None else rows)
    langs = sorted(sample["lang"].unique())
    model = {"langs": langs, "net": None}
    if len(langs) > 1:
        x = np.stack([np.frombuffer(s, np.uint8) for s in sample["seg"]])
        model["net"] = fit_segments(x, sample["lang"].map({k: i for i, k in enumerate(langs)}).to_numpy(), len(langs))
    return model


def position_probabilities(net: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Language probabilities of every position of the segments x: (rows, SEGMENT, languages)."""
    out = gru_forward(net["table"], net["u"], x.astype(np.intp))
    logits = out[0] @ net["v"][:HIDDEN]
    logits += out[1] @ net["v"][HIDDEN:]
    logits += net["c"]
    np.clip(logits, -60, 60, out=logits)
    e = np.exp(logits, out=logits).reshape(-1, logits.shape[2])
    e /= e @ np.ones((e.shape[1], 1), np.float32)
    return e.reshape(logits.shape).transpose(1, 0, 2)


def predict(model: dict, texts: list[str | None]) -> list[tuple[str, float]]:
    langs, net = model["langs"], model["net"]
    out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    todo = [i for i, t in enumerate(texts) if t is not None and has_letter(t)] if langs else []
    if net is None:
        for i in todo:
            out[i] = (langs[0], 1.0)
        return out
    at = 0
    while at < len(todo):
        end, size = at, 0
        while end < len(todo) and (end == at or size + len(texts[todo[end]]) <= SEGMENT * LANES):
            size += len(texts[todo[end]])
            end += 1
        x, owner = segments([texts[i] for i in todo[at:end]])
        total = np.zeros((end - at, len(langs)))
        for k in range(0, len(x), LANES):
            part = x[k : k + LANES]
            probs = position_probabilities(net, part)
            probs[part == 0] = 0
            np.add.at(total, owner[k : k + LANES], probs.sum(1))
        total /= total.sum(1, keepdims=True)
        best = total.argmax(1)
        for j, i in enumerate(todo[at:end]):
            out[i] = (langs[best[j]], min(1.0, float(total[j, best[j]])))
        at = end
    return out


def language(model: dict, text: str | Column = "text") -> Column:
    """struct(lang_pred, score) of a text column."""

    @F.pandas_udf(RESULT)
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return lean(tagged)(batches)

    def tagged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame(predict(model, [t if isinstance(t, str) else None for t in s]), columns=["lang_pred", "score"])

    return tag(text)


def clear_bound(model: dict, docs: DataFrame, rows: Column) -> float:
    """The score below which a prediction is unclear, from all labelled rows given, which the model has not learned from:
    CLEAR_SHARE of the right predictions reach it. Scores are counted by GRID steps, rounded down. Where there are too few
    to tell such a share the bound is below their lowest score, by a multiple of what the next sqrt(n) scores lie apart;
    with fewer than CLEAR_LEAST it is 0. Repeated rows count as they come."""
    known = docs.filter(rows & F.col("lang").isNotNull() & (F.length("text") > 0))
    tagged = known.select("lang", language(model).alias("tag"))
    step = F.when(F.col("tag.lang_pred") == F.col("lang"), F.floor(F.col("tag.score") * GRID))
    right = sorted((r.step, r["count"]) for r in tagged.groupBy(step.alias("step")).count().collect() if r.step is not None)  # GRID + 1 rows
    upto = np.cumsum([n for _, n in right])
    total = int(upto[-1]) if right else 0
    if total < CLEAR_LEAST:
        return 0.0
    score = lambda k: right[int(np.searchsorted(upto, k, "right"))][0] / GRID  # noqa: E731  # the k-th lowest, from 0
    below = total * (1 - CLEAR_SHARE)
    if below >= 1:
        return score(int(below))
    near = score(min(total - 1, int(np.ceil(np.sqrt(total)))))
    return max(0.0, score(0) - 3 * (1 - below) * (near - score(0)))


def identify(docs: DataFrame, rows: Column | None = None) -> DataFrame:
    """docs (doc_id, text, lang) to doc_id, lang_pred, score, learning from the given rows."""
    tagged = docs.select("doc_id", language(train(docs, rows)).alias("tag"))
    return tagged.select("doc_id", "tag.lang_pred", "tag.score")


def op9(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, fold("doc_id", 5) != 0)
    return out.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
