"""Toxicity: a bidirectional gated recurrent network with attention pooling over words and characters.

Each word enters as a learned word vector (hashed) joined with the scaled sum of learned vectors of its
character runs (hashed). The network reads a text in both directions; attention pools the states of
each window of WINDOW words, and a logistic unit scores the pooled state. The windows from every word
on of every text are scored, so that a passage is read whole wherever it stands; a document's score is
that of its highest window. Windows share the states of the words they have in common: a text is read
in stretches of CORE words, each from CONTEXT words before it to CONTEXT words behind it. The network is
trained in numpy by backpropagation through time, on the document labels of a bounded sample of
PER_CLASS documents a class (of longer texts a stretch of MAX_CHARS characters, at a place given by the
id's hash): a document's error goes to its highest window.

Defined results: a null or empty text is one window without words. Repeated rows get equal scores
(rounded to 6 places). Null labels are left out. Without labels of both kinds the score is the share of
label 1 (0 with none).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import fold, labelled_texts, read_table
from tidelog.llm.nets import KEEP, Adam, gru_backward, gru_forward, scatter_sum, sigmoid

WINDOW = 16
CORE, CONTEXT = 64, 16
PER_CLASS, MAX_CHARS = 900, 12_000
HIDDEN, ATTEND = 8, 8
WORD_ROWS, WORD_DIM = 1 << 15, 6
#: Byte runs of a word with its ends marked, and hashed rows for each length.
GRAMS, GRAM_ROWS, GRAM_DIM = (3, 5), 1 << 14, 8
#: Characters that are scored side by side, and stretches in one pass of the network.
CHUNK, LANES = 1_000_000, 2048


#: ASCII letters in lower case and digits stay, other ASCII separates words, all beyond ASCII stays.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b > 127 else 32 for b in range(256))
#: A word has a vector of its own from so many documents of the sample; rarer words have their characters only.
COMMON = 8
#: Exponent of the loss that discounts documents whose label their text contradicts (0: cross-entropy).
ROBUST = 0.7
#: Windows of a document without the label that its error goes to.
CALM = 4


class Words(dict):
    """Distinct words of a batch, numbered from 1 (0 is padding), and their hashed rows."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self) + 1
        return number

    def numbers(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of all texts, text by text, and how many each has; a text without words has one 0."""
        words = [(t or "").encode("utf-8", "replace").translate(FOLDED).split() for t in texts]
        size = np.array([len(w) for w in words], np.int64)
        flat = np.fromiter(map(self.__getitem__, (w for ws in words for w in ws)), np.int32, int(size.sum()))
        empty = np.flatnonzero(size == 0)
        return np.insert(flat, (np.cumsum(size) - size)[empty], 0), np.maximum(size, 1)

    def windows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All windows (rows of word numbers, 0 behind a short text's end) and the text of each, in the order of window_logits."""
        flat, size = self.numbers(texts)
        start, owner = window_starts(size)
        at = start[:, None] + np.arange(WINDOW)
        end = np.cumsum(size)[owner][:, None]
        return np.where(at < end, flat[np.minimum(at, len(flat) - 1)], 0) if len(flat) else np.zeros((0, WINDOW), np.int32), owner

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word row of each number, all character runs' rows, and the number each run belongs to."""
        words = [b"", *self]
        word = np.fromiter((zlib.crc32(w) % WORD_ROWS for w in words), np.int64, len(words))
        flat = np.frombuffer(b"".join(b"<%s>" % w for w in words), np.uint8).astype(np.int64)
        size = np.array([len(w) + 2 for w in words])
        owner = np.repeat(np.arange(len(words)), size)
        grams, owners = [], []
        for k, n in enumerate(GRAMS):
            same = owner[: 1 - n] == owner[n - 1 :]
            code = np.zeros(len(same), np.int64)
            for j in range(n):
                code = (code * 257 + flat[j : len(flat) - n + 1 + j]) % (1 << 40)
            grams.append((code * 40503 + k) % 1000003 % GRAM_ROWS + k * GRAM_ROWS)
            grams[-1] = grams[-1][same]
            owners.append(owner[: 1 - n][same])
        return word, np.concatenate(grams), np.concatenate(owners)


def window_starts(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word of every window (short texts have one) and its text."""
    count = np.maximum(1, size - WINDOW + 1)
    owner = np.repeat(np.arange(len(size)), count)
    shift = (np.cumsum(size) - size) - (np.cumsum(count) - count)
    return np.arange(len(owner)) + shift[owner], owner


@dataclass
class Stretches:
    """Rows of word numbers that the network reads (lanes x CONTEXT + CORE + CONTEXT); inside marks the words of the core."""

    idx: np.ndarray
    inside: np.ndarray


def stretches(flat: np.ndarray, size: np.ndarray) -> Stretches:
    lanes = -(-size // CORE)
    text = np.repeat(np.arange(len(size)), lanes)
    begin = np.cumsum(size) - size
    first = begin[text] + (np.arange(len(text)) - (np.cumsum(lanes) - lanes)[text]) * CORE
    at = first[:, None] + np.arange(-CONTEXT, CORE + CONTEXT)
    real = (at >= begin[text][:, None]) & (at < (begin + size)[text][:, None])
    idx = np.where(real, flat[np.clip(at, 0, max(0, len(flat) - 1))], 0) if len(flat) else np.zeros(at.shape, np.int32)
    return Stretches(idx, real[:, CONTEXT : CONTEXT + CORE])


def start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    normal = lambda s, *shape: rng.normal(0, s, shape).astype(np.float32)
    d = WORD_DIM + GRAM_DIM
    return {
        "word": normal(0.1, WORD_ROWS, WORD_DIM), "gram": normal(0.1, len(GRAMS) * GRAM_ROWS, GRAM_DIM),
        "w": normal(d**-0.5, 2, d, 3 * HIDDEN), "b": np.zeros((2, 1, 3 * HIDDEN), np.float32),
        "u": normal(HIDDEN**-0.5, 2, HIDDEN, 3 * HIDDEN), "wa": normal(0.3, 2 * HIDDEN, ATTEND), "a": normal(0.3, ATTEND),
        "c": normal(0.3, 2 * HIDDEN), "d": np.zeros(1, np.float32),
    }


def symbol_table(p: dict, rows: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Input projections of all words of a batch; their vectors; scale of a word's runs."""
    word, gram, owner = rows
    count = np.sqrt(np.maximum(1, np.bincount(owner, minlength=len(word))))[:, None].astype(np.float32)
    chars = np.stack([np.bincount(owner, p["gram"][gram, k], len(word)) for k in range(GRAM_DIM)], 1) / count
    x = np.concatenate([p["word"][word], chars], 1).astype(np.float32)
    table = np.matmul(x, p["w"]) + p["b"]
    table[:, 0] = 0
    table[:, 0, :HIDDEN] = KEEP
    return table, x, count


def core_states(out: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """States of both directions of the core words, word by word in text order, from (2, T, lanes, HIDDEN)."""
    core = out[:, CONTEXT : CONTEXT + CORE].transpose(2, 1, 0, 3)
    return core.reshape(*core.shape[:2], -1)[inside]


def attention(p: dict, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weight of each word (the same in all windows, up to their sums), its vote, and the attention layer."""
    t = np.tanh(h @ p["wa"])
    return np.exp(np.clip(t @ p["a"], -30, 30)), h @ p["c"], t


def read(p: dict, table: np.ndarray, s: Stretches) -> tuple[np.ndarray, np.ndarray]:
    """Weight and vote of every word."""
    weight, vote = [], []
    for k in range(0, len(s.idx), LANES):
        w, v, _ = attention(p, core_states(gru_forward(table, p["u"], s.idx[k : k + LANES]), s.inside[k : k + LANES]))
        weight.append(w)
        vote.append(v)
    return (np.concatenate(weight), np.concatenate(vote)) if weight else (np.zeros(0, np.float32),) * 2


def window_sums(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sum over each window of the texts, words added one by one from the first."""
    begin, owner = window_starts(size)
    padded, total = np.concatenate([x, np.zeros(WINDOW - 1, x.dtype)]), np.zeros(len(x))
    for k in range(WINDOW):
        total += padded[k : k + len(x)]
    out = total[begin]
    for i in np.flatnonzero(size < WINDOW):  # a short text ends before its neighbour begins
        at = np.searchsorted(owner, i)
        out[at] = x[begin[at] : begin[at] + size[i]].astype(float).sum()
    return out


def window_logits(p: dict, weight: np.ndarray, vote: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Logit of every window: the votes of its words, weighed by attention."""
    return window_sums(weight * vote, size) / window_sums(weight, size) + float(p["d"][0])


def taught(logit: np.ndarray, label: int) -> np.ndarray:
    """Windows of a document that its error goes to: the highest; without the label the CALM highest that begin in different stretches of WINDOW words."""
    if label:
        return np.array([int(np.argmax(logit))])
    best = [k + int(np.argmax(logit[k : k + WINDOW])) for k in range(0, len(logit), WINDOW)]
    return np.array(sorted(best, key=lambda k: -logit[k])[:CALM])


def fit_documents(texts: list[str], y: np.ndarray, seed: int = 3, epochs: int = 9, batch: int = 24) -> dict:
    """Document labels only: each document's error goes to its highest window, and for documents
    without the label to several, so that no window of theirs stands out."""
    rng = np.random.default_rng(seed)
    p = start(rng)
    words = Words()
    flat, size = words.numbers(texts)
    rows = words.rows()
    # the first word component starts as the log odds of the word among the labelled documents
    pairs = np.unique((np.repeat(np.arange(len(texts)), size) * WORD_ROWS + rows[0][flat])[flat > 0])
    seen = np.stack([np.bincount(pairs[y[pairs // WORD_ROWS] == k] % WORD_ROWS, minlength=WORD_ROWS) for k in (0, 1)])
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    odds = np.log((seen[1] + 3.0) / (n1 + 6)) - np.log((seen[0] + 3.0) / (n0 + 6))
    p["word"][:, 0] = np.clip(odds, -2, 4) / 2
    common = (seen.sum(0) >= COMMON).astype(np.float32)[:, None]
    p["word"] *= common
    begin = np.cumsum(size) - size
    adam = Adam(p, 0.01)
    steps, done = epochs * (-(-len(texts) // batch)), 0
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(texts), batch):
            adam.rate = 0.012 * (1 - done / steps) + 0.0005
            done += 1
            docs = order[at : at + batch]
            n, label = size[docs], y[docs]
            used, local = np.unique(np.concatenate([[0], *(flat[begin[i] : begin[i] + size[i]] for i in docs)]), return_inverse=True)
            row_of = np.full(len(rows[0]), -1)
            row_of[used] = np.arange(len(used))
            owner = row_of[rows[2]]
            part = (rows[0][used], rows[1][owner >= 0], owner[owner >= 0])
            table, x, count = symbol_table(p, part)
            s = stretches(local[1:].astype(np.int32), n)
            logit = window_logits(p, *read(p, table, s), n)
            first, of = window_starts(n)
            bounds = np.searchsorted(of, np.arange(len(docs) + 1))
            keep = [bounds[j] + taught(logit[bounds[j] : bounds[j + 1]], label[j]) for j in range(len(docs))]
            top = np.concatenate(keep)
            share = np.repeat([1 / len(k) for k in keep], [len(k) for k in keep])
            # words of these windows, and the stretches that hold them, are read again with what the gradient needs
            length = np.minimum(WINDOW, n[of[top]])
            window = np.repeat(np.arange(len(top)), length)
            word = np.repeat(first[top], length) + np.arange(len(window)) - np.repeat(np.cumsum(length) - length, length)
            lane = np.repeat(np.arange(len(s.idx)), s.inside.sum(1))
            chosen = np.unique(lane[word])
            sub, inside = s.idx[chosen], s.inside[chosen]
            read_again = np.zeros(len(s.idx), bool)
            read_again[chosen] = True
            place = (np.cumsum(read_again[lane]) - 1)[word]
            out, saved = gru_forward(table, p["u"], sub, keep=True)
            h = core_states(out, inside)
            weight, vote, t = attention(p, h)
            total = np.bincount(window, weight[place])
            att = weight[place] / total[window]
            z = np.bincount(window, att * vote[place])
            prob = sigmoid(z + float(p["d"][0]))
            top_y = label[of[top]]
            trust = np.where(top_y, prob, 1 - prob) ** ROBUST if epoch else 1.0
            dlogit = (prob - top_y) * trust * share / len(docs)
            dvote = np.bincount(place, att * dlogit[window], len(h)).astype(np.float32)
            draw = np.bincount(place, att * (vote[place] - z[window]) * dlogit[window], len(h)).astype(np.float32)
            dt = draw[:, None] * p["a"] * (1 - t * t)
            dh = dvote[:, None] * p["c"] + dt @ p["wa"].T
            dout = np.zeros((len(sub), CORE, 2 * HIDDEN), np.float32)
            dout[inside] = dh
            dout = np.pad(dout.reshape(len(sub), CORE, 2, HIDDEN).transpose(2, 1, 0, 3), ((0, 0), (CONTEXT, CONTEXT), (0, 0), (0, 0)))
            dtable, du = gru_backward(table, p["u"], sub, saved, dout)
            dx = np.matmul(dtable, p["w"].transpose(0, 2, 1)).sum(0)
            adam.update({
                "word": scatter_sum(part[0], dx[:, :WORD_DIM], WORD_ROWS) * common,
                "gram": scatter_sum(part[1], (dx[:, WORD_DIM:] / count)[part[2]], len(GRAMS) * GRAM_ROWS),
                "w": np.matmul(x.T, dtable), "b": dtable.sum(1, keepdims=True), "u": du,
                "wa": h.T @ dt, "a": t.T @ draw, "c": h.T @ dvote, "d": np.array([dlogit.sum()], np.float32),
            })
    return p


def train(docs: DataFrame, labels: DataFrame, rows: Column | None = None, label: str = "toxic") -> dict:
    """Model from labels (doc_id, toxic) of the given rows."""
    sample = labelled_texts(docs, labels, label, F.lit(True) if rows is None else rows, PER_CLASS, MAX_CHARS)
    y = np.array([min(1, max(0, v)) for _, v in sample], int)
    net = None
    if len(set(y)) == 2:
        net = fit_documents([t for t, _ in sample], y)
        kind = F.least(F.greatest(label, F.lit(0)), F.lit(1))
        count = dict(labels.select("doc_id", label).dropna().filter(F.lit(True) if rows is None else rows).groupBy(kind).count().collect())
        # the sample holds both labels alike; scores are for labels as they occur
        net["d"] = net["d"] + np.float32(np.log(count[1] / count[0] * (y == 0).sum() / (y == 1).sum()))
    return {"net": net, "score": float(y.mean()) if len(y) else 0.0}


def windows_scored(net: dict, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Logit of every window of every text, and the text of each."""
    words = Words()
    flat, size = words.numbers(texts)
    table, _, _ = symbol_table(net, words.rows())
    return window_logits(net, *read(net, table, stretches(flat, size)), size), window_starts(size)[1]


def scores(model: dict, texts: list[str | None]) -> np.ndarray:
    if model["net"] is None:
        return np.full(len(texts), model["score"])
    out, at = [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= CHUNK):
            size += len(texts[end] or "")
            end += 1
        logit, owner = windows_scored(model["net"], texts[at:end])
        highest = np.maximum.reduceat(logit, np.searchsorted(owner, np.arange(end - at)))
        out.append(np.round(sigmoid(highest), 6))
        at = end
    return np.concatenate(out) if out else np.zeros(0)


def toxicity(model: dict, text: str | Column = "text") -> Column:
    """Score of a text column, 0 to 1."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(scores(model, [t if isinstance(t, str) else None for t in s]))

    return score(text)


def op3(spark, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = train(docs, labels, fold("doc_id", 5) != 0)
    out = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), toxicity(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
