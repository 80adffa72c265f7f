"""Quality rules: rule statistics of every text, judged by isolation forests.

Each statistic is scaled to 0..1 and cut to LEVELS levels. Every distinct row of levels of the corpus is counted and
weighs by the logarithm of how often it occurs. Forests are grown over all of them: each tree over SUBSAMPLE rows drawn
by weight from the whole, as the method has it, so that what is usual is dense and takes many splits to isolate, while
junk that is alike, however much of it, weighs little more than rare junk. One forest (`all`) is over all statistics, and one over each of them. A document's
anomaly in a forest follows from its path lengths over the random splits: lowest where most rows are, and higher the
farther out and the rarer it is. For a statistic's forest it counts on one side of the typical level at a time, as many
symbols and none may be equally far out and only one of the two is bad.

Thresholds, one for each forest and side, are calibrated on all labelled rows that pass the base rule, by counts of
their anomalies (on a grid of GRID steps for the forest of all statistics): a threshold lies above the anomaly of at least KEEP_GOOD of the rows labelled 1 (all
thresholds together), where it separates the labels best, and is in force only where more of the rows
labelled 0 than of the others lie above it. A document is rejected where an anomaly is above its threshold, and kept
if it passes the base rule and no threshold rejects it.

Defined results: rows of undefined text (null or empty) have no words and fail the base rule. Repeated rows
are counted as they come. An anomaly equal to its threshold is kept. Null labels and ids are left out of
calibration; without labels of both kinds only the forest of all statistics judges, by
DEFAULT_THRESHOLD; with fewer than two distinct rows of levels every anomaly is 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import fold, materialize, read_table

#: Trees of the forest of all statistics, and of each statistic's; rows a tree.
TREES, TREES_EACH, SUBSAMPLE = 100, 50, 256
LEVELS = 48
#: Parts that the distinct rows are dealt into by hash, steps of a unit of weight, and steps of an anomaly.
PARTS, UNIT, GRID = 256, 1 << 20, 1 << 16
KEEP_GOOD, DEFAULT_THRESHOLD = 0.995, 0.75
#: A threshold is in force where it rejects at least this share of the rows labelled 0.
LEAST_BAD = 0.01
MIN_WORDS = 50

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
MARKS = b"!?"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]
#: Statistics of the forests, and the value of an unbounded one that counts half.
STATISTICS = ["symbols", "capitals", "marks", "repeated_lines", "repeated_words", "word_length", "length"]
HALF = {"symbols": 0.2, "capitals": 0.2, "marks": 0.2, "word_length": 6.0, "length": 300.0}


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows found twice or more."""
    order = {w: i for i, w in enumerate(dict.fromkeys(words))}
    n = len(words)
    if n < 4:
        return 0
    ids = np.fromiter(map(order.__getitem__, words), np.int64, n)
    if len(order) < 1 << 21:
        key = (ids[:-2] << 42) | (ids[1:-1] << 21) | ids[2:]
    else:  # pairs are numbered first, so that the key stays exact
        pair = np.unique((ids[:-2] << 32) | ids[1:-1], return_inverse=True)[1]
        key = (pair.astype(np.int64) << 32) | ids[2:]
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = count[inverse] > 1
    hit = np.zeros(n, bool)
    hit[:-2] |= twice
    hit[1:-1] |= twice
    hit[2:] |= twice
    return int(hit.sum())


def rule_counts(text: str | None) -> tuple[int, ...]:
    """The COUNTS of one text; all 0 for null."""
    if text is None:
        return (0,) * len(COUNTS)
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    less = lambda chars: len(raw) - len(raw.translate(None, chars))
    return (
        len(words), len(text) - less(SPACES), less(SYMBOLS), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), less(UPPER), less(MARKS),
    )


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the COUNTS of every text."""

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([rule_counts(t if isinstance(t, str) else None) for t in s], columns=COUNTS)

    return docs.select("doc_id", counts("text").alias("s")).select("doc_id", "s.*")


def levels(pdf: pd.DataFrame) -> np.ndarray:
    """Levels of the STATISTICS, 0 to LEVELS - 1: ratios a word (or character, or line) of the COUNTS.

    Unbounded ratios saturate: a few extreme rows must not stretch the range that splits are drawn from.
    """
    n = np.maximum(1, pdf["n_words"].to_numpy(float))
    chars, lines = np.maximum(1, pdf["word_chars"].to_numpy(float)), np.maximum(1, pdf["n_lines"].to_numpy(float))
    x = {
        "symbols": pdf["n_symbols"] / n, "capitals": pdf["n_upper"] / chars, "marks": pdf["n_marks"] / n, "repeated_lines": pdf["n_dup_lines"] / lines,
        "repeated_words": pdf["n_repeat_words"] / n, "word_length": chars / n, "length": n,
    }
    scaled = np.stack([np.asarray(x[k] / (x[k] + HALF[k]) if k in HALF else x[k], float) for k in STATISTICS], 1)
    return np.minimum(LEVELS - 1, np.floor(scaled * LEVELS)).astype(np.uint8)


def average_path(n: float) -> float:
    """Mean length of an unsuccessful search in a binary tree of n nodes."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> tuple[np.ndarray, ...]:
    """One isolation tree as arrays: feature (-1 at a leaf), split, left child, path length."""
    feature, split, left, path = [], [], [], []

    def add() -> int:
        for a in (feature, split, left, path):
            a.append(0)
        return len(feature) - 1

    stack = [(add(), x, 0)]
    while stack:
        at, rows, depth = stack.pop()
        spread = np.flatnonzero(np.ptp(rows, axis=0) > 0) if len(rows) > 1 else []
        feature[at], path[at] = -1, depth + average_path(len(rows))
        if depth < limit and len(spread):
            f = int(rng.choice(spread))
            s = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
            below = rows[:, f] <= s
            feature[at], split[at] = f, s
            left[at] = add()
            right = add()
            stack += [(left[at], rows[below], depth + 1), (right, rows[~below], depth + 1)]
    return np.array(feature), np.array(split, float), np.array(left), np.array(path, float)


def fit_forest(x: np.ndarray, weight: np.ndarray, trees: int = TREES, seed: int = 11) -> dict:
    """Isolation forest, each tree over SUBSAMPLE rows of x drawn by weight (a row may be drawn more than once, and is then dense)."""
    rng = np.random.default_rng(seed)
    share = weight / weight.sum() if len(x) else None
    return grown([x[rng.choice(len(x), SUBSAMPLE, p=share)] for _ in range(trees)] if len(x) > 1 else [], rng)


def grown(drawn: list[np.ndarray], rng: np.random.Generator) -> dict:
    """The forest of a tree over each of the sets of rows drawn."""
    limit = int(np.ceil(np.log2(SUBSAMPLE)))
    return {"trees": [grow(x.astype(float), rng, limit) for x in drawn], "norm": average_path(SUBSAMPLE), "limit": limit}


def anomaly(forest: dict, x: np.ndarray) -> np.ndarray:
    """2 ** -(mean path / expected path): near 1 for rows that random splits isolate early."""
    if not forest["trees"]:
        return np.zeros(len(x))
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, split, left, path in forest["trees"]:
        at = np.zeros(len(x), int)
        for _ in range(forest["limit"]):
            f = feature[at]
            at = np.where(f < 0, at, left[at] + (x[rows, np.maximum(f, 0)] > split[at]))
        total += path[at]
    return 2.0 ** -(total / len(forest["trees"]) / forest["norm"])


def fit_rules(x: np.ndarray, weight: np.ndarray) -> dict:
    """The rules of rows of levels x that are at hand."""
    sums = np.array([np.bincount(x[:, k], weight, LEVELS) for k in range(len(STATISTICS))])
    return rules_of(fit_forest(x, weight), sums)


def rules_of(forest: dict, sums: np.ndarray) -> dict:
    """The forest of all statistics, and for each statistic the anomaly of every level and the typical level, from the weight of all rows at each (statistic, level)."""
    levels_of = [np.flatnonzero(row) for row in sums]
    each = [anomaly(fit_forest(at[:, None], row[at], TREES_EACH, seed=12 + k), np.arange(LEVELS)[:, None]) for k, (at, row) in enumerate(zip(levels_of, sums))]
    return {"all": forest, "each": np.array(each), "typical": sums.argmax(1)}


def judged(rules: dict, x: np.ndarray) -> np.ndarray:
    """Anomaly of each row of levels, (rows, 1 + 2 statistics): in the forest of all, then above and below the typical level of each (on the other side that of the typical level)."""
    each = np.stack([rules["each"][k][x[:, k]] for k in range(len(STATISTICS))], 1)
    usual = rules["each"][np.arange(len(STATISTICS)), rules["typical"]]
    return np.concatenate([anomaly(rules["all"], x)[:, None], np.where(x > rules["typical"], each, usual), np.where(x < rules["typical"], each, usual)], 1)


def calibrate(score: np.ndarray, label: np.ndarray, keep: float = KEEP_GOOD) -> float:
    """Rows with a score up to the threshold are kept; infinite where it rejects no more of label 0 than of label 1."""
    tried, of = np.unique(score, return_inverse=True)
    return calibrate_counts(tried, np.bincount(of[label == 1], minlength=len(tried)), np.bincount(of[label == 0], minlength=len(tried)), keep)


def calibrate_counts(score: np.ndarray, good: np.ndarray, bad: np.ndarray, keep: float = KEEP_GOOD, step: float = 0.0) -> float:
    """The threshold of ascending scores, rounded up by less than step, with how many rows labelled 1 and 0 have each; there are some of both."""
    upto = np.cumsum(good)
    floor = int(np.searchsorted(upto, max(1, int(np.ceil(keep * upto[-1])))))
    gain = (bad.sum() - np.cumsum(bad))[floor:] / bad.sum() - (upto[-1] - upto)[floor:] / upto[-1]
    best = floor + int(np.argmax(gain))
    if gain.max() < LEAST_BAD:
        return np.inf
    above = best + 1 + int(np.flatnonzero(bad[best + 1 :])[0])
    return float((score[best] + score[above] - step) / 2)


def base_rule() -> Column:
    """Too few words, or over half of them in repeated windows."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def as_levels(rows: DataFrame) -> DataFrame:
    """cell: the levels of each row, a byte each."""

    @F.pandas_udf("binary")
    def cell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for pdf in batches:
            yield pd.Series([x.tobytes() for x in levels(pdf)], dtype=object)

    return rows.withColumn("cell", cell(F.struct(*COUNTS)))


def rows_of(cells: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(cells), np.uint8).reshape(-1, len(STATISTICS))


def draw(cells: DataFrame, trees: int = TREES, seed: int = 11) -> dict:
    """The forest of all statistics over all cells (cell, w: an integer weight): every tree's rows are drawn by weight from the whole.

    Cells stand in an order of hash parts; the parts' sums are known to the driver, which names the places to draw (as
    many as trees have rows), and each part finds the cells at its places.
    """
    rng = np.random.default_rng(seed)
    parted = cells.withColumn("part", F.pmod(F.xxhash64("cell"), F.lit(PARTS)))
    sums = sorted(parted.groupBy("part").agg(F.sum("w"), F.count("*")).collect())  # PARTS rows
    if sum(r[2] for r in sums) < 2:
        return grown([], rng)
    upto = np.cumsum([r[1] for r in sums])
    place = rng.integers(0, upto[-1], trees * SUBSAMPLE)
    start = {int(r[0]): int(u - r[1]) for r, u in zip(sums, upto)}
    drawn = np.sort(place)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell", ignore_index=True)
        ends = start[int(pdf["part"].iloc[0])] + np.cumsum(pdf["w"].to_numpy(np.int64))
        lo, hi = np.searchsorted(drawn, [ends[0] - pdf["w"].iloc[0], ends[-1]])
        at = np.unique(drawn[lo:hi])
        return pd.DataFrame({"place": at, "cell": pdf["cell"].to_numpy()[np.searchsorted(ends, at, "right")]})

    at = {r.place: bytes(r.cell) for r in parted.groupBy("part").applyInPandas(pick, "place long, cell binary").collect()}  # trees * SUBSAMPLE
    x = rows_of([at[int(p)] for p in place]).reshape(trees, SUBSAMPLE, -1)
    return grown(list(x), rng)


def level_sums(cells: DataFrame) -> np.ndarray:
    """The weight of all cells at each level of each statistic."""
    each = cells.select("w", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(len(STATISTICS))), lambda k: F.conv(F.hex(F.substring(F.col("cell"), k, F.lit(1))), 16, 10).cast("int"))).alias("k", "level"))
    out = np.zeros((len(STATISTICS), LEVELS), np.int64)
    for r in each.groupBy("k", "level").agg(F.sum("w").alias("w")).collect():  # a row a level
        out[r.k, r.level] = r.w
    return out


def label_counts(rules: dict, held: DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each threshold the ascending scores of held (cell, quality, n), with how many rows labelled 1 and 0 have each."""

    @F.pandas_udf("array<double>")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            x = judged(rules, rows_of([bytes(c) for c in s]))
            x[:, 0] = np.ceil(x[:, 0] * GRID) / GRID
            yield pd.Series(list(x), dtype=object)

    each = held.select("quality", "n", F.posexplode(scores("cell")).alias("k", "score"))
    good, bad = (F.sum(F.when(F.col("quality") == q, F.col("n")).otherwise(0)).alias(a) for q, a in ((1, "good"), (0, "bad")))
    got = each.groupBy("k", "score").agg(good, bad).toPandas()  # GRID rows for the forest of all, LEVELS for each other
    parts = [got[got["k"] == k].sort_values("score") for k in range(1 + 2 * len(STATISTICS))]
    return [(p["score"].to_numpy(float), p["good"].to_numpy(np.int64), p["bad"].to_numpy(np.int64)) for p in parts]


def train(stats: DataFrame, labels: DataFrame, rows: Column) -> dict:
    """Forests from stats (doc_id and COUNTS), thresholds from the labelled rows given."""
    sound = stats.filter(~base_rule())
    counted = as_levels(sound).groupBy("cell").agg(F.count("*").alias("n"))
    cells = materialize(counted.select("cell", F.round(F.log2(1.0 + F.col("n")) * UNIT).cast("long").alias("w")), "cells")
    rules = rules_of(draw(cells), level_sums(cells))
    one = labels.select("doc_id", "quality").dropna().filter(rows).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    held = as_levels(sound.join(one, "doc_id")).groupBy("doc_id", "quality").agg(F.min("cell").alias("cell"))
    held = materialize(held.groupBy("cell", "quality").agg(F.count("*").alias("n")), "labelled")
    held = held.filter("quality in (0, 1)")
    rules["thresholds"] = np.full(1 + 2 * len(STATISTICS), np.inf)
    if held.select("quality").distinct().count() == 2:
        keep = 1 - (1 - KEEP_GOOD) / len(rules["thresholds"])
        rules["thresholds"] = np.array([calibrate_counts(*c, keep, 0.0 if k else 1 / GRID) for k, c in enumerate(label_counts(rules, held))])
    else:
        rules["thresholds"][0] = DEFAULT_THRESHOLD
    return rules


def apply_rules(docs: DataFrame, labels: DataFrame, rows: Column | None = None) -> DataFrame:
    """doc_id, COUNTS, anomaly (in the forest of all statistics), rule (the statistic that rejects; null where none does), base_failed and kept of every document."""
    stats = materialize(rule_statistics(docs), "rules")
    rules = train(stats, labels, F.lit(True) if rows is None else rows)
    names = np.array(["all", *(f"{s}_{side}" for side in ("above", "below") for s in STATISTICS)], dtype=object)

    @F.pandas_udf("anomaly double, rule string")
    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            score = judged(rules, levels(pdf))
            over = score > rules["thresholds"]
            yield pd.DataFrame({"anomaly": score[:, 0], "rule": np.where(over.any(1), names[over.argmax(1)], None)})

    failed = base_rule()
    return (
        stats.withColumn("verdict", judge(F.struct(*COUNTS)))
        .select("doc_id", *COUNTS, "verdict.anomaly", "verdict.rule", failed.alias("base_failed"))
        .withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    )


def op10(spark, sf_dir: str) -> DataFrame:
    out = apply_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return out.select("doc_id", *COUNTS[:5], "base_failed", "kept", "anomaly", "rule")
