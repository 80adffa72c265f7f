"""Quality rules by isolation: path lengths and verdict against a plain version, and what is anomalous."""

import numpy as np

from tests.llm.data import labels, prose
from tidelog.llm import quality_rules as q
from tidelog.llm.common import fold

WIDTH = len(q.STATISTICS)


def clean_rows(n, rng):
    return np.clip(np.stack([rng.normal(0, 0.4, n).round()] * 5 + [rng.normal(20, 2, n).round(), rng.normal(15, 5, n).round()], 1), 0, q.LEVELS - 1).astype(np.uint8)


def cells(rows):
    x, n = np.unique(rows, axis=0, return_counts=True)
    return x, np.log2(1.0 + n)


def plain_path(tree, row):
    feature, split, left, path = tree
    at = 0
    while feature[at] >= 0:
        at = left[at] + int(row[feature[at]] > split[at])
    return path[at]


def test_path_lengths_against_a_plain_walk():
    rng = np.random.default_rng(1)
    x, w = cells(clean_rows(500, rng))
    forest = q.fit_forest(x, w, 20)
    rows = np.concatenate([x[:50], rng.integers(0, q.LEVELS, (50, WIDTH)).astype(np.uint8)])
    want = [2.0 ** -(np.mean([plain_path(t, r) for t in forest["trees"]]) / q.average_path(q.SUBSAMPLE)) for r in rows]
    assert np.allclose(q.anomaly(forest, rows), want)
    for feature, split, left, path in forest["trees"]:  # a tree holds its rows at its leaves, no deeper than its limit
        assert (path[feature < 0] < forest["limit"] + q.average_path(q.SUBSAMPLE) + 1).all() and (left[feature >= 0] > 0).all()


def test_the_usual_is_least_anomalous_and_anomaly_rises_with_junk():
    rng = np.random.default_rng(2)
    for junk in (0, 30, 500):  # of 1500: rare, or a third of all and much alike
        rows = clean_rows(1500, rng)
        rows[:junk, 0] = rng.integers(20, 24, junk)
        rules = q.fit_rules(*cells(rows))
        for k in range(WIDTH):
            assert rules["each"][k][rules["typical"][k]] <= rules["each"][k].min() + 0.03
        symbols = rules["each"][0]
        assert rules["typical"][0] == 0 and symbols[0] == symbols.min() and symbols[6] > symbols[0] and symbols[23] > symbols[0] + 0.05
        assert junk == 500 or symbols[6] <= symbols[15] + 0.01 <= symbols[30] + 0.02  # where junk is rare, more of it is more anomalous


def test_all_statistics_together_reject_odd_combinations():
    rng = np.random.default_rng(3)
    rows = np.zeros((3000, WIDTH), np.uint8)
    rows[:, 5] = rng.integers(10, 30, 3000)
    rows[:, 6] = rows[:, 5]  # long words go with long texts
    odd = rows[:40].copy()
    odd[:, 5], odd[:, 6] = 12, 27  # each usual by itself
    rules = q.fit_rules(*cells(np.concatenate([rows, odd])))
    usual, strange = q.anomaly(rules["all"], rows), q.anomaly(rules["all"], odd)
    assert strange.min() > np.quantile(usual, 0.995)
    score = q.judged(rules, np.concatenate([rows, odd]))
    label = np.r_[np.ones(3000, int), np.zeros(40, int)]
    limit = [q.calibrate(score[:, k], label) for k in range(score.shape[1])]
    assert np.isfinite(limit[0]) and (score[3000:, 0] > limit[0]).mean() > 0.9 and (score[:3000, 0] > limit[0]).mean() < 0.01
    assert (score[3000:, 1:] <= np.array(limit[1:])).all()


def test_thresholds_are_above_the_usual_and_the_verdict_is_plain(spark):
    texts = []
    for k in range(400):
        words = prose(k, 90).split()
        bad = k % 5 == 0
        texts.append(" ".join(w + "#" * (3 if bad and i % 2 else 0) for i, w in enumerate(words)) + ("#" if k % 7 == 1 else ""))  # a few symbols are usual
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = labels(spark, [(k, int(k % 5 > 0), 0) for k in range(400)])
    stats = q.rule_statistics(docs)
    rules = q.train(stats, marks, fold("doc_id", 5) != 0)
    out = {r.doc_id: r for r in q.apply_rules(docs, marks, fold("doc_id", 5) != 0).collect()}
    rows = {r.doc_id: r for r in stats.collect()}
    names = ["all", *(f"{s}_{side}" for side in ("above", "below") for s in q.STATISTICS)]
    import pandas as pd

    order = sorted(rows)
    x = q.levels(pd.DataFrame([rows[k].asDict() for k in order]))
    usual = q.judged(rules, np.array([rules["typical"]], np.uint8))[0]
    assert (rules["thresholds"] > usual).all()  # what is typical in all is never rejected
    for k, level in zip(order, x):
        above = [rules["each"][j][v] if v > t else usual[1 + j] for j, (v, t) in enumerate(zip(level, rules["typical"]))]
        below = [rules["each"][j][v] if v < t else usual[1 + j] for j, (v, t) in enumerate(zip(level, rules["typical"]))]
        everything = 2.0 ** -(np.mean([plain_path(t, level) for t in rules["all"]["trees"]]) / rules["all"]["norm"])
        score = np.array([everything, *above, *below])
        over = [n for n, s, t in zip(names, score, rules["thresholds"]) if s > t]
        assert out[k].rule == (over[0] if over else None) and out[k].kept == (not over and not out[k].base_failed) and np.isclose(out[k].anomaly, everything)
    assert sum(out[k].kept for k in range(400) if k % 5) >= 316 and not any(out[k].kept for k in range(0, 400, 5))


def test_thresholds_come_from_all_labelled_rows(spark):
    """More rows than a bounded sample would take, some of them odd."""
    import pandas as pd
    from pyspark.sql import functions as F

    n = 9000
    junk = (F.col("id") % 3 == 0) & (F.col("id") % 1000 != 0)
    symbols = F.when(junk, 40 + F.col("id") * 7919 % 60).otherwise(F.col("id") * 104729 % 23)
    stats = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(100).cast("long").alias("n_words"), (F.col("id") % 90 + 400).alias("word_chars"), symbols.alias("n_symbols"), *(F.lit(k).cast("long").alias(c) for c, k in (("n_dup_lines", 0), ("n_repeat_words", 0), ("n_lines", 3))), (F.col("id") % 11).alias("n_upper"), F.lit(1).cast("long").alias("n_marks"))
    marks = spark.range(n).selectExpr("id as doc_id", "cast(id % 3 > 0 as int) as quality")
    rules = q.train(stats, marks, F.lit(True))
    rows = stats.toPandas()
    score, label = q.judged(rules, q.levels(rows)), (rows["doc_id"] % 3 > 0).to_numpy(int)
    keep = 1 - (1 - q.KEEP_GOOD) / score.shape[1]
    want = [q.calibrate(score[:, k], label, keep) for k in range(score.shape[1])]
    assert list(rules["thresholds"][1:]) == want[1:] and np.isfinite(want[1:]).any()
    assert ((score[:, 0] > rules["thresholds"][0]) == (score[:, 0] > want[0])).mean() > 0.999


def test_trees_draw_from_all_rows_by_weight(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(q, "grown", lambda drawn, rng: np.concatenate(drawn) if drawn else None)
    cell = F.unhex(F.concat(*(F.lpad(F.hex(F.floor(F.col("id") / 40**k) % 40), 2, "0") for k in range(WIDTH))))
    cells = spark.range(30_000).select(cell.alias("cell"), F.when(F.col("id") % 100 == 0, 50 * q.UNIT).otherwise(q.UNIT).cast("long").alias("w"))
    drawn = q.draw(cells)
    number = (drawn[:, :3].astype(int) * [1, 40, 1600]).sum(1)
    assert len(drawn) == q.TREES * q.SUBSAMPLE and len(set(number)) > 12_800 // 2 and len(set(number // 1000)) == 30
    assert abs((number % 100 == 0).mean() - 50 / 149) < 0.02
    assert (q.draw(cells.repartition(7)) == drawn).all()
    assert q.draw(cells.limit(1)) is None
    sums = q.level_sums(cells)
    assert (sums.sum(1) == 300 * 50 * q.UNIT + 29_700 * q.UNIT).all() and sums[0, 0] == sum((50 if i % 100 == 0 else 1) * q.UNIT for i in range(0, 30_000, 40))
