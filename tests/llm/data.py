"""Awkward small tables."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n_words string, key string"


def prose(seed: int, words: int, alphabet: str = "abcdefgh") -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(2, 8))) for _ in range(words))


def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, clashing extra columns."""
    same = prose(1, 80)
    texts = [None, "", "   \n ", "...", same, same, same + " tail", prose(2, 30_000), "a", "a b c d", prose(3, 200), "Ünï 日本 text " * 5]
    rows = [(k, t, ("en", "de")[k % 2], f"s{k % 2}", None if t is None else len(t), 0.5, "x", "k") for k, t in enumerate(texts)]
    rows += [(4, same, "en", None, None, None, None, None), (None, same, None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (7, "other text of a repeated id", "en", "s", 1, 1.0, "", "")]
    return spark.createDataFrame(rows, DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def ids_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
