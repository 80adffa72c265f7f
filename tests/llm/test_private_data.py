"""Personal data: patterns against the plain ones, the field against all segmentations, planted places."""

import hashlib
import itertools
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from tests.llm.data import no_docs, odd_docs, prose
from tidelog.llm import private_data as pd

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(ds):
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(ds)))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, (name, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            ds = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if name == "ip" else False, "card": 12 <= len(ds) <= 19 and plain_luhn(ds), "phone": 9 <= len(ds) <= 15}[name]
            out += [(kind, *m.span())] if ok else []
    return sorted(out, key=lambda s: (s[1], s[0]))


def card(r, n=16):
    ds = [r.randint(1, 9) for _ in range(n - 1)]
    return "".join(map(str, ds)) + next(c for c in "0123456789" if plain_luhn([*ds, int(c)]))


def kinds_of(r):
    return {
        "email": f"{prose(r.random(), 1)}.{r.randint(10, 99)}@mail{r.randint(1, 9)}.example.com", "ip": ".".join(str(r.randint(1, 255)) for _ in range(4)),
        "card": card(r), "phone": f"+1 ({r.randint(100, 999)}) 555-{r.randint(1000, 9999)}",
    }


@pytest.mark.parametrize("seed", range(6))
def test_base_against_the_plain_patterns(seed):
    r = random.Random(seed)
    pieces = ["1", "23", "4111111111111111", "255", "256", ".", ".", " ", "-", "+", "+1", "(", ")", "a", "x_y", "@", "@b.co", "é", "\n", "٣", "0000", "378282246310005"]
    for _ in range(4000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 16)))
        assert pd.base_spans(text)[0] == plain_spans(text), text
    for _ in range(300):
        text = " ".join(x for _ in range(4) for x in (prose(r.random(), 2), r.choice(list(kinds_of(r).values())), *(r.sample(list(kinds_of(r).values()), 1) if r.random() < 0.3 else ())))
        assert pd.base_spans(text)[0] == plain_spans(text), text


def small_field(r, texts):
    names = sorted({f for t in texts for at, spans in [pd.candidates(t)] for i, j in spans for f in pd.features(t, at[i], at[j])})
    field = pd.Field(names)
    field.weight = np.random.default_rng(r.randint(0, 99)).normal(0, 1, field.weight.shape)
    return field


def segmentations(spans):
    """All sets of spans that don't overlap."""
    for n in range(len(spans) + 1):
        for chosen in itertools.combinations(range(len(spans)), n):
            if all(spans[x][1] <= spans[y][0] or spans[y][1] <= spans[x][0] for x, y in itertools.combinations(chosen, 2)):
                yield chosen


PLACES = [pd.Place("1.2.3.4 5.6.7.8", " ", " "), pd.Place("+1 (377) 555-0271 10.0.0.1", "", ""), pd.Place("123456789 987654321", "a", "."), pd.Place("a.b@c.de", " ", " ")]


def test_field_against_all_segmentations():
    r = random.Random(1)
    for place in PLACES:
        field = small_field(r, PLACES)
        at, spans = pd.candidates(place)
        spans = spans[:14]
        x = pd.Lattice(len(at) - 1, spans, [field.rows(pd.features(place, at[i], at[j])) for i, j in spans], [])
        score = np.stack([field.weight[k].sum(0) for k in x.rows])
        z, p = pd.expected(x, score)
        total, share = 0.0, np.zeros_like(p)
        for chosen in segmentations(spans):
            for kinds in itertools.product(range(4), repeat=len(chosen)):
                w = np.exp(sum(score[c, k] for c, k in zip(chosen, kinds)))
                total += w
                for c, k in zip(chosen, kinds):
                    share[c, k] += w
        assert np.isclose(z, np.log(total)) and np.allclose(p, share / total)


def test_best_against_all_segmentations():
    r = random.Random(2)
    for place in PLACES * 5:
        field = small_field(r, PLACES)
        at, spans = pd.candidates(place)
        allowed = [(i, j, k, field.scores(pd.features(place, at[i], at[j]))[k]) for i, j in spans for k in pd.passed(place.text[at[i] : at[j]])]
        allowed = [a for a in allowed if a[3] > 0 and not (at[a[0]] < 3 and at[a[1]] > 1)]
        got = field.best(place, [(1, 3)])
        most = max(sum(allowed[c][3] for c in chosen) for chosen in segmentations([a[:2] for a in allowed]))
        mine = sum(field.scores(pd.features(place, a, b))[k] for k, a, b in got)
        assert np.isclose(mine, most) and all(s[2] <= t[1] for s, t in zip(got, got[1:]))


def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def test_spans_that_patterns_swallow(spark):
    r = random.Random(4)
    texts = [f"{prose(k, 5)} {list(kinds_of(r).values())[k % 4]} {prose(k + 1, 5)}" for k in range(160)] + [prose(k, 40) + f" {r.randint(10, 99999)} {r.randint(1, 99)}.{r.randint(1, 9)}" for k in range(60)]
    planted, wanted = [], []
    for _ in range(40):
        v = kinds_of(r)
        a, b = r.choice([("card", "card"), ("phone", "ip"), ("phone", "card"), ("card", "phone")])
        one, two = v[a], kinds_of(r)[b]
        head = prose(r.random(), 3) + " "
        planted.append(f"{head}{one} {two} {prose(1, 2)}")
        wanted.append({(a, len(head), len(head) + len(one)), (b, len(head) + len(one) + 1, len(head) + len(one) + 1 + len(two))})
    out = {x.doc_id: x for x in pd.find_private(rows(spark, texts + planted)).collect()}
    spans = lambda x: {(pd.KINDS[s.kind], s.start, s.stop) for s in [*x.base, *x.added]}
    assert not any(out[k].added for k in range(len(texts)))  # clean rows and plain ones
    assert sum(spans(out[len(texts) + k]) == w for k, w in enumerate(wanted)) >= 38
    base = {k: [(s.kind, s.start, s.stop) for s in x.base] for k, x in out.items()}
    assert base == {k: plain_spans(t) for k, t in enumerate(texts + planted)}


def test_odd_rows(spark):
    docs = odd_docs(spark).unionByName(rows(spark, [f"{prose(k, 3)} 4111111111111111 x" for k in range(9)] * 2 + ["a 4111111111111111 4111111111111111 b"]), allowMissingColumns=True)
    out = pd.find_private(docs)
    assert out.columns == ["doc_id", "base", "added"]
    got = Counter((x.doc_id, tuple((s.kind, s.start, s.stop) for s in x.base)) for x in out.collect())
    assert got == Counter((x.doc_id, tuple(plain_spans(x.text or ""))) for x in docs.collect())
    assert sum(len(x.added) for x in out.collect()) == 2
    assert pd.find_private(no_docs(spark)).count() == 0
    assert [x.added for x in pd.find_private(rows(spark, ["nothing here", None, "12 345"])).collect()] == [[], [], []]


def test_query(spark, tmp_path):
    texts = [f"{prose(k, 3)} {v} x" for k in range(8) for v in kinds_of(random.Random(k)).values()] + [None, ""]
    rows(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    for r in pd.op13(spark, str(tmp_path)).collect():
        want = plain_spans(texts[r.doc_id] or "")
        text = ",".join(f"{pd.KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in want) for x in range(4))
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.spans == text and r.n_added == 0


@pytest.mark.parametrize("text", ["1" * 10**6, "1 " * 500_000, "12-" * 300_000, "(" * 10**6, "+1 " * 300_000, "a" * 10**6 + "@", "a@" * 500_000, "1." * 500_000, "a.b@c.d " * 120_000, "4111111111111111 " * 60_000])
def test_long_texts_take_linear_time(text):
    field = pd.fit([(pd.Place("4111111111111111", " ", " "), [(2, 0, 16)])])
    began = time.time()
    spans, _ = pd.base_spans(text)
    for a, b in pd.places(text):
        field.best(pd.Place(text[a:b], text[a - 1 : a] if a else "", text[b : b + 1]), [])
    assert time.time() - began < 30
    assert len(spans) == (120_000 if "c.d" in text else 0 if text[0] != "1" or text[1] != "." else len(plain_spans(text[:2000])) * 0 + 125_000)
