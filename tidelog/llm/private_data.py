r"""Personal data: fixed patterns, and spans that a semi-Markov conditional random field adds.

The patterns (`base_spans`) give spans of four kinds; a match that fails its check (digits, Luhn, parts) is dropped
whole, so what stands next to other digits is lost: of a phone number followed by an address, or two card numbers
in a row, the patterns find one of two, or nothing. The field reads such places again. It scores whole spans, not
characters: a candidate runs over at most SPAN_ATOMS atoms (runs of digits, runs of letters, single characters),
SPAN_GROUPS runs of digits and SPAN_DIGITS digits, and its features are those of the span as one: its shape, how many
digits, checks that it passes, its first character, and what stands on both sides. Dynamic programming over the spans
that end at each atom chooses boundaries and kinds of all spans of a place together; atoms in no span score 0. Only
spans that pass their kind's check are added, and only where they score LEAST_PART of what all but a LEAST_SHARE of the
spans learned from reach: what is unlike everything in the sample is left alone.

Training is by labels that the patterns give: places where their spans do not overlap and no match is longer than
its kind allows, at most PLACES of each kind (and as many without a span), and pairs of these set side by side, whose
boundaries are known. Each place is learned from with and without its shapes, so that unseen shapes are judged by
the rest. The driver holds the sample only; the weights, some thousand numbers, go to the tasks.

Texts are read once: base spans and candidate places (a few characters a document) are written to the shared
folder, from which the sample is taken and in which all places are scored. No row is shuffled.

Defined results: a null or empty text has no spans. Added spans overlap no base span and no other added span;
base spans of different kinds may overlap each other. Spans beyond the bounds of a candidate are found by the
patterns only. Repeated rows give equal rows. Where the patterns find nothing in the whole table, nothing is added. An empty table gives no rows. Other
columns of the input are neither read nor returned, whatever their names. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidelog.llm.common import class_sample, materialize, read_table

KINDS = ["email", "ip", "card", "phone"]
#: Bounds of a candidate span.
SPAN_ATOMS, SPAN_GROUPS, SPAN_DIGITS, LEAST_DIGITS = 40, 8, 19, 4
#: Characters on each side of an @ that belong to its place.
REACH = 64
#: An added span scores at least so much of the score that all but this share of the sample's spans of its kind reach.
LEAST_PART, LEAST_SHARE = 0.6, 0.02
#: Places learned from, of each kind and without a span; longer ones are not learned from.
PLACES, PLACE_CHARS = 400, 200
JOINED = 400
ROUNDS, RATE, PENALTY = 60, 0.15, 0.02
#: Scored spans a task remembers.
REMEMBERED = 200_000

# The patterns of the base, with possessive counts where nothing can be given back.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

DIGITS = re.compile(r"[0-9]+")
NUMERIC = re.compile(r"(?<![+(])[+(]*+[0-9][0-9 ().+-]*")
ATOM = re.compile(r"[0-9]+|[^\W\d_]+|.", re.DOTALL)
AROUND = re.compile(r"[\w.%+-]*")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def small_parts(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each run of local characters before an @ with a domain behind it. A run is read once, whatever its length."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(kind, start, end) of the matches that pass, by start and kind; and the matches that are too long for their kind."""
    out, long = [(0, a, b) for a, b in emails(text)], []
    out += [(1, *m.span()) for m in IP.finditer(text) if small_parts(m[0])]
    for kind, pattern, least, most in ((2, CARD, 12, 19), (3, PHONE, 9, 15)):
        for m in pattern.finditer(text):
            n = len(m[0]) if m[0].isdigit() else sum(map(len, DIGITS.findall(m[0])))
            if n > most:
                long.append(m.span())
            elif n >= least and (kind == 3 or luhn("".join(DIGITS.findall(m[0])))):
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], s[0], s[2])), long


def places(text: str) -> list[tuple[int, int]]:
    """Where candidate spans may lie: runs of digits and what stands between them, and what surrounds an @; merged where they touch."""
    found = []
    for m in NUMERIC.finditer(text):
        if m.end() - m.start() > LEAST_DIGITS and sum(map(len, DIGITS.findall(m[0]))) > LEAST_DIGITS:
            found.append((m.start(), m.start() + len(m[0].rstrip(" (.+-"))))
    found += emails(text)
    at = text.find("@")
    while at >= 0:
        before, after = AROUND.match(text[max(0, at - REACH) : at][::-1]), AROUND.match(text, at + 1, at + 1 + REACH)
        if before[0] and after[0]:
            found.append((at - len(before[0]), after.end()))
        at = text.find("@", at + 1)
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Place(NamedTuple):
    """A place in a text with a character on each side (empty at the ends of the text)."""

    text: str
    left: str
    right: str


def side(c: str) -> str:
    return "end" if not c else "space" if c in " \t\n\r\f\v" else "digit" if c in "0123456789" else "letter" if c.isalpha() else c if c in "+-.()@" else "mark"


def passed(text: str) -> list[int]:
    """The kinds whose check a span passes."""
    if "@" in text:
        return [0] if "." in text.partition("@")[2] else []
    groups = DIGITS.findall(text)
    n = sum(map(len, groups))
    out = [1] if len(groups) == 4 and text.count(".") == 3 and n + 3 == len(text) and small_parts(text) else []
    if 12 <= n <= 19 and text[0] not in "+(" and luhn("".join(groups)):
        out.append(2)
    return [*out, 3] if text[0] == "+" and 9 <= n <= 15 else out


def candidates(place: Place) -> tuple[list[int], list[tuple[int, int]]]:
    """Where atoms begin (and the end), and candidate spans as ranges of atoms."""
    atoms = ATOM.findall(place.text)
    at = [0]
    for x in atoms:
        at.append(at[-1] + len(x))
    digits = [len(x) if x[0] in "0123456789" else 0 for x in atoms]
    found = []
    for i, x in enumerate(atoms):
        if digits[i] or x in "+(":  # numbers
            n = groups = 0
            for j in range(i, min(len(atoms), i + SPAN_ATOMS)):
                y = atoms[j]
                if not digits[j] and (y not in " ().+-" or y == "+" and j > i):
                    break
                n, groups = n + digits[j], groups + (digits[j] > 0)
                if n > SPAN_DIGITS or groups > SPAN_GROUPS:
                    break
                if digits[j] and (n >= 9 or groups == 4 and n >= LEAST_DIGITS):
                    found.append((i, j + 1))
        if x == "@":
            half, lefts, rights = SPAN_ATOMS // 2, [], []
            for k in range(i - 1, max(-1, i - half), -1):
                if not (atoms[k].isalnum() or atoms[k] in LOCAL):
                    break
                lefts.append(k)
            for k in range(i + 1, min(len(atoms), i + half)):
                if not (atoms[k].isalnum() or atoms[k] in ".-"):
                    break
                if atoms[k] not in ".-":
                    rights.append(k + 1)
            found += [(a, b) for a in lefts for b in rights]
    return at, sorted(set(found))


def features(place: Place, a: int, b: int) -> tuple[str, ...]:
    """Of the span place.text[a:b] as a whole; the first is its shape."""
    text = place.text[a:b]
    before = place.text[a - 1] if a else place.left
    after = place.text[b] if b < len(place.text) else place.right
    sides = (f"left {side(before)}", f"right {side(after)}", f"sides {side(before)} {side(after)}")
    if "@" in text:
        name, _, host = text.partition("@")
        labels = host.split(".")
        shape = re.sub(r"[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", text))
        last = labels[-1]
        return (f"shape {shape}", "at", f"labels {min(len(labels), 4)}", f"last {'letters' if last.isalpha() else 'other'} {min(len(last), 4)}", f"name {'long' if len(name) > 1 else 'short'}", *sides)
    groups = DIGITS.findall(text)
    digits = "".join(groups)
    n, first = len(digits), text[0] if text[0] in "+(" else "digit"
    marks = "".join(sorted(set(re.sub("[0-9]", "", text))))
    dotted = text.count(".") == 3 and len(groups) == 4 and marks == "." and ".." not in text
    check = luhn(digits) if 12 <= n <= 19 else None
    beyond = place.text[b + 1] if b + 1 < len(place.text) else ""
    return (
        "shape " + DIGITS.sub(lambda m: str(len(m[0])), text), f"digits {n}", f"first {first}", f"marks {marks}", f"luhn {check}", f"luhn {check} {marks}", f"dotted {dotted and small_parts(text)}",
        f"first {first} digits {min(n, 16)}", f"groups {min(len(groups), 6)}", f"even {len(set(map(len, groups[:-1]))) <= 1}", f"goes on {after in '-.' and beyond.isdigit() if after else False}", *sides,
    )


class Field:
    """Weights of features by kind. Score of a span of a kind: the sum of its features' weights."""

    def __init__(self, names: list[str]) -> None:
        self.at = {n: k for k, n in enumerate(names)}
        self.weight = np.zeros((len(names) + 1, len(KINDS)))  # the last: of a shape not seen
        self.least = np.zeros(len(KINDS))
        self.known: dict[tuple, np.ndarray] = {}

    def rows(self, of: tuple[str, ...], shape: bool = True) -> list[int]:
        unseen = len(self.at)
        return [self.at.get(of[0], unseen) if shape else unseen, *(self.at[f] for f in of[1:] if f in self.at)]

    def scores(self, of: tuple[str, ...]) -> np.ndarray:
        if of not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[of] = self.weight[self.rows(of)].sum(0)
        return self.known[of]

    def best(self, place: Place, taken: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(kind, start, end) of the best set of spans that touch none of the taken ranges."""
        at, spans = candidates(place)
        ends: dict[int, list[tuple[float, int, int]]] = defaultdict(list)
        for i, j in spans:
            if any(at[i] < e and s < at[j] for s, e in taken):
                continue
            if kinds := passed(place.text[at[i] : at[j]]):
                s = self.scores(features(place, at[i], at[j]))
                kind = max(kinds, key=lambda k: s[k])
                if s[kind] > 0 and s[kind] >= self.least[kind]:
                    ends[j].append((float(s[kind]), i, kind))
        if not ends:
            return []
        total, back = [0.0], [None]
        for j in range(1, len(at)):
            top, how = total[-1], None
            for s, i, kind in ends.get(j, ()):
                if total[i] + s > top:
                    top, how = total[i] + s, (kind, i)
            total.append(top)
            back.append(how)
        out, j = [], len(at) - 1
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                kind, i = back[j]
                out.append((kind, at[i], at[j]))
                j = i
        return out[::-1]


class Lattice(NamedTuple):
    """A place to learn from: spans by end, their feature rows, and which (span, kind) are right; weight: how often."""

    atoms: int
    spans: list[tuple[int, int]]
    rows: list[list[int]]
    right: list[tuple[int, int]]


def lattice(field: Field, place: Place, gold: list[tuple[int, int, int]], shape: bool) -> Lattice | None:
    at, spans = candidates(place)
    index = {(at[i], at[j]): k for k, (i, j) in enumerate(spans)}
    if not spans or any((a, b) not in index for _, a, b in gold):
        return None
    return Lattice(len(at) - 1, spans, [field.rows(features(place, at[i], at[j]), shape) for i, j in spans], [(index[a, b], kind) for kind, a, b in gold])


def expected(x: Lattice, score: np.ndarray) -> tuple[float, np.ndarray]:
    """log of the sum over all segmentations, and the probability of each (span, kind): forward and backward over atoms."""
    whole = np.logaddexp.reduce(score, axis=1).tolist()
    ends, begins = defaultdict(list), defaultdict(list)
    for k, (i, j) in enumerate(x.spans):
        ends[j].append((i, k))
        begins[i].append((j, k))

    def log_sum(values: list[float]) -> float:
        top = max(values)
        return top + math.log(sum(math.exp(v - top) for v in values))

    forward = [0.0] * (x.atoms + 1)
    for j in range(1, x.atoms + 1):
        forward[j] = log_sum([forward[j - 1], *(forward[i] + whole[k] for i, k in ends[j])])
    backward = [0.0] * (x.atoms + 1)
    for i in range(x.atoms - 1, -1, -1):
        backward[i] = log_sum([backward[i + 1], *(backward[j] + whole[k] for j, k in begins[i])])
    z = forward[-1]
    return z, np.exp(score + np.array([forward[i] + backward[j] for i, j in x.spans])[:, None] - z)


def fit(sample: list[tuple[Place, list[tuple[int, int, int]]]]) -> Field | None:
    """Weights of largest penalised likelihood of the sample's spans; None where it has none. Equal places count together."""
    sample = [(p, sorted(g, key=lambda s: s[1])) for p, g in sample]
    whole = [(p, g) for p, g in sample if g]
    if not whole:
        return None
    for k in range(min(JOINED, len(whole) ** 2)):  # pairs side by side, each place with many others
        (p, g), (q, h) = whole[k % len(whole)], whole[(k * 7919 + k // len(whole) + 1) % len(whole)]
        joined = Place(p.text + " " + q.text, p.left, q.right)
        sample.append((joined, g + [(kind, a + len(p.text) + 1, b + len(p.text) + 1) for kind, a, b in h]))
    seen = Counter(f for p, _ in sample for at, spans in [candidates(p)] for i, j in spans for f in set(features(p, at[i], at[j])))
    field = Field(sorted(f for f, n in seen.items() if n > 1))
    count: Counter = Counter()
    made: dict[tuple, Lattice] = {}
    for p, g in sample:
        for shape in (True, False):
            if (x := lattice(field, p, g, shape)) is not None:
                key = (x.atoms, tuple(x.spans), tuple(map(tuple, x.rows)), tuple(x.right))
                made[key] = x
                count[key] += 1
    total = sum(count.values())
    m, v = np.zeros_like(field.weight), np.zeros_like(field.weight)
    for step in range(1, ROUNDS + 1):
        grad = PENALTY * field.weight
        for key, x in made.items():
            share = count[key] / total * 100
            p = expected(x, np.stack([field.weight[r].sum(0) for r in x.rows]))[1]
            for k, kind in x.right:
                p[k, kind] -= 1
            for r, g in zip(x.rows, p):
                grad[r] += share * g
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        field.weight -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    for kind in range(len(KINDS)):
        scores = sorted(float(field.scores(features(p, a, b))[kind]) for p, g in sample for k, a, b in g if k == kind)
        field.least[kind] = LEAST_PART * scores[int(LEAST_SHARE * len(scores))] if scores else math.inf
    return field


SPAN = "struct<kind:int,start:int,stop:int>"
PLACE = "struct<start:int,text:string,lead:string,trail:string,learn:boolean>"


def find_places(docs: DataFrame) -> DataFrame:
    """doc_id, base (its base spans) and places of every text, in one pass."""
    id_type = docs.schema["doc_id"].dataType
    kinds = pa.list_(pa.struct([(c, pa.int32()) for c in ("kind", "start", "stop")]))
    parts = pa.list_(pa.struct([("start", pa.int32()), ("text", pa.string()), ("lead", pa.string()), ("trail", pa.string()), ("learn", pa.bool_())]))
    arrow_id = to_arrow_type(id_type)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, found = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                spans, long = base_spans(text)
                base.append([{"kind": k, "start": a, "stop": b} for k, a, b in spans])
                mine = []
                for a, b in places(text):
                    inside = [s for s in spans if s[1] < b and a < s[2]]
                    clear = all(s[2] <= t[1] for s, t in zip(inside, inside[1:])) and all(a <= s[1] and s[2] <= b for s in inside)
                    learn = b - a <= PLACE_CHARS and clear and not any(x < b and a < y for x, y in long)
                    mine.append({"start": a, "text": text[a:b], "lead": text[a - 1 : a] if a else "", "trail": text[b : b + 1], "learn": learn})
                found.append(mine)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(arrow_id), pa.array(base, kinds), pa.array(found, parts)], ["doc_id", "base", "places"])

    return docs.select("doc_id", "text").mapInArrow(find, f"doc_id {id_type.simpleString()}, base array<{SPAN}>, places array<{PLACE}>")


def train(found: DataFrame) -> Field | None:
    """The field of the places of find_places. At most PLACES of each kind of first span, and as many without one, lowest hash first."""
    one = found.select("doc_id", "base", F.explode("places").alias("p")).filter("p.learn")
    mine = F.filter("base", lambda s: (s["start"] >= F.col("p.start")) & (s["stop"] <= F.col("p.start") + F.length("p.text")))
    spans = F.transform(mine, lambda s: F.struct(s["kind"].alias("kind"), (s["start"] - F.col("p.start")).alias("a"), (s["stop"] - F.col("p.start")).alias("b")))
    rows = one.select(F.coalesce(F.get(mine, F.lit(0))["kind"], F.lit(-1)).alias("first"), F.to_json(F.struct("doc_id", "p.start", "p.text")).alias("key"), "p.text", "p.lead", "p.trail", spans.alias("spans"))
    picked = class_sample(rows, "first", PLACES, "key").orderBy("first", F.xxhash64("key"), "key").collect()
    return fit([(Place(r.text, r.lead, r.trail), [(s.kind, s.a, s.b) for s in r.spans]) for r in picked])


def add_spans(found: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, base, and added: the spans that the field finds beside the base, by start."""
    kinds = pa.list_(pa.struct([(c, pa.int32()) for c in ("kind", "start", "stop")]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            added = []
            for base, parts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                mine, at = [], 0
                for p in parts:
                    while at < len(base) and base[at]["stop"] <= p["start"]:
                        at += 1  # places and spans both go forward
                    end, taken, k = p["start"] + len(p["text"]), [], at
                    while k < len(base) and base[k]["start"] < end:
                        taken.append((base[k]["start"] - p["start"], base[k]["stop"] - p["start"]))
                        k += 1
                    for kind, a, b in field.best(Place(p["text"], p["lead"], p["trail"]), taken) if field else ():
                        mine.append({"kind": kind, "start": p["start"] + a, "stop": p["start"] + b})
                added.append(mine)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(added, kinds)], ["doc_id", "base", "added"])

    return found.mapInArrow(add, f"doc_id {found.schema['doc_id'].dataType.simpleString()}, base array<{SPAN}>, added array<{SPAN}>")


def find_private(docs: DataFrame) -> DataFrame:
    """doc_id, base and added spans (kind: a place in KINDS, start, stop) of every row."""
    found = materialize(find_places(docs), "places")
    return add_spans(found, train(found))


def written(spans: str | F.Column) -> F.Column:
    """kind:start:end by start, then kind, joined by commas."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans as counts by kind and digest, all spans as text, and the number of those added."""
    found = find_private(read_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = (count(k).alias(f"n_{name}") for k, name in enumerate(KINDS))
    return found.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"))
