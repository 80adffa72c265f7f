"""Token ids of whole texts with the tokenizers library, encoding each distinct unit of text once.

A unit is a stretch of text that the tokenizer's own pre-tokenizer never joins with its neighbours,
so the ids of a text are the ids of its units in order (tests compare with whole texts):

* `byte` (pieces with the blank in front): cut before a single blank, and around a single line feed,
  between characters that are no white space;
* `word` (words without white space): cut at ASCII white space;
* either is cut once more between a letter and the punctuation that ends it.

Ids of units are remembered for all tasks of a Python worker, in two generations of BOUND units. New
units of letters alone are one piece each for the pre-tokenizer: many of them are encoded as one text
and told apart by the ids that begin (or end) a piece; where their number is not that of the units
(letters that normalization turns into marks), and for other units, each is encoded alone.
"""

from __future__ import annotations

import os
import re
import sys
import types
from array import array

import numpy as np

from tidelog.llm.text import HashedWords, spans

CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space other than blanks and line feeds.
OTHER = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
ENDS = ".,;:!?"
#: How the vocabularies write a blank in front of a piece, and the end of a word.
BLANK, END_OF_WORD = "\u0120", "</w>"
BOUND = 500_000
#: Units of letters that are encoded as one text.
TOGETHER = 200


def as_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit ids."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


END_ID = as_bytes([0])


def vocabulary(name: str) -> str:
    """Place of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def is_odd(text: str) -> bool:
    """Whether there is white space other than single blanks and line feeds between other characters."""
    return text[:1] in (" ", "\n") or text[-1:] in (" ", "\n") or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or any(c in text for c in OTHER)


class Memory:
    """Ids of units that all stand behind the same prefix.

    begins, ends: for each id, whether it begins (ends) a piece of letters behind this prefix; neither where units are encoded alone.
    """

    def __init__(self, encode, prefix: str = "", begins: np.ndarray | None = None, ends: np.ndarray | None = None):
        self.encode, self.prefix, self.begins, self.ends = encode, prefix, begins, ends
        self.young: dict = {}
        self.old: dict = {}
        self.tails: dict[str, bytes] = {}

    def alone(self, texts: list[str]) -> list[bytes]:
        return [as_bytes(e.ids) for e in self.encode(texts, add_special_tokens=False)]

    def together(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, each behind the prefix."""
        if self.begins is None and self.ends is None:
            return self.alone([self.prefix + w for w in words])
        out: list[bytes] = []
        groups = [words[k : k + TOGETHER] for k in range(0, len(words), TOGETHER)]
        for group, e in zip(groups, self.encode([self.prefix + " ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            b = ids.tobytes()
            at = [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()] if self.begins is None else [*(4 * np.flatnonzero(self.begins[ids])).tolist(), len(b)]
            if len(at) == len(group) + 1 and at[0] == 0 and at[-1] == len(b):
                out += [b[x:y] for x, y in zip(at, at[1:])]
            else:
                out += self.alone([self.prefix + w for w in group])
        return out

    def look_up(self, texts: list[list]) -> list[list[bytes]]:
        """Ids of the units of several texts; what is new in all of them is encoded together."""
        got = [list(map(self.young.get, units)) for units in texts]
        gaps = [[i for i, g in enumerate(row) if g is None] if None in row else () for row in got]
        new = {units[i] for units, gap in zip(texts, gaps) for i in gap}
        if new:
            self.learn(new)
            for units, row, gap in zip(texts, got, gaps):
                for i in gap:
                    row[i] = self.young[units[i]]
        return got

    def learn(self, new: set) -> None:
        if len(self.young) > BOUND:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        kept = {u: ids for u in new if (ids := old.get(u)) is not None} if old else {}
        young.update(kept)
        units = [u for u in new if u not in kept]
        # bytes are words without white space
        texts = b"\n".join(units).decode("utf-8", "replace").split("\n") if units and isinstance(units[0], bytes) else units
        letters: dict = {}
        odd: dict = {}
        ended: list[tuple] = []
        for u, t in zip(units, texts):
            if t.isalpha():
                letters[u] = t
                continue
            stem = t.rstrip(ENDS)
            if len(stem) < len(t) and stem and stem[-1].isalpha() and stem[-1] <= "ÿ":  # beyond, lower case may end in a mark
                key = u[: len(stem) - len(t)]
                ended.append((u, key, t[len(stem) :]))
                if key not in young:
                    if key in old:
                        young[key] = old[key]
                    else:
                        (letters if stem.isalpha() else odd)[key] = stem
            else:
                odd[u] = t
        if letters:
            young.update(zip(letters, self.together(list(letters.values()))))
        if odd:
            young.update(zip(odd, self.alone([self.prefix + t for t in odd.values()])))
        tails = list({tail for *_, tail in ended} - self.tails.keys())
        if tails:
            self.tails.update(zip(tails, self.alone(tails)))
        for u, key, tail in ended:
            young[u] = young[key] + self.tails[tail]


class Encoder:
    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True  # control strings in a text are ordinary text
        self.kind = kind
        encode, pieces = tokenizer.encode_batch_fast, tokenizer.get_vocab()
        begins, ends = np.zeros((2, max(pieces.values()) + 1), bool)
        for piece, k in pieces.items():
            begins[k], ends[k] = piece[0] == BLANK, piece.endswith(END_OF_WORD)
        self.bare = Memory(encode, ends=ends if kind == "word" else None)
        self.spaced = Memory(encode, " ", begins=begins)
        self.hashed = HashedWords()
        self.line_feed = as_bytes(tokenizer.encode("\n", add_special_tokens=False).ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, with the end id 0."""
        if self.kind == "word":
            # ASCII capitals fold in the tokenizer anyway; folded first, fewer units differ
            return self.words_of([(t or "").encode("utf-8", "replace").lower() for t in texts])
        odd = {i for i, t in enumerate(texts) if t and is_odd(t)}  # white space of several characters is a matter of the tokenizer
        cut = [CUT.split(texts[i]) for i in odd]
        units = zip(self.bare.look_up([p[:1] for p in cut]), self.spaced.look_up([p[1:] for p in cut]))
        out = dict(zip(odd, (b"".join(a + b) + END_ID for a, b in units)))
        rest = [i for i in range(len(texts)) if i not in odd]
        out.update(zip(rest, self.words_of([(texts[i] or "").encode("utf-8", "replace") for i in rest])))
        return [out[i] for i in range(len(texts))]

    def words_of(self, raws: list[bytes]) -> list[bytes]:
        """Ids of texts whose units are their words, each distinct word looked up once.

        For `byte` a word behind a blank is a unit with it, one behind a line feed follows the line feed's id.
        """
        flat, first, last, size = spans(raws)
        begin = np.cumsum(size) - size
        h = self.hashed.hashes(np.frombuffer(flat, np.uint8), first, last)
        place = np.zeros(len(first), np.uint64)  # 0: first of a text (or `word`), 1: behind a line feed, 2: behind a blank
        if self.kind != "word":
            place[:] = np.where(np.frombuffer(flat, np.uint8)[first - 1] == 10, 1, 2)
            place[begin[size > 0]] = 0
            h = h ^ (place * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(h)
        new = np.ones(len(h), bool)
        new[1:] = h[order[1:]] != h[order[:-1]]
        of = np.empty(len(h), np.int64)
        of[order] = np.cumsum(new) - 1
        one = order[new]
        units = [flat[a:b] for a, b in zip(first[one].tolist(), last[one].tolist())]
        if self.kind == "word":
            ids = self.bare.look_up([units])[0]
        else:
            where = place[one].tolist()
            bare, spaced = self.bare.look_up([[u for u, k in zip(units, where) if k < 2]])[0], self.spaced.look_up([[u for u, k in zip(units, where) if k == 2]])[0]
            bare, spaced = iter(bare), iter(spaced)
            ids = [next(spaced) if k == 2 else self.line_feed + next(bare) if k else next(bare) for k in where]
        # every text's units, then the end id: as one more unit behind the distinct ones
        ids.append(END_ID)
        count = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        held = np.frombuffer(b"".join(ids), "<u4")
        of = np.insert(of, np.cumsum(size), len(ids) - 1)
        n = count[of]
        upto = np.cumsum(n)
        picked = held[np.repeat((np.cumsum(count) - count)[of] - (upto - n), n) + np.arange(int(n.sum()))].tobytes()
        ends = (4 * upto[np.cumsum(size + 1) - 1]).tolist()
        return [picked[a:b] for a, b in zip([0, *ends], ends)]


def encoder(path: str, kind: str) -> Encoder:
    """The Python worker's encoder of this file, kept from task to task until a task of another operator comes (`common.lean`)."""
    kept = sys.modules.setdefault("_tidelog_worker", types.ModuleType("_tidelog_worker")).__dict__.setdefault("encoders", {})
    if (path, kind) not in kept:
        kept[(path, kind)] = Encoder(path, kind)
    return kept[(path, kind)]
