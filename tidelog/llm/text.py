"""Words and hashes of texts, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Words separated by ASCII white space, ASCII capitals in lower case: bytes.lower().split().
#: Runs of ASCII letters, digits and all beyond ASCII, capitals in lower case:
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b > 127 else 32 for b in range(256))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    BOUND = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Bytes that separate words, and bytes hashed side by side.
BLANKS = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BLOCK = 1 << 19
#: Longer words are hashed one by one: a polynomial mod 2**64 is the same for some pairs of long repetitive words, whatever its point and values.
LONG = 64


class HashedWords:
    """64-bit hashes of all words of many texts, worked out side by side from their bytes.

    A word's hash is the polynomial of its bytes' random values at a random odd point (mod 2**64),
    mixed: prefix sums over a block give every word's polynomial times the power at its begin, which
    the inverse power takes off. Words of more than LONG bytes get the hash of their bytes instead.
    """

    def __init__(self) -> None:
        rng = np.random.default_rng(20240229)
        self.value = rng.integers(0, 1 << 64, 256, np.uint64) | np.uint64(1)
        self.point = int(rng.integers(0, 1 << 62)) * 4 + 3
        self.power, self.inverse = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.power) < n:
            for name, base in (("power", self.point), ("inverse", pow(self.point, -1, 1 << 64))):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x))

    def of(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words (runs of other bytes than BLANKS) of all texts, text by text, and how many each has."""
        flat, first, last, size = spans(raws)
        return self.hashes(np.frombuffer(flat, np.uint8), first, last), size

    def hashes(self, flat: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of the words flat[first:last], given in order."""
        out = np.empty(len(first), np.uint64)
        at = 0
        while at < len(first):
            to = max(at + 1, int(np.searchsorted(last, first[at] + BLOCK, "right")))
            begin, end = int(first[at]), int(last[to - 1])
            self.grow(max(BLOCK, end - begin) + 1)
            total = np.zeros(end - begin + 1, np.uint64)
            np.cumsum(self.value[flat[begin:end]] * self.power[: end - begin], out=total[1:])
            out[at:to] = (total[last[at:to] - begin] - total[first[at:to] - begin]) * self.inverse[first[at:to] - begin]
            at = to
        out = mix(out)
        for k in np.flatnonzero(last - first > LONG):
            out[k] = xxhash.xxh64_intdigest(flat[first[k] : last[k]].tobytes())
        return out


def spans(raws: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one, each behind a line feed; begin and end of every word in it; and how many words each text has."""
    flat = b"\n" + b"\n".join(raws) + b"\n"
    edge = np.flatnonzero(np.diff(BLANKS[np.frombuffer(flat, np.uint8)]))
    first, last = edge[::2] + 1, edge[1::2] + 1
    ends = np.cumsum([0, *(len(b) + 1 for b in raws)])  # of each text
    return flat, first, last, np.diff(np.searchsorted(first, ends, "right"))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of a public 64-bit generator)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def join_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the pair (a, b)."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(32))))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, from the words' hashes."""
    out = h[: len(h) - n + 1]
    for k in range(1, n):
        out = join_hashes(out, h[k : len(h) - n + 1 + k])
    return out


def rows(batches: Iterator[pa.RecordBatch], *cols: str) -> Iterator[tuple]:
    """Python values of the named columns, row by row."""
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in cols))


def raw(text: str | bytes | None) -> bytes:
    return b"" if text is None else text if isinstance(text, bytes) else text.encode("utf-8", "replace")
