"""Vectorised hashing of words, word pairs and character n-grams of many texts at once.

Texts are lower-cased and laid out as one array of code points, each text between two
spaces. The hash of any substring comes from prefix sums of ``c[i] * B**i`` modulo
2**64 (``B`` odd, so its powers have inverses), then a finaliser. No Python loop runs
over words or characters.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _table(name: str, factor: int, n: int) -> np.ndarray:
    got = _powers.get(name)
    if got is None or len(got) < n:
        size = max(n, 1 << 20)
        steps = np.full(size, factor, np.uint64)
        steps[0] = 1
        got = np.multiply.accumulate(steps)
        if size <= 1 << 22:
            _powers[name] = got
    return got[:n]


def powers(name: str, n: int) -> np.ndarray:
    """The first ``n`` powers ("up") of the base, or of its inverse ("down")."""
    return _table(name, _BASE if name == "up" else _INVERSE, n)


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = h + np.uint64((0xD1B54A32D192ED03 * (2 * seed + 1)) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Texts:
    """Code points, word bounds and prefix hashes of a list of texts (null counts as empty)."""

    def __init__(self, texts: list[str | None]):
        # A space on either side, so that no n-gram reaches into another text and each text's first word has its border.
        parts = [f" {(t or '').lower()} ".encode("utf-32-le", "surrogatepass") for t in texts]
        self.n = len(texts)
        sizes = np.fromiter((len(p) // 4 for p in parts), np.int64, len(parts))
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        self.cp = np.frombuffer(b"".join(parts), np.uint32)
        space = (self.cp == 32) | ((self.cp >= 9) & (self.cp <= 13))
        self.space = space
        length = len(self.cp)
        codes = np.where(space, np.uint32(32), self.cp).astype(np.uint64) + np.uint64(1)
        self.prefix = np.zeros(length + 1, np.uint64)
        np.cumsum(codes * _table("up", _BASE, length + 1)[:length], out=self.prefix[1:])
        self.back = _table("down", _INVERSE, length + 1)
        edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
        self.word_start = np.flatnonzero(edge == -1)
        self.word_end = np.flatnonzero(edge == 1)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.back[start]

    def bounds(self, start: np.ndarray) -> np.ndarray:
        """Where each document's share of the ascending positions ``start`` begins, and the end."""
        return np.searchsorted(start, self.starts)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words in order, and each document's bounds in them."""
        return mix(self.span_hash(self.word_start, self.word_end), 1), self.bounds(self.word_start)

    def cores(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of every word without the ASCII punctuation at its ends; empty cores are left out."""
        c = self.cp
        letter = (c >= 128) | ((c >= 48) & (c <= 57)) | ((c >= 97) & (c <= 122))
        at = np.flatnonzero(letter)
        lo = np.searchsorted(at, self.word_start)
        hi = np.searchsorted(at, self.word_end)
        full = hi > lo
        return at[lo[full]], at[hi[full] - 1] + 1

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the character n-grams within words, a word's bordering spaces included, and bounds."""
        length = len(self.cp)
        if length < n:
            return np.zeros(0, np.uint64), np.zeros(self.n + 1, np.int64)
        ok = np.ones(length - n + 1, bool)
        for k in range(1, n - 1):
            ok &= ~self.space[k : length - n + 1 + k]
        start = np.flatnonzero(ok)
        return mix(self.span_hash(start, start + n), 2 + n), self.bounds(start)

    def repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """One constant feature for every word equal to the word before it in the same text, and bounds."""
        h = self.span_hash(self.word_start, self.word_end)
        doc = np.searchsorted(self.starts, self.word_start, side="right")
        same = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1])) + 1
        return np.full(len(same), mix(np.zeros(1, np.uint64), 9)[0]), self.bounds(self.word_start[same])


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between neighbouring bounds."""
    run = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return run[bounds[1:]] - run[bounds[:-1]]
