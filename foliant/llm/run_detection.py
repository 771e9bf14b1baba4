"""Periodic runs of words: stretches that repeat one block of words over and over, by bit-parallel lags.

The words of a text are numbered, and bit ``b`` of all numbers together is one big integer, the
plane ``b``. The words ``q`` apart differ where a plane and itself shifted by ``q`` differ, so the
XORs of all planes, joined by OR, hold the mismatches of lag ``q``; their complement holds the
matches. A run of period ``q`` is a long enough stretch of matches. Such stretches are isolated by
shifting and ANDing with doubled steps: what is left marks where ``need`` matches begin.

Large lags of long texts compare blocks of the planes in place of whole planes: a stretch of
``2 q`` matches covers one block of every few, so only those are compared, and a block without a
mismatch is widened to both sides. The work of a text of n words is n times a logarithm then.
A stretch whose period is a multiple of a smaller one is the same stretch as at the smaller lag
(three periods are enough for that), so the first lag that gives a stretch names its period.

Defined results: words are runs of anything but blanks and the characters 9 to 13, compared code
point by code point; a null or empty text has no words and no runs; every row is kept for itself,
repeated rows and rows without an id included; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_CHARS, ranges

#: A run has so many words, and so many times its period, at least.
LEAST_WORDS, LEAST_TIMES = 24, 3
#: Words to a block of a plane. Lags under twice that compare whole planes.
BLOCK = 128

Run = tuple[int, int, int]


def planes_of(ids: np.ndarray) -> list[bytes]:
    """Bit planes of word numbers, lowest bit first, padded by two blocks."""
    pad = np.zeros(-len(ids) % BLOCK + 2 * BLOCK, ids.dtype)
    full = np.concatenate([ids, pad])
    return [np.packbits((full >> b & 1).astype(np.uint8), bitorder="little").tobytes() for b in range(max(1, int(ids.max()).bit_length()))]


def isolated(matches: int, need: int) -> int:
    """Bits at which ``need`` matches in a row begin."""
    have = 1
    while have < need and matches:
        step = min(have, need - have)
        matches &= matches >> step
        have += step
    return matches


def stretches(matches: int, n: int, need: int) -> Iterator[tuple[int, int]]:
    """Begin and end of every stretch of at least ``need`` matches."""
    bits = np.unpackbits(np.frombuffer(matches.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")
    edges = np.flatnonzero(np.diff(np.concatenate([[0], bits, [0]]).astype(np.int8)))
    for lo, hi in edges.reshape(-1, 2):
        if hi - lo >= need:
            yield int(lo), int(hi)


def runs_of(words: list) -> list[Run]:
    """(start, length, period) of every run, by start, then period."""
    n = len(words)
    if n < LEAST_WORDS:
        return []
    numbers: dict = {}
    planes = planes_of(np.array([numbers.setdefault(w, len(numbers)) for w in words]))
    whole = [int.from_bytes(p, "little") for p in planes]
    found: dict[tuple[int, int], int] = {}
    most = n // LEAST_TIMES
    for q in range(1, min(most, 2 * BLOCK - 1) + 1):
        need, inside = max(LEAST_WORDS - q, (LEAST_TIMES - 1) * q), (1 << n - q) - 1
        miss = 0
        for k, p in enumerate(whole):
            miss |= p ^ p >> q
            # Most lags are ruled out by a few planes.
            if k in (2, 5) and not isolated(inside & ~miss, need):
                break
        else:
            matches = inside & ~miss
            if isolated(matches, need):
                for lo, hi in stretches(matches, n, need):
                    found.setdefault((lo, hi + q), q)
    if most >= 2 * BLOCK:
        _long_lags([[int.from_bytes(p[i : i + BLOCK // 8], "little") for i in range(0, len(p), BLOCK // 8)] for p in planes], n, most, found)
    return sorted((lo, hi - lo, q) for (lo, hi), q in found.items())


def _long_lags(planes: list[list[int]], n: int, most: int, found: dict[tuple[int, int], int]) -> None:
    """Adds the runs of periods from ``2 * BLOCK`` up to ``most``."""
    mask = (1 << BLOCK) - 1
    known: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def expect(lo: int, hi: int, q: int) -> None:
        """The stretches that a run gives at the multiples of its period are no news there."""
        for m in range(q * max(2, -(-2 * BLOCK // q)), (hi - lo) // LEAST_TIMES + 1, q):
            known[m].append((lo, hi - m))

    for (lo, hi), q in found.items():
        expect(lo, hi, q)
    first = planes[0]
    for q in range(2 * BLOCK, most + 1):
        over, bit = divmod(q, BLOCK)
        last = n - q

        def miss(k: int, over=over, bit=bit, last=last) -> int:
            """Mismatches of a block; places past the end count as such."""
            out = mask & mask << max(0, last - k * BLOCK) if (k + 1) * BLOCK > last else 0
            for p in planes:
                out |= p[k] ^ (p[k + over] >> bit | p[k + over + 1] << BLOCK - bit) & mask
            return out

        upto, told = 0, known.pop(q, ())
        for k in range(0, last // BLOCK, (2 * q + 1) // BLOCK - 1):
            if first[k] ^ (first[k + over] >> bit | first[k + over + 1] << BLOCK - bit) & mask or k * BLOCK < upto:
                continue
            if any(lo <= k * BLOCK and (k + 1) * BLOCK <= hi for lo, hi in told) or miss(k):
                continue
            a, b = k - 1, k + 1
            while a >= 0 and not (left := miss(a)):
                a -= 1
            lo = 0 if a < 0 else a * BLOCK + left.bit_length()
            while not (right := miss(b)):
                b += 1
            upto = hi = b * BLOCK + (right & -right).bit_length() - 1
            if hi - lo >= (LEAST_TIMES - 1) * q and found.setdefault((lo, hi + q), q) == q:
                expect(lo, hi + q, q)


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run repeats: those of a run's first period stay."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return b" ".join([w for w, g in zip(words, np.cumsum(gone), strict=False) if not g]) if runs else b" ".join(words)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text: str = "text", prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(id, n_words, runs, collapsed) for every row: its runs by start, then period, and the text without their repeats.

    ``prepare`` may change a row's words (UTF-8) before they are looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in ranges(pc.binary_length(batch.column(1)).to_pylist(), SLICE_CHARS):
                cut = batch.slice(lo, hi - lo)
                counts, runs, kept = [], [], []
                # bytes.split() cuts at exactly the blank and the characters 9 to 13.
                for i, t in zip(cut.column(0).to_pylist(), cut.column(1).to_pylist(), strict=True):
                    words = (t or b"").split()
                    words = prepare(i, words) if prepare else words
                    got = runs_of(words)
                    counts.append(len(words))
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in got])
                    kept.append(collapsed(words, got).decode())
                struct = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(struct)), pa.array(kept, pa.string())], names=["id", "n_words", "runs", "collapsed"])

    some = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    return some.mapInArrow(run, "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The planted loops of the query: from some word on, one of ten texts repeats a stretch of itself."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def detect_all(documents: DataFrame) -> DataFrame:
    """Runs of every whole text after planted loops; a row for each document."""
    runs = find_runs(documents, prepare=looped)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    # Runs are in order, so of equal ones the first stays.
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b))
    each = runs.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
    return each.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")
