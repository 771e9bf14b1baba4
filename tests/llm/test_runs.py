"""Periodic runs against a plain search over all starts and periods."""

import hashlib
import random
import time
import zlib
from fractions import Fraction

from foliant.llm import run_detection


def plain_runs(words):
    """Every maximal stretch for each period; a stretch that a smaller period gives is left to it."""
    n, seen, out = len(words), set(), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j + q - i, q))
            i = max(j, i + 1) if j > i else i + 1
    return sorted(out)


def plain_row(doc_id, text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    n = len(words)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(kept)), n)


def random_words(rng, n):
    words = []
    while len(words) < n:
        block = [rng.choice("abcdefgh"[: rng.randrange(1, 9)]) for _ in range(rng.randrange(1, 60))]
        words += (block * rng.randrange(1, 9))[: rng.randrange(1, 400)]
    return words[:n]


def test_runs_against_plain_search():
    rng = random.Random(5)
    for k in range(300):
        words = random_words(rng, rng.randrange(0, 500))
        assert run_detection.runs_of(words) == plain_runs(words), k


def test_long_lags_against_plain_search():
    """Periods beyond two blocks, repeats of repeats, passages that recur without a run."""
    rng = random.Random(6)
    for k in range(25):
        block = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(200, 700))]
        inner = ["x", "y", "z"][: rng.randrange(1, 4)] * rng.randrange(1, 200)
        words = block * rng.randrange(1, 6) + block[: rng.randrange(len(block))] + inner + (block[:150] + inner) * rng.randrange(1, 5) + random_words(rng, 200)
        assert run_detection.runs_of(words) == plain_runs(words), k
    assert run_detection.runs_of(["a"] * 3000) == [(0, 3000, 1)]
    assert run_detection.runs_of((["a"] * 999 + ["b"]) * 4) == plain_runs((["a"] * 999 + ["b"]) * 4)


def test_very_long_texts_take_no_square_time():
    rng = random.Random(7)
    began = time.time()
    assert run_detection.runs_of(["w"] * 400_000) == [(0, 400_000, 1)]
    words = [rng.randrange(5000) for _ in range(60_000)] * 4
    assert run_detection.runs_of(words) == [(0, 240_000, 60_000)]
    assert time.time() - began < 60


def test_query_against_plain_rows(spark, odd_rows):
    rng = random.Random(8)
    rows = [(r[0], r[1]) for r in odd_rows if not (r[1] or "").startswith("x x")] + [(100 + i, " ".join(random_words(rng, rng.randrange(0, 200)))) for i in range(120)] + [(300, "é é b\x0bc " * 20), (301, "x " * 700), (None, "q r " * 40)]
    got = run_detection.detect_all(spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, runs long, id string"))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((plain_row(*r) for r in rows), key=key)
    assert sum(r.n_runs for r in got.collect()) > 50
    assert got.dtypes[:8] == [("doc_id", "bigint"), ("n_runs", "bigint"), ("start", "bigint"), ("length", "bigint"), ("period", "bigint"), ("exponent_milli", "bigint"), ("runs_sha256", "string"), ("collapsed_sha256", "string")]


def test_empty_table(spark, empty_docs):
    assert run_detection.detect_all(empty_docs).count() == 0
