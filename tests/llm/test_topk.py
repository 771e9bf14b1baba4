"""Exact top-k against all scores of small tables."""

import math
import random

import numpy as np
import pytest

from foliant.llm import exact_topk
from foliant.llm.exact_topk import Settings, search, search_all

SCHEMA = "vec_id long, embedding array<float>, score long"


def plain(rows, is_query, k=10):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(1024 * float(np.float32(x))) for x in v]
            good[i] = min(good.get(i, w), w)
    out = []
    for q, v in good.items():
        if is_query(q):
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in good.items() if i != q)
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 7) for i, v in rows], SCHEMA)


def test_against_all_scores(spark):
    rng = random.Random(1)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.3) for c in centres[i * 5 // 1500]]) for i in range(1500)]
    rows += [(i, rows[7][1]) for i in range(1500, 1900)]
    rows += [(2000, None), (2100, []), (2200, [1.0, None]), (2300, [float("nan")] * 6), (2400, [float("inf")] * 6), (None, [1.0] * 6), (2500, [0.0] * 6), (2600, [9.0, -9.0]), (2700, [0.5] * 9), (7, rows[7][1]), (100, [50.0] * 6), (-300, [1.0] * 6)]
    rng.shuffle(rows)
    small = Settings(block=16, part=200, chunk=5)
    for cfg in (Settings(), small, Settings(block=16, part=200, chunk=5, summaries=0), Settings(k=3, block=7, part=90)):
        got = search(table(spark, rows), lambda i: i % 100 == 0, cfg=cfg)
        assert sorted(map(tuple, got.collect())) == plain(rows, lambda i: i % 100 == 0, cfg.k)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]


def test_few_rows_and_none(spark):
    for rows in ([], [(100, [1.0, 2.0])], [(100, [1.0, 2.0]), (101, [0.5, -3.0])], [(1, [1.0])]):
        assert sorted(map(tuple, search_all(table(spark, rows)).collect())) == plain(rows, lambda i: i % 100 == 0)


def test_large_weights_are_exact(spark):
    rows = [(i, [3.0e5 + 1024 * i, 1.0]) for i in range(0, 40)]
    assert sorted(map(tuple, search_all(table(spark, [(i, v[:1]) for i, v in rows[:20]] + [(100, [1.0])])).collect())) == plain([(i, v[:1]) for i, v in rows[:20]] + [(100, [1.0])], lambda i: i % 100 == 0)


def test_blocks_below_the_kth_score_are_not_scored(monkeypatch):
    """Rows in tight ranges: most blocks fall below the floor and their forward index isn't read."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.integers(0, 20, (256, 8)) + 1000 * np.eye(8, dtype=int)[j] for j in range(8)])
    rows = [(np.arange(b * 64, b * 64 + 64).tobytes(), x[b * 64 : b * 64 + 64].astype(np.int64).tobytes(), x[b * 64 : b * 64 + 64].max(axis=0).astype(np.int64).tobytes(), x[b * 64 : b * 64 + 64].min(axis=0).astype(np.int64).tobytes()) for b in range(32)]
    read = []
    plainly = exact_topk.Range._score
    monkeypatch.setattr(exact_topk.Range, "_score", lambda self, b, *a: read.append(b) or plainly(self, b, *a))
    (score, ids), *_ = exact_topk.Range(rows).search(x[:1].astype(np.int64), np.array([0]), np.array([np.iinfo(np.int64).min]), 10)
    all_scores = sorted((-int(s), i) for i, s in enumerate(x @ x[0]) if i)
    assert [(-int(s), int(i)) for s, i in zip(score, ids, strict=True)] == all_scores[:10]
    assert len(read) <= 4


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_sql_twin(spark, sf):
    import duckdb

    from foliant.llm.queries import TOPK_SQL, queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/{sf}/embeddings.parquet'")
    assert sorted(map(tuple, queries()["op13_exact_topk"](spark, f"/root/testdata/{sf}").collect())) == sorted(con.execute(TOPK_SQL).fetchall())
