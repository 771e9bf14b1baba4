"""BM25 by postings against the pool form, the grid of queries and vectors against the broadcast one."""

import random

from pyspark.sql import functions as F

from foliant.operators import retrieval
from foliant.plans import registry


def test_postings_give_the_pool_s_numbers(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "POSTINGS", 7)
    rng = random.Random(1)
    words = "pump valve the harbour crane boiler roof for drain weld x9 a".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))) for i in range(120)]
    df = spark.createDataFrame(rows, "row_id long, chunk_text string")
    asked = df.where("row_id % 9 = 0").select(F.col("row_id").alias("query_id"), F.col("chunk_text").alias("q"))
    want = {(r.query_id, r.row_id): r.lexical for r in retrieval.bm25(df.crossJoin(asked), "query_id", "row_id", "chunk_text", "q").collect()}
    found = retrieval.bm25_postings(df.unionByName(df.limit(0)), asked)
    got = {(r.query_id, r.row_id): r.lexical for r in found.collect()}
    assert got.keys() == want.keys() and len(got) > 500 and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    nulls = spark.createDataFrame([(1, None), (2, "pump")], "row_id long, chunk_text string")
    assert [tuple(r) for r in retrieval.bm25_postings(nulls, nulls.select(F.col("row_id").alias("query_id"), F.col("chunk_text").alias("q"))).collect()] == [(2, 2, 1.0)]


def test_grid_gives_the_same_candidates(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(300)]
    v = spark.createDataFrame(rows, "row_id long, embedding array<double>")
    q = v.where("row_id % 5 = 0").select(F.col("row_id").alias("query_id"), F.col("embedding").alias("q"))
    want = sorted(tuple(r) for r in retrieval.candidates(q, v, 6).select("query_id", "row_id", "rank", "cos").collect())
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 20)
    monkeypatch.setattr(retrieval, "PART", 40)
    grid = retrieval.candidates(q, v, 6)
    assert sorted(tuple(r) for r in grid.select("query_id", "row_id", "rank", "cos").collect()) == want and len(want) == 360
    assert set(grid.columns) == {"row_id", "embedding", "query_id", "q", "cos", "rank"}


def test_best_documents_against_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    got = registry.queries()["bm25_documents"](spark, d)
    want = con.execute(f"SELECT query_id, doc_id, lexical FROM ({registry.oracle_sql()['bm25_documents']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) == 40
