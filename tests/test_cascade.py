"""Changes through several tables: small cases with written results, queries against SQL."""

import pytest
from pyspark.sql import functions as F

from foliant.operators import cascade
from foliant.plans import registry


@pytest.mark.parametrize("name", ["reassigned_tables", "reassigned_counts", "report_date_cascade", "node_states"])
def test_registered_queries_against_sql(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("orders", "customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got = registry.queries()[name](spark, d)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_reassign_small(spark):
    cols = "client_name string, source_path string, project_key string, project_name string, project_code string, related_references array<string>"
    docs = spark.createDataFrame([("c", "p", "old", "o", "O", ["r"]), ("d", "p", "old", "o", "O", ["r"]), ("c", None, "x", None, None, None)], cols)
    tables = {"documents": docs, "vectors": docs.withColumnRenamed("source_path", "source_document"), "versions": docs.withColumn("snapshot", F.struct(*cascade.PROJECT, F.lit(1).alias("v"))), "project_summaries": spark.createDataFrame([("c", "old"), ("c", "new"), ("d", "old"), ("c", "else")], "client_name string, project_key string")}
    tables["project_key_fields"] = tables["project_summaries"].limit(0)
    change = spark.createDataFrame([("c", " p ", "new", " ", "N", [" a ", ""], "old"), ("c", "", "no", "no", "no", [], "old")], "client_name string, source_path string, project_key string, project_name string, project_code string, related_references array<string>, old_project_key string")
    out, counts = cascade.reassign(tables, change)
    assert {(r.client_name, r.source_path, r.project_key, r.project_name, r.project_code, tuple(r.related_references or [])) for r in out["documents"].collect()} == {("c", "p", "new", None, "N", ("a",)), ("d", "p", "old", "o", "O", ("r",)), ("c", None, "x", None, None, ())}
    assert {(r.snapshot.project_key, r.snapshot.v, tuple(r.related_references or [])) for r in out["versions"].where("source_path = 'p'").collect()} == {("new", 1, ("r",))}
    assert {tuple(r) for r in out["project_summaries"].collect()} == {("d", "old"), ("c", "else")}
    assert {r.name: r.n for r in counts.collect()} == {"updated_documents": 1, "updated_vectors": 2, "updated_versions": 2, "cleared_project_summaries": 2, "cleared_project_key_fields": 0}


def test_states_small(spark):
    rows = [("c", "n", 1, 1, "p", "d1", "a"), ("c", "n", 2, 2, "q", None, "a"), ("c", "n", 3, 3, "p", None, "b"), ("c", "n", 4, 4, "p", "d2", "b"), ("c", "m", 1, 5, "z", None, "a")]
    df = spark.createDataFrame(rows, "client_name string, node_path string, ingested_at int, doc_id long, source_path string, report_date string, project_name string")
    got = {(r.node_path, r.version): (r.doc_id, r.superseded_by, [tuple(x) for x in r.source_reports]) for r in cascade.node_states(df).collect()}
    assert got == {("n", 1): (1, "q", [("p", "d1")]), ("n", 2): (2, "p", [("p", "d1"), ("q", None)]), ("n", 3): (3, "p", [("p", "d1"), ("q", None)]), ("n", 4): (4, None, [("p", "d2"), ("q", None)]), ("m", 1): (5, None, [("z", None)])}
    (n,) = cascade.node_history_by_path(cascade.node_states(df)).collect()
    assert n.node_path == "n" and [v.version for v in n.versions] == [3, 2, 1]


def test_cleanup_small(spark):
    docs = spark.createDataFrame([(1, "Acme", "in/acme.txt", "p", ["r"]), (2, "ACME", "in\\acme.txt", "p", ["r"]), (3, "Bee", "in/x.txt", "p", ["r"]), (4, "-", "in/-.txt", "p", []), (5, None, "in/none.txt", None, None)], "doc_id long, client_name string, source_path string, project_key string, related_references array<string>")
    named = spark.createDataFrame([("Acme", "in/acme.txt"), ("Acme", "else"), ("Bee", "in\\acme.txt"), (None, "in/none.txt")], "client_name string, source_document string")
    nodes = spark.createDataFrame([("Acme", "n", []), ("Bee", "n", [("in/acme.txt", "d"), ("in/x.txt", "e")]), ("Bee", "m", None)], "client_name string, node_path string, source_reports array<struct<path:string,date:string>>")
    tables = {"documents": docs, "vectors": named, "profiles": nodes, "history": nodes.select("client_name", "node_path"), "timeline": named}
    out, told = cascade.cleanup_suspicious(tables)
    key = lambda rows: sorted((tuple(r) for r in rows), key=str)
    assert key(told.select("client_name", "profiles", "history", "timeline", "vectors_cleared", "documents_deleted").collect()) == [("ACME", 0, 0, 0, 0, 0), ("Acme", 1, 1, 2, 2, 0)]
    assert key(out["vectors"].collect()) == key([(None, "in/acme.txt"), (None, "else"), ("Bee", "in\\acme.txt"), (None, "in/none.txt")])
    assert key(out["timeline"].collect()) == key([("Bee", "in\\acme.txt"), (None, "in/none.txt")])
    assert {(r.doc_id, r.client_name, r.project_key, tuple("x" if r.related_references is None else r.related_references)) for r in out["documents"].collect()} == {(1, None, None, ()), (2, None, None, ()), (3, "Bee", "p", ("r",)), (4, "-", "p", ()), (5, None, None, ("x",))}
    out, told = cascade.cleanup_suspicious(tables, documents_too=True)
    assert key(told.select("client_name", "timeline", "vectors_cleared", "documents_deleted").collect()) == [("ACME", 0, 0, 2), ("Acme", 1, 1, 0)]
    assert key(out["vectors"].collect()) == key([(None, "else"), (None, "in/none.txt")]) and {r.doc_id for r in out["documents"].collect()} == {3, 4, 5}
    assert {(r.node_path, None if r.source_reports is None else tuple(x.path for x in r.source_reports)) for r in out["profiles"].collect()} == {("n", ("in/x.txt",)), ("m", None)}
