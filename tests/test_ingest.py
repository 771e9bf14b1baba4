"""The derived index and the ingest that logs itself: small cases, replays, queries against SQL."""

import json
import os

import pytest
from pyspark.sql import functions as F

from foliant.operators import derived, retrieval
from foliant.plans import registry
from foliant.sources.readers import event_log
from foliant.streaming import ingest


@pytest.mark.parametrize("name", ["derived_index", "progress_events", "suspicious_cleanup"])
def test_registered_queries_against_sql(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("orders", "customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    got = registry.queries()[name](spark, d)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key) and want


PROJECTS = "client_name string, project_key string, project_name string, fields map<string,struct<value:string,status:string,method:string>>, summary string, summary_method string, answers map<string,string>"


def projects(spark, scope="all"):
    rows = [
        ("Acme", "p1", "One", {"scope": (scope, "present", ""), "date": (" ", None, "m ")}, " Title:x  Scope: y", "rules", {"b": " 2 ", "a": "1", "c": " "}),
        ("Acme", "p2", None, {}, "  ", None, None),
        (None, "p3", "Three", None, "text", "model", None),
    ]
    return spark.createDataFrame(rows, PROJECTS)


def test_texts_of_projects(spark):
    got = {r.source_document: r for r in derived.field_texts(projects(spark), ("date", "scope", "gaps")).unionByName(derived.summary_texts(projects(spark))).collect()}
    assert set(got) == {"__project_fields__/Acme/p1", "__project_summary__/Acme/p1", "__project_summary__//p3"}
    want = "Client: Acme\nProject: One\nProject key: p1\nKey fields:\n- date: Information not present (status=unknown, method=m)\n- scope: all (status=present, method=unknown)\n- gaps: Information not present (status=unknown, method=unknown)"
    assert got["__project_fields__/Acme/p1"].chunk_text == want
    want = "Client: Acme\nProject: One\nProject key: p1\nSummary method: rules\nSummary:\n{}\nQuestionnaire:\n- a: 1\n- b: 2"
    lines = got["__project_summary__/Acme/p1"].chunk_text.split("\n")
    assert "\n".join([*lines[:5], "{}", *lines[7:]]) == want and [x.split(":")[0] for x in lines[5:7]] == ["Title", "Scope"]
    assert got["__project_summary__//p3"].chunk_text.endswith("Summary:\ntext\nQuestionnaire:\n- none")


def test_only_changed_texts_are_embedded(spark):
    def texts(scope):
        p = projects(spark, scope)
        return derived.field_texts(p, ("scope",)).unionByName(derived.summary_texts(p))

    row = ("doc.txt", "Acme", "chunk", None, None, "quote", "text", None, [0.5])
    old = [row, ("__project_fields__/Acme/gone", "Acme", "left", None, None, None, None, None, [0.1]), (None, None, "lost", None, None, None, None, None, None)]
    vectors = spark.createDataFrame(old, ", ".join(f"{c} string" for c in derived.COLUMNS) + ", embedding array<double>")
    one, first = derived.refreshed(vectors, texts("all"))
    assert sorted((r.source_document, r.state) for r in first.collect()) == [("__project_fields__/Acme/p1", "added"), ("__project_summary__//p3", "added"), ("__project_summary__/Acme/p1", "added")]
    held = {r.source_document: r for r in one.collect()}
    assert len(held) == 6 and held["doc.txt"].embedding == [0.5] and held["__project_fields__/Acme/gone"].chunk_text == "left"
    assert all(held[p].embedding == pytest.approx(retrieval.hash_embedding(held[p].chunk_text)) for p in ("__project_fields__/Acme/p1", "__project_summary__//p3"))
    # A second run changes nothing: a marked vector stays.
    marked = one.withColumn("embedding", F.array(F.lit(7.0)))
    two, none = derived.refreshed(marked, texts("all"))
    assert none.count() == 0 and {r.embedding[0] for r in two.collect()} == {7.0}
    # One changed field is one changed row; several rows of one path become one.
    three, change = derived.refreshed(marked.unionByName(marked.where("source_document like '%//p3'")), texts("part"))
    assert sorted((r.source_document, r.state) for r in change.collect()) == [("__project_fields__/Acme/p1", "changed"), ("__project_summary__//p3", "changed")]
    after = [(r.source_document, r.embedding == [7.0]) for r in three.collect()]
    assert sorted(after, key=str) == sorted([("doc.txt", True), ("__project_fields__/Acme/gone", True), (None, True), ("__project_fields__/Acme/p1", False), ("__project_summary__/Acme/p1", True), ("__project_summary__//p3", False)], key=str)
    empty, nothing = derived.refreshed(vectors.limit(0), texts("all").limit(0))
    assert empty.count() == nothing.count() == 0


def test_outcomes_small(spark):
    rows = spark.createDataFrame([("a", "text", "x", None), ("a", "text", "x", None), ("b", "text", None, None), ("c", None, None, "unsupported"), ("d", "pdf", None, "broken"), ("e", "text", "known", None)], "source_path string, source_type string, text string, error string")
    known = ingest.outcomes(rows.where("source_path = 'e'"))
    got = sorted((r.source_path, r.status) for r in ingest.outcomes(rows, known).collect())
    assert got == [("a", "ingested"), ("a", "skipped_duplicate"), ("b", "ingested"), ("c", "unsupported"), ("d", "error"), ("e", "skipped_duplicate")]
    assert {r.status for r in ingest.outcomes(rows.where("error is null"), known, force=True).collect()} == {"ingested"}
    told = {}
    for r in sorted(ingest.progress_events(ingest.outcomes(rows.where("source_path in ('c', 'd', 'e')"), known)).collect(), key=lambda r: r.n):
        told.setdefault(r.path, []).append(r.event)
    assert told == {"c": ["file_unsupported"], "d": ["file_started", "file_error"], "e": ["file_started", "file_read", "file_skipped_duplicate", "file_completed"]}
    (scan, done) = sorted(ingest.folder_events(ingest.outcomes(rows, known)).collect(), key=lambda r: r.n)
    assert (scan.event, scan.total_files) == ("directory_scanned", 6) and (done.event, done.total_files, done.succeeded, done.failed) == ("directory_completed", 6, 4, 2)


def test_logged_ingest_and_replay(spark, tmp_path):
    """The log that a stream of files writes gives the run's counts, and a batch that is run again writes the same."""
    files, stored, log = (str(tmp_path / n) for n in ("in", "out", "log"))
    os.makedirs(files)
    for name, body in (("a.txt", "Quotation\nClient Name: Acme\nProject Code: P-1"), ("b.html", "<p>two"), ("c.bin", "no")):
        with open(f"{files}/{name}", "w") as f:
            f.write(body)
    rows = ingest.folder_rows(spark, files)
    q = rows.writeStream.foreachBatch(ingest.logged_ingest(stored, log)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None
    kept = {os.path.basename(r.source_path): (r.status, r.client_name, r.project_key) for r in ingest.stored_outcomes(spark, stored).collect()}
    assert kept["a.txt"] == ("ingested", "Acme", "p-1") and kept["b.html"][0] == "ingested" and kept["c.bin"][0] == "unsupported"
    counts = lambda: {r.event: r["count"] for r in event_log(spark, log + "/*").groupBy("event").count().collect()}
    first = counts()
    assert first["file_started"] == first["file_completed"] == first["document_record_saved"] == 2 and first["file_unsupported"] == first["directory_scanned"] == first["directory_completed"] == 1
    # The same batch again: nothing is a repeat of itself, nothing is counted twice.
    batch = spark.createDataFrame([(r.source_path, r.source_type, r.suffix, r.filename, r.text, r.error) for r in ingest.stored_outcomes(spark, stored).where("batch = 0").collect()], "source_path string, source_type string, suffix string, filename string, text string, error string")
    sink = ingest.logged_ingest(stored, log)
    sink(batch, 0)
    assert counts() == first
    # A later batch with the same files finds them known.
    sink(batch, 1)
    assert counts()["file_skipped_duplicate"] == 2 and ingest.stored_outcomes(spark, stored).where("status = 'ingested'").count() == 2
    lines = [json.loads(x) for p in (tmp_path / "log").rglob("part-*.json") for x in p.read_text().splitlines()]
    assert all(set(x) >= {"ts", "event"} for x in lines) and not any(isinstance(v, dict | list) for x in lines for v in x.values())
    assert {tuple(sorted(x)) for x in lines if x["event"] == "file_unsupported"} == {("error", "event", "path", "status", "ts")}
