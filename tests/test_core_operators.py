from pyspark.sql import functions as F

from foliant.operators import documents, events, grouping, resolve, retrieval, store


def test_latest_and_versions(spark):
    rows = [(1, "p", "2020-01-01", "h1", "d1", ["x"]), (2, "p", "2020-01-02", "h2", "d2", ["x", "y"]), (3, "p", "2020-01-03", "h2", "d2", ["x"]), (4, "q", "2020-01-01", "h1", None, [])]
    df = spark.createDataFrame(rows, "doc_id long, source_path string, ingested_at string, content_hash string, report_date string, authors array<string>")
    assert {r.doc_id for r in documents.latest(df).collect()} == {3, 4}
    none = F.array().cast("array<string>")
    full = df.withColumns({"report_type": F.lit("r"), "title": F.lit("t"), "document_kind": F.lit("report"), "client_name": F.lit(None).cast("string"), "contacts": none, "findings": none, "recommendations": none})
    got = {(r.path, r.version): r.changes for r in documents.versions(full).collect()}
    assert got == {("p", 1): ["Initial version captured."], ("p", 2): ["report_date changed from 'd1' to 'd2'.", "Document content changed from previous version.", "Authors added: y."], ("q", 1): ["Initial version captured."]}


def test_undated_rows(spark):
    df = spark.createDataFrame([(1, "report", None, "c", "a", []), (2, "report", "2020-01-01", "c", "b", []), (3, "quote", None, "c", "c", [])], "doc_id long, document_kind string, report_date string, client_name string, ingested_at string, contacts array<string>")
    assert [r.doc_id for r in documents.reports(df, date_from="2021-01-01").collect()] == [1]
    assert documents.reports(df, kind="quote").count() == 0
    ev = df.select(F.col("doc_id").alias("event_id"), "client_name", F.col("report_date").alias("event_date"), F.lit("2019").alias("created_at"))
    assert [r.event_id for r in documents.timeline(ev, date_from="2000").collect()] == [2]


def test_durations(spark):
    rows = [(1, "p", "file_started", 10), (2, "p", "file_completed", 12), (3, "p", "file_error", 9), (4, "q", "file_completed", 5)]
    log = spark.createDataFrame(rows, "line long, path string, event string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.line: r.seconds for r in events.durations(log).collect()}
    assert got == {2: 2.0, 3: 0.0}
    v = spark.createDataFrame([(g, float(x)) for g, xs in (("a", [4, 2, 3, 1]), ("b", [7]), ("c", [5, 5, 5, 0.25, 0.21])) for x in xs], "g string, v double")
    got = {r.g: (r.p50, r.p95) for r in events.nearest_ranks(v, ["g"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    assert got == {"a": (3.0, 4.0), "b": (7.0, 7.0), "c": (5.0, 5.0)}  # round(1.5) goes to the even 2


def test_resolution(spark):
    docs = spark.createDataFrame([("Acme", "x/a.txt", ["r1"]), ("Acme", "x/b.txt", []), ("ACME", "x/c.txt", ["r1"]), ("zed", "zed.txt", [])], "client_name string, source_path string, related_references array<string>")
    assert {(r.folded, r.canonical) for r in resolve.canonical_names(docs).collect()} == {("acme", "Acme"), ("zed", "zed")}
    assert [r.client_name for r in resolve.suspicious_clients(docs).collect()] == ["zed"]
    full = docs.withColumns({"project_code": F.lit(""), "project_key": F.lit(""), "source_stem": F.lit("")})
    got = resolve.duplicate_clients(full, 0.9).collect()
    assert [(r.target, r.source) for r in got] == [("Acme", "ACME")] and abs(got[0].confidence - 0.96) < 1e-9


def test_clusters(spark):
    rows = [("c", 1, "2020", "k1", "A", "n", ["R1"], "2020"), ("c", 2, "2021", "k2", "B", "n2", ["R1", "R2"], "2020"), ("c", 3, "2022", "k3", "B", "n3", ["R2"], "2020")]
    df = spark.createDataFrame(rows, "client_name string, doc_id long, ingested_at string, project_key string, project_code string, project_name string, refs array<string>, year string")
    got = {r.doc_id: r.cluster for r in grouping.cluster_projects(df).collect()}
    assert got[3] == got[2] and got[1] != got[2]


def test_chunks_and_mmr(spark):
    assert retrieval.chunk("a b\n\nc") == ["a b\nc"]
    parts = retrieval.chunk("x" * 3000, 1200, 150)
    assert [len(p) for p in parts] == [1200, 1200, 900]
    assert retrieval.hash_embedding("a") == retrieval.hash_embedding("a")
    df = spark.createDataFrame([(1, 1, 1.0, [1.0, 0.0]), (1, 2, 0.99, [1.0, 0.01]), (1, 3, 0.9, [0.0, 1.0])], "query_id int, row_id int, score double, embedding array<double>")
    assert [r.row_id for r in retrieval.mmr(df, 2).orderBy("position").collect()] == [1, 3]


def test_store(spark):
    a = spark.createDataFrame([("k", 1, "old"), ("j", 2, "j")], "k string, v int, created string")
    b = spark.createDataFrame([("k", 9, "new"), ("n", 3, "n")], "k string, v int, created string")
    assert {tuple(r) for r in store.upsert(a, b, ["k"], keep=("created",)).collect()} == {("k", 9, "old"), ("j", 2, "j"), ("n", 3, "n")}
    m = spark.createDataFrame([({"a": "1"},)], "m map<string,string>").select(store.set_map_entry(F.col("m"), F.lit("a"), F.lit("2")).alias("m")).first()
    assert m.m == {"a": "2"}


def test_search_of_many_queries(spark, monkeypatch):
    """Beyond the bound queries go block by block; every 50th vector is asked for."""
    from foliant.operators import retrieval
    from foliant.plans import registry

    d = "/root/testdata/sf0.001"
    found = registry.queries()
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    want = {tuple(r) for r in found["cosine_topk"](spark, d).collect()}
    assert {r[0] for r in want} == {r[0] for r in e.where("vec_id % 50 = 0").select("vec_id").collect()}
    monkeypatch.setattr(retrieval, "MOST_QUERIES", 1)
    assert {tuple(r) for r in found["cosine_topk"](spark, d).collect()} == want
    hits = found["hybrid_search_all"](spark, d)
    assert {r[0] for r in hits.select("query_id").distinct().collect()} == {f"{i}:0" for i in range(0, 200, 50)}


def test_token_counts_of_all_languages(spark):
    import re

    from foliant.functions.text import RETRIEVAL_STOPWORDS
    from foliant.plans import registry

    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/documents.parquet").collect()
    want = sorted((r.doc_id, sum(w not in RETRIEVAL_STOPWORDS for w in re.findall("[a-z0-9]{2,}", (r.text or "").lower()))) for r in rows)
    assert sorted(tuple(r) for r in registry.queries()["token_counts"](spark, d).collect()) == want
    assert {r.lang for r in rows} > {"en"}


def test_client_in_path_of_many_lengths(spark):
    from foliant.operators import resolve

    known = spark.createDataFrame([("ab" * 2 + "x" * n,) for n in range(300)], "client_name string")
    docs = spark.createDataFrame([(1, "in/" + "q" * 3 + "zz" + "Y" * 290 + "/a.txt"), (2, "none")], "doc_id long, source_path string")
    known = known.union(spark.createDataFrame([("zz" + "y" * 290,)], "client_name string"))
    assert [tuple(r) for r in resolve.client_in_path(docs, known).collect()] == [(1, "zz" + "y" * 290)]
