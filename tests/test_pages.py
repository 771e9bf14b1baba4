"""Rows of pages, failure records, definition files, running unions and inserts, on small tables typed by hand."""

import json

from pyspark.sql import functions as F

from foliant.operators import documents, evaluation, events, fields, pages, retrieval, store
from foliant.sources import readers


def test_timeline_filters_come_after_the_limit(spark):
    ev = spark.createDataFrame([(1, "C", "d/a b.txt", "2020-01-01", "x"), (2, "C", "d/q.txt", "2020-02-01", "x"), (3, "C", "d/q.txt", None, "2021"), (4, "C", None, "2019-01-01", "x"), (5, "C", "d/q.txt", "2018-01-01", "x")], "event_id long, client_name string, source_document string, event_date string, created_at string")
    docs = spark.createDataFrame([(1, "C", "d/a b.txt", "report", None, ["Ann Lee"], 1), (2, "C", "d/q.txt", "quote", "2020-05-05", [], 2)], "doc_id long, client_name string, source_path string, document_kind string, report_date string, contacts array<string>, ingested_at int")
    ids = lambda **kw: sorted(r.event_id for r in pages.timeline_page(ev, docs, **kw).collect())
    assert ids(limit=4) == [1, 2, 3, 4] and ids(kind="quote", limit=4) == [2, 3] and ids(kind=" unknown ") == [4]
    assert ids(contact=" N LE") == [1, 2, 3, 4, 5] and ids(contact="bob") == []
    assert ids(date_from="15/01/2020") == [2] and ids(date_to="2020-01-31") == [1, 4, 5] and ids(date_from="soon") == [1, 2, 3, 4, 5]
    one = pages.timeline_page(ev, docs).where("event_id = 1").first()
    assert (one.document_name, one.document_href, one.missing_date) == ("a b.txt", "/document?path=d%2Fa%20b.txt", False)


def test_links_and_labels(spark):
    nodes = spark.createDataFrame([(1, [(" a/b.txt ", "2020"), ("  ", "2021"), (None, None)], "x/y z.txt"), (2, None, None), (3, [], "")], "id int, source_reports array<struct<path:string,date:string>>, superseded_by string")
    got = {r.id: r for r in pages.history_labels(pages.node_links(nodes)).collect()}
    assert [tuple(x) for x in got[1].source_reports] == [("a/b.txt", "2020", "b.txt", "/document?path=a%2Fb.txt")] and got[2].source_reports == []
    assert (got[1].label, got[1].superseded_href) == ("Superseded by y z.txt", "/document?path=x%2Fy%20z.txt") and {(got[i].label, got[i].superseded_href) for i in (2, 3)} == {("Superseded", None)}
    r = pages.report_links(spark.createDataFrame([("a/b.txt", ""), (None, "2020")], "source_path string, report_date string")).collect()
    assert [(x.document_name, x.versions_href, x.missing_date) for x in r] == [("b.txt", "/report/versions?path=a%2Fb.txt", True), ("", "/report/versions?path=", False)]


def test_key_fields_of_a_page(spark):
    shape = "client_name string, project_key string, fields map<string,struct<value:string,status:string,evidence:string,method:string,error_message:string>>"
    told = {"a": (" v ", "filled", "x", None, None), "b": ("", "absent", "Fallback due to LLM unavailability: gone ", "", ""), "c": ("", "", "FALLBACK due to LLM loss", None, None), "d": ("", "", "Fallback due to LLM unavailability:", " AI ", "m")}
    got = {r.key: (r.value, r.status, r.method, r.error_message, r.needs_generation) for r in pages.key_field_rows(spark.createDataFrame([("C", "p", told)], shape), [(k, k) for k in "abcde"]).collect()}
    assert got == {"a": ("v", "filled", "ai", "", False), "b": ("", "absent", "fallback", "gone", False), "c": ("", "", "fallback", "FALLBACK due to LLM loss", True), "d": ("", "", "ai", "m", True), "e": ("", "", "", "", True)}


def test_failure_records(spark):
    failed = spark.createDataFrame([("C", "p", "P", "s", "invalid_json_response", None, "q"), ("C", "none", "N", "s", "", "", None), ("C", "odd", "O", "s", "teapot", None, None), ("C", "said", "S", "s", "x", "own words", None)], "client_name string, project_key string, project_name string, strategy string, error_code string, error_message string, query_text string")
    docs = spark.createDataFrame([("C", "p", i, None if i == 2 else f"t{i}", f"n{i}") for i in range(1, 16)], "client_name string, project_key string, position int, title string, document_name string")
    hits = spark.createDataFrame([("C", "p", i, float(i), "H", "s", "y" * 300 if i == 1 else None) for i in range(1, 15)], "client_name string, project_key string, rank int, score double, hit_client string, source_document string, chunk_text string")
    got = {r.project_key: r for r in pages.failure_records(failed, docs, hits).collect()}
    p = got["p"]
    assert p.document_count == 15 and p.document_titles == ["t1", "n2", *(f"t{i}" for i in range(3, 13))] and [h.score for h in p.rag_hits] == [float(i) for i in range(1, 13)]
    assert [len(h.chunk_preview) for h in p.rag_hits[:2]] == [180, 0] and p.error_message == "Model returned invalid JSON."
    assert (got["none"].error_code, got["none"].error_message, got["none"].document_count, got["none"].document_titles) == ("unknown_error", "Unknown error.", 0, [])
    assert got["odd"].error_message == "Model request failed (teapot)." and got["said"].error_message == "own words"


def test_definition_files(spark, tmp_path):
    (tmp_path / "f").write_text("# c\n\n a_b | Label | p | q \nnext_step | What now?\nrisk\n|x|y\nk||z\nempty|  \n")
    rows = [tuple(r) for r in readers.key_fields(spark, str(tmp_path / "f")).collect()]
    assert rows == [(1, "a_b", "Label", "p|q"), (2, "next_step", "Next Step", "What now?"), (3, "risk", "Risk", "What is known about risk for this project?"), (4, "k", "k", "z")]
    (tmp_path / "q").write_text("scope | What | which?\r\nHow?\nempty|\n | Why?\n")
    assert [tuple(r) for r in readers.questionnaire(spark, str(tmp_path / "q")).collect()] == [(1, "scope", "What | which?"), (2, "q2", "How?"), (3, "q3", "Why?")]
    (tmp_path / "none").write_text("# nothing\n")
    assert [r.key for r in readers.key_fields(spark, str(tmp_path / "none")).collect()] == ["scope", "participants", "timeline", "commercial", "findings", "recommendations", "gaps"]
    assert [r.key for r in readers.questionnaire(spark, str(tmp_path / "none")).collect()][-2:] == ["risks_actions", "missing_info"]
    (tmp_path / "e.json").write_text(json.dumps([{"id": "1", "query": " x ", "expected_sources": ["a"], "source_documents": ["s"], "metadata_filters": {"k": ["v", "w"], "m": "n"}}, {"query": " ", "expected_sources": ["a"]}, {"query": "y", "expected_sources": []}]))
    (r,) = readers.evaluation_set(spark, str(tmp_path / "e.json")).collect()
    assert (r.query, r.source_documents, r.metadata_filters["m"], json.loads(r.metadata_filters["k"])) == ("x", ["s"], "n", ["v", "w"])


def test_summary_context_keeps_the_budget(spark):
    rows = [(1, i, None if i % 2 else "C", f"d/s{i % 15}.txt", "z" * (500 if i % 3 else 100)) for i in range(1, 40)] + [(1, 0, "C", "", "blank source"), (2, 1, "", "only.txt", None)]
    hits = spark.createDataFrame(rows, "query_id int, rank int, client_name string, source_document string, chunk_text string")

    def plain(q):
        seen, lines, used = set(), [], 0
        for _, _, client, source, text in sorted((r for r in rows if r[0] == q), key=lambda r: r[1]):
            if not source or source in seen:
                continue
            seen.add(source)
            line = f"[{client or 'unknown client'} | {source.rpartition('/')[2]}]\n{(text or '')[:420]}"
            if lines and used + len(line) > 2200:
                break
            lines.append(line)
            used += len(line)
            if used >= 2200 or len(lines) >= 12:
                break
        return "\n\n".join(lines)

    assert {r.query_id: r.context for r in fields.summary_context(hits).collect()} == {q: plain(q) for q in (1, 2)}
    docs = F.array(F.struct(F.lit("T").alias("report_type"), F.lit(" a ").alias("title"), F.lit("P").alias("document_name"), F.lit(None).cast("string").alias("project_code"), F.array(*[F.lit(f"r{i}") for i in range(7)]).alias("related_references")))
    assert spark.range(1).select(fields.summary_query_text(F.lit("P"), docs)).first()[0] == "P T a r0 r1 r2 r3 r4"


def test_running_unions_and_inserts(spark):
    rows = [("C", "p", 1, 1, "quote", ["A", " "], ["x"], ["r"], "2020"), ("C", "p", 2, 2, "report", ["B", "A"], None, ["r", "s"], ""), ("C", "p", 3, 3, "quote", [], ["y", "x"], None, None)]
    df = spark.createDataFrame(rows, "client_name string, project_key string, ingested_at int, doc_id long, document_kind string, authors array<string>, contacts array<string>, related_references array<string>, report_date string")
    got = {r.doc_id: (r.kinds_so_far, r.authors_so_far, r.contacts_so_far, r.refs_so_far, r.date_so_far) for r in documents.project_accumulation(df).collect()}
    assert got == {1: (["quote"], ["A"], ["x"], ["r"], "2020"), 2: (["quote", "report"], ["A", "B"], ["x"], ["r", "s"], "2020"), 3: (["quote", "report"], ["A", "B"], ["x", "y"], ["r", "s"], "2020")}
    stored = spark.createDataFrame([("a", None, 9)], "k string, d string, n int")
    new = spark.createDataFrame([("a", "", 1), ("b", None, 3), ("b", "", 2), ("b", "z", 4)], "k string, d string, n int")
    assert sorted(r.n for r in store.insert_absent(stored, new, ["k", "d"], ["n"]).collect()) == [2, 4, 9]
    nodes = spark.createDataFrame([("C", "p"), ("C", "q")], "client_name string, node_path string")
    left, history, counts = store.delete_nodes(nodes, nodes.unionByName(nodes), nodes.where("node_path = 'p'").unionByName(spark.createDataFrame([("C", "gone")], nodes.schema)))
    assert [r.node_path for r in left.collect()] == ["q"] and history.count() == 2 and {(r.node_path, r.n) for r in counts.collect()} == {("p", 1), ("gone", 0)}


def test_misses_cases_and_statuses(spark):
    hits = spark.createDataFrame([(1, "d/A.txt", 1), (1, None, 2), (2, "b.txt", 1), (2, "x\\C.txt", 9)], "query_id int, source string, rank int")
    want = spark.createDataFrame([(1, "x/a.TXT"), (2, "c.txt"), (2, "z.txt"), (3, "q.txt"), (4, "")], "query_id int, source string")
    got = {r.query_id: (r.expected_sources, r.top_results) for r in retrieval.retrieval_misses(hits, want).collect()}
    assert got == {2: (["c.txt", "z.txt"], ["b.txt"]), 3: (["q.txt"], [])} and {r.query_id for r in retrieval.retrieval_misses(hits, want, 9).collect()} == {3}
    shape = "client_name string, project_key string, project_name string, updated_at int, fields map<string,struct<value:string,status:string,method:string>>"
    rows = [("C", f"p{i}", None, i, {"a": ("1", "filled", "AI"), "b": (None, "absent", " ai"), "c": ("1", "failed", "ai")} if i % 2 else {"a": ("1", "filled", "rule")}) for i in range(40)]
    cases = evaluation.benchmark_cases(spark.createDataFrame(rows, shape)).collect()
    assert [(r.place, r.project_key, r.field_key) for r in cases[:3]] == [(1, "p39", "a"), (2, "p39", "b"), (3, "p37", "a")] and len(cases) == 9
    assert evaluation.benchmark_cases(spark.createDataFrame([("C", f"p{i}", "", i, {"a": ("1", "filled", "ai")}) for i in range(12)], shape)).count() == 8
    log = spark.createDataFrame([("file_completed", "ok"), ("file_completed", None), ("file_completed", ""), ("file_error", "ok")], "event string, status string")
    assert {(r.status, r.n) for r in events.status_counts(log).collect()} == {("ok", 1), ("unknown", 2)}
