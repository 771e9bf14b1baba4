"""Financial totals over renderings, project fields, evaluation, scans and the client gate."""

from pyspark.sql import functions as F

from foliant.functions import extract, money
from foliant.operators import evaluation, fields, resolve, retrieval, scans, store

# Documents of three clients whose totals are known: (client, kind, lines).
MONEY_DOCS = [
    ("NorthRiver Energy", "invoice", [("Invoice Number", "INV-NRE-260412"), ("Invoice Total", "USD 182000.00"), ("Cost", "USD 117500.00")]),
    ("NorthRiver Energy", "expense_report", [("Expense Report", "Travel and lifting"), ("Travel Cost", "USD 13600.00"), ("Material Cost", "USD 4300.00"), ("Total Cost", "USD 17900.00")]),
    ("BlueMesa Utilities", "quote", [("Quote Number", "Q-BMU-0322"), ("Contract Value", "USD 96500.00"), ("Estimated Cost", "USD 60200.00")]),
    ("BlueMesa Utilities", "timesheet", [("Hours Worked", "168"), ("Labour Cost", "USD 15120.00"), ("Expense", "USD 980.00"), ("Total Cost", "USD 16100.00")]),
    ("BlueMesa Utilities", "report", [("Revenue", "USD 12500.00"), ("Cost", "USD 6400.00")]),
    ("HarborStone Manufacturing", "expense_report", [("Material Cost", "USD 28750.00"), ("Labour Cost", "USD 33400.00"), ("Travel Cost", "USD 5100.00"), ("Total Cost", "USD 67250.00")]),
    ("HarborStone Manufacturing", "invoice", [("Invoice Total", "USD 121300.00"), ("Cost", "USD 74420.00"), ("Gross Profit", "USD 46880.00")]),
    ("Delta Utilities", "purchase_order", [("Purchase Order Number", "PO-DEL-0504"), ("Supplier Cost", "USD 33980.00"), ("Expense", "USD 4200.00"), ("Total Cost", "USD 38180.00")]),
    ("Delta Utilities", "quote", [("Quote Number", "Q-DEL-0512"), ("Contract Value", "USD 58900.00"), ("Estimated Cost", "USD 34870.00")]),
]
TOTALS = {"NorthRiver Energy": (182000, 135400), "BlueMesa Utilities": (109000, 82700), "HarborStone Manufacturing": (121300, 141670), "Delta Utilities": (58900, 73050)}
RENDERINGS = {"txt": "{}: {}", "md": "- **{}:** {}", "csv": "{} | {}", "html": "{}\n{}"}


def test_financial_totals_in_all_renderings(spark):
    rows = [(way, c, k, "\n".join(form.format(*line) for line in [("Client", c), ("Date", "2026-04-12"), *lines])) for way, form in RENDERINGS.items() for c, k, lines in MONEY_DOCS]
    docs = spark.createDataFrame(rows, "way string, client_name string, kind string, text string").withColumn("m", money.financials(F.col("text"), F.col("kind")))
    got = {(r.way, r.client_name): (r.r, r.c) for r in docs.groupBy("way", "client_name").agg(F.sum("m.revenue_amount").alias("r"), F.sum("m.cost_amount").alias("c")).collect()}
    assert got == {(way, c): tuple(map(float, t)) for way in RENDERINGS for c, t in TOTALS.items()}
    m = spark.createDataFrame([(c.lower(), float(r), float(k), float(r - k), 1, 1, 0.0) for c, (r, k) in TOTALS.items()], "client_key string, revenue_total double, cost_total double, gross_profit_total double, financial_documents long, documents_with_financials long, gross_margin_pct double")
    want = spark.createDataFrame([("NorthRiver Energy", 182000.0, 135400.0, 46600.0), ("Delta Utilities", 58900.0, 73051.5, None), ("Nobody", 1.0, 0.0, None)], "client_name string, revenue double, cost double, profit double")
    out = {r.client_name: (r.ok, r.delta_cost) for r in evaluation.financial_evaluation(m, want).collect()}
    assert out == {"NorthRiver Energy": (True, 0.0), "Delta Utilities": (False, -1.5), "Nobody": (True, 0.0)}


def test_money_sides(spark):
    rows = [("Invoice Total: 0\nTotal Cost: 5", "invoice"), ("Total Cost: 5\nInvoice Total: x", "report"), ("nothing", "report"), ("we paid $ 1,200.50 for it", "quote"), ("Quote Total | 7\nRevenue: 9", "quote"), ("Cost\n\n\nUSD 12.5", "x")]
    df = spark.createDataFrame(rows, "t string, k string").select(money.financials(F.col("t"), F.col("k")).alias("m")).select("m.*")
    assert [(r.financial_type, r.revenue_amount, r.cost_amount, r.gross_profit) for r in df.collect()] == [("mixed", 0.0, 5.0, -5.0), ("cost", None, 5.0, None), ("", None, None, None), ("revenue", 1200.5, None, None), ("revenue", 7.0, None, None), ("cost", None, 12.5, None)]


def test_extraction_shapes(spark):
    body = "For Client: - **Acme  Ltd**:\nJob Code: AB12-9\nSubject: re outage of unit 3\nPermit Reference: PR-77\nEstimate no. E-5\nquotation\nQ-1\nReport Date: March 3, 2021\nDate: 04/05/2021\nprepared by - B. C\nClient Contact: D\ncontact: E\ndocument type: Audit\nKey Findings:\n* weld crack\nSummary Of Work\nFindings\n- pump leak"
    e = spark.createDataFrame([(body,)], "t string").select(extract.extract(F.col("t")).alias("e")).first().e
    assert (e.client_name, e.project_code, e.project_name, e.access_reference, e.report_type) == ("Acme Ltd", "AB12-9", "outage", "PR-77", "Audit")
    assert e.report_date == "2021-04-05" and e.event_dates == ["2021-04-05", "2021-03-03"]
    assert e.authors == ["B. C"] and e.contacts == ["E", "D"] and e.findings == ["weld crack", "pump leak"]
    assert {"E-5", "Q-1", "PR-77", "AB12-9"} <= set(e.related_references)


def test_chunks_like_the_reader_expects():
    assert [len(c) for c in retrieval.chunk("a" * 100 + "\n\n" + "b" * 1190)] == [100, 1190, 140]
    assert retrieval.chunk("one\r\n\r\ntwo") == ["one\ntwo"] and retrieval.chunk(" \n ") == [] and retrieval.chunk(None) == []
    long = " ".join(f"Sentence number {i} ends here." for i in range(100))
    assert all(len(c) <= 1200 for c in retrieval.chunk(long)) and len(retrieval.chunk(long)) == 4
    assert [len(c) for c in retrieval.chunk("x" * 2500, 1000, 100)] == [1000, 1000, 700]


def test_focus():
    text = "The quote came late. " + "Filler words go on. " * 10 + "We recommend to repair the quote system and monitor the risk of failure soon."
    assert "recommend" in fields.focus(text, ("quote",)) and fields.focus("  a   b ", ("zz",)) == "a b" and fields.focus(None, ("x",)) == ""


def test_answers_and_summaries(spark):
    df = spark.createDataFrame([(True, "yes it is", "because of it"), (True, "yes", "short"), (False, "yes", "long enough"), (True, "Unknown", "long enough"), (None, None, None)], "p boolean, a string, e string")
    got = [(r.r.status, r.r.answer) for r in df.select(fields.answer_record(F.col("p"), F.col("a"), F.col("e")).alias("r")).collect()]
    assert got == [("accepted", "yes it is"), ("insufficient_evidence", fields.ABSENT), *[("absent_or_rejected", fields.ABSENT)] * 3]
    told = spark.createDataFrame([({"extra": "e f", "title": "T " * 20, "scope": "s", "participants": "p", "date": "d"},), ({"z": "1", "scope": "s", "title": "2"},), ({"scope": "s"},), ({},)], "f map<string,string>")
    assert [r[0] for r in told.select(fields.known_fields(F.col("f"), "scope")).collect()] == ["title=" + " ".join("T" * 10) + "; date=d; participants=p", "title=2; z=1", "none", "none"]


def test_summaries_hold_every_label(spark):
    """Written out by hand from the rule: blanks collapsed, a line for each label, "Commercial" cuts its longer label."""
    absent = fields.ABSENT
    rows = [("Intro  text. scope: all of it\n\nTitle: x", "P", {"commercial": "c " * 200, "timeline": " \t", "participants": "unknown", "missing_info": "m  n"}), (" ", None, {})]
    df = spark.createDataFrame(rows, "s string, p string, f map<string,string>")
    got = [r.c.split("\n") for r in df.select(fields.covered(F.col("s"), F.col("p"), F.col("f")).alias("c")).collect()]
    cut = ("c " * 200)[:177].rstrip() + "..."
    assert [" ".join(x.split()) for x in got[0]] == ["Intro text.", "Scope: all of it", "Title: x", f"Participants: {absent}", f"Timeline: {absent}", "Quoted /", f"Commercial: {cut}", f"Invoice status: {cut}", f"Findings: {absent}", f"Recommendations: {absent}", "Gaps: m n"]
    assert got[1][:3] == ["Project summary unavailable.", "Title:  Untitled project", f"Scope:  {absent}"]


def test_projects_and_clients_from_paths(spark):
    from foliant.functions import extract

    rows = [("in/Harborstone_access_request_report_v2_2018.csv", "Harborstone", None, "2018-03-04"), ("x/report_v1.txt", None, "Site Survey", None), ("x/report_2019.txt", None, None, None), ("a/b c/pump_house-12.txt", "North River Ltd Co", None, "2020-01-01")]
    df = spark.createDataFrame(rows, "path string, client string, kind string, date string")
    name = extract.project_from_path(F.col("path"), F.col("client"), F.col("kind"))
    got = [tuple(r) for r in df.select(name, extract.project_code_of(name, F.col("client"), F.col("date"))).collect()]
    assert got == [("Access Request", "H-ACC-REQ-2018"), ("Site Survey", "SIT-SUR"), ("Report 2019", "REP-201"), ("Pump House", "NRL-PUM-HOU-2020")]
    paths = ["a/report_3_2018_bluemesa_v2_report_electrical/x.csv", "report_3_2018_blue_mesa_audit/sub/x.csv", "a/report_2018/x.csv", "plain/x.csv", "report_77_acme/x.csv"]
    shown = spark.createDataFrame([(p,) for p in paths], "p string").select(extract.client_from_path(F.col("p"))).collect()
    assert [r[0] for r in shown] == ["Bluemesa", "Blue Mesa", None, None, None]


def test_json_from_prose(spark):
    rows = ['{"a": 1}', 'Sure:\n```json\n{"a": {"b": 2}}\n```', "no", None, "[1]", "{broken"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string").select("i", fields.json_from_prose(F.col("x")).alias("j")).orderBy("i")
    assert [r.j for r in df.collect()] == ['{"a": 1}', '{"a": {"b": 2}}', None, None, None, None]


def test_scans_and_changes(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b"), (2, "a")], "i int, x string")
    scans.append(rows, str(tmp_path / "t"))
    scans.append(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    scans.append_json(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert [scans.reset(spark, str(tmp_path / "t"), "s"), scans.reset(spark, str(tmp_path / "t"), "s")] == [str(tmp_path / "t") + ".bak_s", None]
    a = spark.createDataFrame([([("p", None), ("q", "1")], [("q", "2"), ("p", "3"), ("r", None)], {"k": "a"}, {"k": "b", "l": "c"})], "t array<struct<path:string,date:string>>, s array<struct<path:string,date:string>>, x map<string,string>, y map<string,string>")
    r = a.select(store.merged_reports(F.col("t"), F.col("s")).alias("r"), store.merged_fields(F.col("x"), F.col("y")).alias("m")).first()
    assert [tuple(x) for x in r.r] == [("p", "3"), ("q", "1"), ("r", None)] and r.m == {"k": "a", "l": "c"}
    docs = spark.createDataFrame([("c", "k", ["r"]), ("d", "k", ["r"])], "client_name string, project_key string, related_references array<string>")
    out = {r.client_name: (r.project_key, r.related_references) for r in store.delete_client({"documents": docs}, "c")["documents"].collect()}
    assert out == {None: (None, []), "d": ("k", ["r"])}


def test_client_gate(spark):
    known = spark.createDataFrame([("Acme Ltd", ["R-1"]), ("ACME LTD", []), ("Acme Ltd", []), ("Bix", ["R-2"]), ("Bix!", [])], "client_name string, related_references array<string>")
    rows = [(1, "in/x/a.txt", "Client: acme ltd", 0.9, True, "acme ltd", []), (2, "in/x/b.txt", "t", 0.9, True, None, ["r-1"]), (3, "in/Zed/Zed.txt", "Client: Zed", 0.9, True, "Zed", []), (4, "in/x/c.txt", "Client: New Co", 0.8, True, "New Co", []), (5, "in/x/d.txt", "New Co", 0.8, True, "New Co", []), (6, "in/bix/e.txt", "t", 0.9, True, None, [])]
    docs = spark.createDataFrame(rows, "doc_id long, source_path string, text string, confidence double, is_client_related boolean, client_name string, related_references array<string>")
    assert {r.doc_id: r.client_name for r in resolve.resolved_clients(docs, known).collect()} == {1: "Acme Ltd", 2: "Acme Ltd", 3: None, 4: "New Co", 5: None, 6: None}
