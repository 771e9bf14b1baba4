from pyspark.sql import functions as F

from foliant.functions import dates, extract, money, text


def values(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r.v for r in df.select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


def test_names(spark):
    assert values(spark, ["Acme Pty. Ltd", "a/b/Foo Bar.txt", ""], text.name_key) == ["acmepty", "foobar", ""]
    assert values(spark, ["Crude Unit!", "--", None], text.slug) == ["crude-unit", "general-project", "general-project"]
    assert values(spark, ["O'NEIL 3rd-party"], text.title_case) == ["O'Neil 3Rd-Party"]
    assert values(spark, ["- **Acme** Ltd.: "], text.clean_client) == ["Acme Ltd"]
    assert values(spark, ["a\\b\\c.TXT", "x.tar.gz", ".env"], text.suffix) == [".txt", ".gz", ""]


def test_ordered_sets(spark):
    df = spark.createDataFrame([(["b", " a", "B"], ["a", "c", ""])], "x array<string>, y array<string>")
    got = df.select(text.ordered_union(F.col("x"), F.col("y")).alias("u"), text.ordered_union_nocase(F.col("x"), F.col("y")).alias("n")).first()
    assert got.u == ["b", "a", "B", "c"] and got.n == ["b", "a", "c"]


def test_dates(spark):
    assert values(spark, ["03/04/2021", "13/04/2021", "5/21/70", "March 4, 2021", "4 Mar 2021", "2021-99-99", "x", None, "March 4,2021", "31/02/2021", "29 Feb 2021", "Sept 4, 2021", "2/29/2020"], dates.normal_date) == ["2021-03-04", "2021-04-13", "1970-05-21", "2021-03-04", "2021-03-04", "2021-99-99", None, None, None, None, None, None, "2020-02-29"]
    assert [str(d) for d in values(spark, ["03/04/2021"], dates.typed_date)] == ["2021-04-03"]


def test_money(spark):
    assert values(spark, ["A$ 5", "AUD 5", "€5", "5"], money.currency) == ["USD", "AUD", "EUR", ""]
    assert values(spark, ["-1,234.50 x", "none"], money.parse_money) == [1234.5, None]
    cost = lambda c: money.amount_after_labels(money.plain_lines(c), money.COST_SECOND)
    assert values(spark, ["Cost Centre: HM-2018-OPS", "Cost\n\n12.50", "- **Travel Cost:** 7"], cost) == [2018.0, 12.5, 7.0]


def test_classify(spark):
    df = spark.createDataFrame([("Quotation for site", "a.txt"), ("From: a@b\nTo: c\nSubject: x", "x/email_chain_1.md"), ("Findings of the inspection", "r.txt"), ("hello", "z.txt"), ("invoice quote", "z.txt")], "t string, p string")
    got = [r.k for r in df.select(extract.classify(F.col("t"), F.col("p"))["document_kind"].alias("k")).collect()]
    assert got == ["quote", "email_chain", "report", "unknown", "quote"]


def test_extract(spark):
    body = "Inspection Report\nClient Name: Acme Ltd\nAuthor: A. B\nDate: 2 March 2020\nFindings:\n- weld crack\n- pump leak\n\nRecommendations\n- fix it\nPO box 7"
    e = spark.createDataFrame([(body,)], "t string").select(extract.extract(F.col("t")).alias("e")).first().e
    assert (e.client_name, e.authors, e.report_date, e.findings, e.recommendations[0]) == ("Acme Ltd", ["A. B"], "2020-03-02", ["weld crack", "pump leak"], "fix it")
    assert e.areas == ["Piping", "Mechanical"] and "box" in e.related_references
