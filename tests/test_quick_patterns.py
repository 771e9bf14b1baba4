"""Patterns that look for a word or letter first, and guarded money steps, against the bare ones."""

import random

from pyspark.sql import functions as F

from foliant.functions import extract, money
from foliant.functions.text import LINE_END
from foliant.plans import registry

D = "/root/testdata/sf0.001"
LOW = [p for g in extract.TEXT_CUES.values() for p in g] + [rf"\b{c}\b" for c in (*extract.REPORT_CUES, *extract.CLIENT_CUES)]
ANY = [*extract.PROJECT_CODE, extract.QUOTE_NUMBER, extract.ORDER_NUMBER, extract.ACCESS_REFERENCE, extract.OTHER_REFERENCE, *extract.CLIENT_NAME]
BITS = "quote quotation Quotes estimate purchase order po pos PO# Reference job # code X-12 AB9 project access request permit to work from: to: sent: Subject: a@b.c email chain amount due invoice expense summary travel cost breakdown timesheet hours worked findings finding recommendation recommendations inspection reports site unit line asset shutdown outage ﬁnding _ é client name USD usd AUD A$ a$ $ € £ eur GBP susd audit ** - * 12.50 1,200".split()
BITS += ["purchase order", "access request", "permit to work", "email chain", "amount due", "expense report", "expense summary", "travel expense", "cost breakdown", "hours worked", "\nFrom: a@b.c", "\n - to:"]
GAPS = [" ", " ", "\n", ": ", " - ", "", "_", "\r\n", "\r", " ", "\x85", " \n", "\n　", " \n", "\n \t", "\x0b", "\x1c", "\n\n", "́"]


def texts(spark, n=4000):
    rng = random.Random(5)
    rows = [("".join(rng.choice([rng.choice(BITS), rng.choice(GAPS)]) + rng.choice(GAPS) for _ in range(rng.randrange(0, 14))),) for _ in range(n)]
    return spark.createDataFrame([*rows, (None,), ("",), (" ",), ("\n",), ("a",)], "t string").withColumn("low", F.lower("t"))


def test_same_matches(spark):
    df, low, t = texts(spark), F.col("low"), F.col("t")
    checks = [(low.rlike(p), low.rlike(extract.word_first(p)) & extract.may_match(low, p)) for p in LOW]
    checks += [(F.regexp_extract_all(t, F.lit("(?imd)" + p), F.lit(1)), F.regexp_extract_all(t, F.lit("(?imd)" + extract.letter_first(p)), F.lit(1))) for p in ANY]
    r = df.agg(*[F.count_if(~a.eqNullSafe(b)).alias(f"x{n}") for n, (a, b) in enumerate(checks)], *[F.count_if(a).alias(f"m{n}") for n, (a, _) in enumerate(checks[: len(LOW)])]).first()
    assert all(r[f"x{n}"] == 0 for n in range(len(checks)))
    assert sum(r[f"m{n}"] > 0 for n in range(len(LOW))) >= 0.8 * len(LOW)


def test_same_lines_and_currencies(spark):
    t = F.col("t")
    bare = F.replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, LINE_END, "\n"), r"(?Um)^[\s&&[^\n]]+|[\s&&[^\n]]+$", ""), r"(?m)^[-* ]+", ""), F.lit("**"), F.lit(""))
    code = F.when(t.rlike(r"(?i)\bUSD\b|\$"), "USD").when(t.rlike(r"(?i)\bAUD\b|A\$"), "AUD").when(t.rlike(r"(?i)\bEUR\b|€"), "EUR").when(t.rlike(r"(?i)\bGBP\b|£"), "GBP").otherwise("")
    r = texts(spark).agg(F.count_if(~bare.eqNullSafe(money.plain_lines(t))).alias("lines"), F.count_if(~code.eqNullSafe(money.currency(t))).alias("codes"), F.count_distinct(money.currency(t)).alias("n")).first()
    assert (r.lines, r.codes, r.n) == (0, 0, 5)


def test_plans_search_for_words_first(spark):
    """Each pattern tested every place of a text for a word's beginning."""
    plan = registry.analysed(spark, D).select("document_kind", "project_code", "currency")._jdf.queryExecution().optimizedPlan().toString()
    assert r"invoice(?<=\binvoice)\b" in plan and r"(?=[jpr])\b(?:project" in plan and r"\bUSD\b|\$" not in plan
