"""Patterns behind searches for words against the bare patterns, and that a plan evaluates a field's patterns once."""

import random

from pyspark.sql import functions as F

from foliant.functions import extract
from foliant.plans import registry

D = "/root/testdata/sf0.001"
PATTERNS = [p for g in (extract.CLIENT_NAME, extract.AUTHORS, extract.CONTACTS, extract.REPORT_TYPE, extract.PROJECT_NAME, extract.PROJECT_CODE) for p in g]
PATTERNS += [extract.QUOTE_NUMBER, extract.ORDER_NUMBER, extract.ACCESS_REFERENCE, extract.OTHER_REFERENCE, *(p for g in extract.TEXT_CUES.values() for p in g)]
PATTERNS += [rf"\b{c}\b" for c in (*extract.REPORT_CUES, *extract.CLIENT_CUES)] + [r"\bclient\s*(?:name)?\b"]


def test_no_match_lacks_its_words(spark):
    rng = random.Random(3)
    bits = "client name for Client author prepared by Contact report type document Project subject code job # reference quote quotation estimate purchase order po access request permit to work from: to: sent: email chain amount due invoice expense summary travel cost breakdown timesheet hours worked finding recommendations inspection site unit line asset shutdown outage a@b.c X-12 AB9".split()
    rows = [("".join(rng.choice(bits) + rng.choice([" ", " ", "\n", ": ", " - ", "# "]) for _ in range(rng.randrange(1, 12))),) for _ in range(2000)]
    df = spark.createDataFrame(rows, "t string").withColumn("low", F.lower("t"))
    found = [F.count_if(F.col("t").rlike("(?imd)" + p)).alias(f"m{n}") for n, p in enumerate(PATTERNS)]
    missed = [F.count_if(F.col("t").rlike("(?imd)" + p) & ~extract.may_match(F.col("low"), p)).alias(f"x{n}") for n, p in enumerate(PATTERNS)]
    r = df.agg(*found, *missed).first()
    assert all(r[f"x{n}"] == 0 for n in range(len(PATTERNS)))
    assert sum(r[f"m{n}"] > 0 for n in range(len(PATTERNS))) >= 0.8 * len(PATTERNS)


def test_filters_do_not_copy_patterns(spark):
    """A filter on a field stays above it: its patterns were copied into the join of orders and customers."""
    for name, pattern in (("project_rollup", "project\\\\s*code"), ("case_collisions", "client\\\\s*name"), ("non_reports", "quotation")):
        plan = registry.queries()[name](spark, D)._jdf.queryExecution().optimizedPlan().toString()
        lines = [x for x in plan.split("\n") if pattern.replace("\\\\", "\\") in x]
        assert len(lines) == 1 and "Join" not in lines[0], name
        assert not any(x.lstrip(" :+-").startswith("Join") and "regexp" in x for x in plan.split("\n"))


def test_unread_fields_are_left_out(spark):
    plan = registry.analysed(spark, D).select("client_name")._jdf.queryExecution().optimizedPlan().toString()
    assert "client\\s*name" in plan and "quotation|estimate" not in plan and "author" not in plan


def test_read_several_times_but_written_once(spark):
    for name in ("client_summary", "duplicate_clients", "auto_merged_clients", "enriched_timeline", "reassigned_tables", "reassigned_counts", "project_matches"):
        plan = registry.queries()[name](spark, D)._jdf.queryExecution().optimizedPlan().toString()
        assert "RDD" in plan and "client\\s*name" not in plan, name
