"""Patterns run in projections that Java compiles, and on no more rows than the result needs."""

import re

import pytest
from pyspark.sql import functions as F

from foliant.functions import text
from foliant.operators import resolve
from foliant.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture
def plan(spark):
    """The plan of a DataFrame, with whole-stage code marked by ``*(n)``."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", before)


@pytest.mark.parametrize("field", ["client_name", "document_kind", "report_date", "related_references", "revenue_amount", "cost_amount", "currency"])
def test_no_pattern_runs_in_whole_stage_code(spark, plan, field):
    """There all of a row's patterns are one method, too long for Java to compile."""
    rows = spark.createDataFrame([(1, "a.txt", None, "Client Name: Ann")], "doc_id long, source_path string, ingested_at timestamp, text string")
    shown = plan(registry.with_fields(rows).select("doc_id", field))
    whole = [line for line in shown.splitlines() if re.match(r"[\s:+-]*\*\(\d+\) ", line)]
    assert "regexp_" in shown.lower() or "rlike" in shown.lower()
    assert not [line for line in whole if re.search(r"(?i)regexp_|rlike", line)]


def test_rendered_text_is_outside_whole_stage_code(spark, plan):
    shown = plan(registry.rendered(spark, SF).select("doc_id", "text"))
    assert "Client Name: " in shown and not re.search(r"\*\(\d+\) Project \[[^\n]*concat_ws", shown)


def test_filled(spark):
    rows = spark.createDataFrame([("a",), ("",), (None,), (" ",)], "t string").select(text.filled(F.col("t")).alias("t"), text.by_itself(F.col("t")).alias("same"))
    assert [tuple(r) for r in rows.collect()] == [("a", "a"), (None, ""), (None, None), (" ", " ")]


def test_client_metrics_runs_patterns_on_newest_versions_only(spark, plan):
    shown = plan(registry.queries()["client_metrics"](spark, SF)).splitlines()
    assert max(n for n, line in enumerate(shown) if "row_number()" in line) > max(n for n, line in enumerate(shown) if "regexp_extract" in line)


def test_duplicate_clients_reads_documents_once(spark, plan):
    rows = [("Ann Co", n, "P-1", "p-1", ["R-1"], "s") for n in range(4)] + [("ANN CO", n, "P-1", "p-1", ["R-1"], "s") for n in range(4, 7)] + [("Bob", 9, "P-1", "p-1", ["R-1"], "s")]
    docs = spark.createDataFrame(rows, "client_name string, doc_id long, project_code string, project_key string, related_references array<string>, source_stem string")
    found = resolve.duplicate_clients(docs)
    assert len(re.findall("Scan", plan(found))) == 1 and "Join" not in plan(found)
    assert [(r.target, r.source, round(r.confidence, 6)) for r in found.collect()] == [("Ann Co", "ANN CO", 1.0)]
