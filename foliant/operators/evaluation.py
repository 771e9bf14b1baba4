"""Evaluation: financial totals against expected ones, answer scores, model benchmarks, manifests, row counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def financial_evaluation(metrics: DataFrame, expected: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Per expected client (client_name, revenue, cost, profit) the difference of its totals, and whether all lie within
    the tolerance. A client without documents has totals of 0; an expected profit of null or 0 is revenue less cost."""
    want = expected.select("client_name", *[F.coalesce(F.col(c), F.lit(0.0)).alias(f"expected_{c}") for c in ("revenue", "cost")], "profit")
    want = want.withColumn("expected_profit", F.coalesce(F.nullif("profit", F.lit(0.0)), F.col("expected_revenue") - F.col("expected_cost"))).drop("profit")
    got = metrics.select("client_key", *[F.col(f"{c}_total").alias(f"actual_{n}") for n, c in (("revenue", "revenue"), ("cost", "cost"), ("profit", "gross_profit"))], "financial_documents", "documents_with_financials", "gross_margin_pct")
    out = want.join(got, F.lower(F.trim("client_name")) == F.col("client_key"), "left").drop("client_key").fillna(0)
    out = out.withColumn("actual_profit", F.coalesce(F.nullif("actual_profit", F.lit(0.0)), F.col("actual_revenue") - F.col("actual_cost")))
    names = ("revenue", "cost", "profit")
    out = out.withColumns({f"delta_{n}": F.round(F.col(f"actual_{n}") - F.col(f"expected_{n}"), 2) for n in names})
    return out.withColumn("ok", reduce(lambda a, b: a & b, [F.abs(f"delta_{n}") <= tolerance for n in names]))


def passed_failed(evaluated: DataFrame) -> DataFrame:
    return evaluated.agg(F.count(F.lit(1)).alias("clients"), F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed"))


def _token_set(c: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[/-]", " "), r"(?U)\s+")), "")


def token_f1(expected: Column, actual: Column) -> Column:
    """F1 of the two texts' sets of words; two empty sets agree, an empty one agrees with nothing else."""
    a, b = _token_set(expected), _token_set(actual)
    both, n, m = (F.size(x).cast("double") for x in (F.array_intersect(a, b), a, b))
    return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0) | (both == 0), 0.0).otherwise(2 * both / (n + m))


def case_score(row: dict[str, Column] | None = None) -> Column:
    """0.6 for the right status, up to 0.3 for its value, 0.1 for the method ``ai``; 0 for a failed case.

    Columns: ok, status, expected_status, value, expected_value, method.
    """
    c = row or {n: F.col(n) for n in ("ok", "status", "expected_status", "value", "expected_value", "method")}
    right = F.coalesce(F.trim(c["status"]), F.lit("")) == c["expected_status"]
    value = F.when(c["expected_status"] == "absent", 0.3).when(c["expected_status"] == "filled", 0.3 * token_f1(c["expected_value"], c["value"])).otherwise(0.0)
    ai = F.when(F.lower(F.trim(F.coalesce(c["method"], F.lit("")))) == "ai", 0.1).otherwise(0.0)
    return F.when(c["ok"], F.least(F.lit(1.0), F.when(right, 0.6 + value).otherwise(0.0) + ai)).otherwise(0.0)


def benchmark_summary(cases: DataFrame) -> DataFrame:
    """Per model the rates, mean score and latency of its cases, and its place among all models."""
    scored = cases.withColumn("__score", case_score())
    right = F.col("ok") & (F.coalesce("status", F.lit("")) == F.col("expected_status"))
    filled = F.col("ok") & (F.col("expected_status") == "filled") & (F.col("status") == "filled")
    share = lambda c: F.round(F.count_if(c) / F.count(F.lit(1)), 4)
    out = scored.groupBy("model").agg(
        F.count(F.lit(1)).alias("case_count"),
        share(F.col("ok")).alias("ok_rate"),
        share(F.col("ok") & (F.lower(F.trim(F.coalesce("method", F.lit("")))) == "ai")).alias("ai_method_rate"),
        share(right).alias("status_accuracy"),
        F.round(F.avg("__score"), 4).alias("avg_score"),
        F.round(F.avg("latency_seconds"), 3).alias("avg_latency_seconds"),
        F.round(F.coalesce(F.avg(F.when(filled, token_f1(F.col("expected_value"), F.col("value")))), F.lit(0.0)), 4).alias("filled_value_similarity"),
    )
    # Models are a handful, so one window over all of them is small.
    best = Window.orderBy(F.desc("avg_score"), F.desc("status_accuracy"), F.desc("ai_method_rate"), "avg_latency_seconds", "model")
    return out.withColumn("place", F.row_number().over(best))


def summary_quality(ok: Column, summary: Column, accepted: Column, runs: Column, absent: Column, answers: Column) -> Column:
    """0.45 for length (650 characters are full marks), 0.35 for accepted runs, 0.2 for answers that aren't absent."""
    at_least_one = lambda c: F.greatest(F.lit(1), c).cast("double")
    length = F.least(F.length(F.coalesce(summary, F.lit(""))) / 650.0, F.lit(1.0))
    full = F.greatest(F.lit(0.0), 1 - absent / at_least_one(answers))
    return F.when(ok, F.round(0.45 * length + 0.35 * accepted / at_least_one(runs) + 0.2 * full, 4)).otherwise(0.0)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table."""
    return reduce(DataFrame.unionByName, [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()])


def manifest_check(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows (path, expected_kind) that have a document, with its kind and whether it is another one."""
    m = manifest.select(F.col("path").alias("source_path"), "expected_kind")
    return docs.select("doc_id", "source_path", "document_kind").join(m, "source_path").withColumn("mismatch", ~F.col("document_kind").eqNullSafe(F.col("expected_kind")))


def benchmark_cases(projects: DataFrame, most_cases: int = 9, most_projects: int = 8) -> DataFrame:
    """(place, client_name, project_key, project_name, field_key, expected_status, expected_value): the first stored answers of a model that are
    filled or known as absent, of at most so many projects, the newest first.

    ``projects``: client_name, project_key, project_name, updated_at and ``fields``, a map from key to a struct of value, status and method;
    ties of time go by client and project. Both limits are taken as top-k, so no task sees all rows.
    """
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    entries = F.filter(F.map_entries("fields"), lambda e: (F.lower(text(e["value"]["method"])) == "ai") & text(e["value"]["status"]).isin("filled", "absent"))
    own = projects.withColumn("__e", entries).where(F.size("__e") > 0)
    newest = [F.desc("updated_at"), F.asc("client_name"), F.asc("project_key")]
    top = own.orderBy(*newest).limit(most_projects)
    rows = top.select("client_name", "project_key", "updated_at", F.coalesce("project_name", F.lit("")).alias("project_name"), F.posexplode("__e").alias("__at", "__f"))
    first = rows.orderBy(*newest, "__at").limit(most_cases)
    place = F.row_number().over(Window.orderBy(*newest, "__at"))
    return first.select(place.alias("place"), "client_name", "project_key", "project_name", F.col("__f.key").alias("field_key"), text(F.col("__f.value.status")).alias("expected_status"), text(F.col("__f.value.value")).alias("expected_value"))
