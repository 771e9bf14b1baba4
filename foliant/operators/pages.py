"""Rows as the pages of a client, a report or a project show them: links, labels, filters, stored fields and failures.

What a row shows is told by expressions over its own columns, or by joins on paths and keys; nothing is gathered but the first
few documents and hits that a failure record names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import typed_date
from ..functions.text import basename, document_link, strip, url_quote
from .documents import enriched_timeline, timeline

#: Documents and hits that a failure record names, and characters of a hit's text that it shows (fixed values).
MOST_NAMED, PREVIEW = 12, 180
#: What is said of the codes of a failed request.
FAILURES = {
    "request_timed_out": "Request to local model timed out.",
    "empty_model_response": "Model returned an empty response.",
    "invalid_json_response": "Model returned invalid JSON.",
    "request_error": "Could not reach local model service.",
    "no_response": "Model returned no response.",
}
#: How the evidence of a field begins that was filled without the model.
FALLBACK, FALLBACK_REASON, NO_REASON = "fallback due to llm", "Fallback due to LLM unavailability:", "AI generation unavailable."


def _said(c: Column) -> Column:
    """Text without space at its ends; null is empty."""
    return strip(F.coalesce(c, F.lit("")))


def timeline_page(events: DataFrame, docs: DataFrame, client: str | None = None, kind: str | None = None, contact: str | None = None, date_from: str | None = None, date_to: str | None = None, limit: int = 300, tie: str = "event_id") -> DataFrame:
    """The newest timeline rows with their documents, of which those of a kind, a contact (a part of any of the client's contacts, case put
    aside) and a time stay. The limit comes before all filters but the client's; bounds are dates as users type them (one that is
    no date bounds nothing), and a row whose own date is none fails both."""
    out = enriched_timeline(timeline(events, client, limit, tie=tie), docs)
    if contact and contact.strip():
        out = out.where(F.contains(F.lower(F.array_join(F.coalesce("client_contacts", F.array().cast("array<string>")), " ")), F.lit(contact.strip().lower())))
    if kind and kind.strip():
        out = out.where(F.col("document_kind") == kind.strip())
    at = typed_date(F.col("event_date"))
    for bound, passes in ((date_from, lambda b: at >= b), (date_to, lambda b: at <= b)):
        if bound:
            b = typed_date(F.lit(bound))
            out = out.where(b.isNull() | (at.isNotNull() & passes(b)))
    return out


def report_links(reports: DataFrame) -> DataFrame:
    """Reports with their file's name, links to the text and to its versions, and whether they have no date."""
    path = F.coalesce("source_path", F.lit(""))
    return reports.withColumns({
        "document_name": basename(path),
        "document_href": document_link(path),
        "versions_href": F.concat(F.lit("/report/versions?path="), url_quote(path)),
        "missing_date": F.coalesce("report_date", F.lit("")) == "",
    })


def version_links(versions: DataFrame) -> DataFrame:
    """Labelled versions of a path with the link to their text."""
    return versions.withColumn("document_href", document_link(F.coalesce("path", F.lit(""))))


def node_links(nodes: DataFrame) -> DataFrame:
    """Profile nodes whose ``source_reports`` (structs of path and date) have names and links; those without a path go."""
    told = F.filter(F.coalesce("source_reports", F.array().cast("array<struct<path:string,date:string>>")), lambda r: _said(r["path"]) != "")

    def linked(r: Column) -> Column:
        path = strip(r["path"])
        return F.struct(path.alias("path"), r["date"].alias("date"), basename(path).alias("name"), document_link(path).alias("href"))

    return nodes.withColumn("source_reports", F.transform(told, linked))


def history_labels(states: DataFrame) -> DataFrame:
    """Replaced states of nodes with what replaced them (``superseded_by``, a path) in words and as a link."""
    doc = F.nullif("superseded_by", F.lit(""))
    label = F.when(doc.isNotNull(), F.concat(F.lit("Superseded by "), basename(doc))).otherwise("Superseded")
    return states.withColumns({"label": label, "superseded_href": document_link(doc)})


def key_field_rows(projects: DataFrame, definitions: list[tuple[str, str]], model_there: bool = True) -> DataFrame:
    """Every defined field (key, label) of every project as its page shows it.

    ``projects``: client_name, project_key and ``fields``, a map from key to a struct of strings value, status, evidence, method and
    error_message. A field that isn't stored is empty. Without a method the evidence tells a fallback, and any status a model's
    answer; a fallback without a message takes its reason from the evidence. ``needs_generation``: empty, and not known as absent.
    """
    names = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(k).alias("key"), F.lit(label).alias("label")) for i, (k, label) in enumerate(definitions)])
    rows = projects.select("client_name", "project_key", "fields", F.explode(names).alias("d")).withColumn("f", F.try_element_at("fields", F.col("d.key")))
    rows = rows.select("client_name", "project_key", "d.*", *[_said(F.col(f"f.{c}")).alias(c) for c in ("value", "status", "evidence", "method", "error_message")])
    fell_back = F.startswith(F.lower("evidence"), F.lit(FALLBACK))
    method = F.when(F.col("method") != "", F.lower("method")).when(fell_back, "fallback").when(F.col("status") != "", "ai").otherwise("")
    reason = F.coalesce(F.nullif(strip(F.substring("evidence", len(FALLBACK_REASON) + 1, 1 << 30)), F.lit("")), F.lit(NO_REASON))
    asked = (F.col("error_message") == "") & (F.col("method") == "fallback")
    message = F.when(asked & F.startswith("evidence", F.lit(FALLBACK_REASON)), reason).when(asked & fell_back, F.col("evidence")).otherwise(F.col("error_message"))
    rows = rows.withColumn("method", method).withColumn("error_message", message)
    return rows.withColumn("needs_generation", F.lit(model_there) & (F.col("value") == "") & (F.col("status") != "absent")).drop("evidence")


def failure_message(code: Column) -> Column:
    """What is said of a failed request."""
    http = "http_error_"
    known = reduce(lambda w, kv: w.when(code == kv[0], kv[1]), FAILURES.items(), F.when(F.lit(False), ""))
    told = F.concat(F.lit("Local model service returned HTTP error ("), F.replace(code, F.lit(http)), F.lit(")."))
    return F.when(F.startswith(code, F.lit(http)), told).otherwise(F.coalesce(known, F.concat(F.lit("Model request failed ("), code, F.lit(")."))))


def failure_records(failed: DataFrame, docs: DataFrame, hits: DataFrame) -> DataFrame:
    """Records of failed project summaries, as the failure table and its log keep them.

    ``failed``: client_name, project_key, project_name, strategy, error_code, error_message (null: told by the code), query_text;
    ``docs``: client_name, project_key, position from 1, title, document_name; ``hits``: client_name, project_key, rank from 1, score,
    hit_client, source_document, chunk_text. All documents are counted; the first twelve give their titles (else names), and
    the first twelve hits are kept with the beginning of their text.
    """
    key = ["client_name", "project_key"]
    blank = F.array().cast("array<string>")
    first = lambda at, value: F.transform(F.array_sort(F.collect_list(F.when(F.col(at) <= MOST_NAMED, F.struct(F.col(at).alias("at"), value.alias("v"))))), lambda x: x["v"])
    title = F.coalesce(F.nullif("title", F.lit("")), F.col("document_name"), F.lit(""))
    titles = docs.groupBy(*key).agg(F.count(F.lit(1)).alias("document_count"), first("position", title).alias("document_titles"))
    hit = F.struct("score", F.col("hit_client").alias("client_name"), "source_document", F.substring(F.coalesce("chunk_text", F.lit("")), 1, PREVIEW).alias("chunk_preview"))
    kept = hits.where(F.col("rank") <= MOST_NAMED).groupBy(*key).agg(first("rank", hit).alias("rag_hits"))
    code = F.coalesce(F.nullif("error_code", F.lit("")), F.lit("unknown_error"))
    out = failed.withColumn("error_message", F.coalesce(F.nullif("error_message", F.lit("")), F.when(F.coalesce("error_code", F.lit("")) == "", "Unknown error.").otherwise(failure_message(code))))
    out = out.withColumn("error_code", code).withColumn("query_text", F.coalesce("query_text", F.lit(""))).join(titles, key, "left").join(kept, key, "left")
    return out.withColumns({"document_count": F.coalesce("document_count", F.lit(0).cast("long")), "document_titles": F.coalesce("document_titles", blank)})
