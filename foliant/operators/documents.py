"""Operators over document rows: latest version, lookups, metrics, data quality, windows.

A document row has at least: doc_id, source_path, ingested_at, document_kind, client_name,
project_key, report_date (ISO text or null) and the money columns. All are single grouped
aggregates or windows; none loops over clients.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename, document_link, forward, ordered_union


def clamp(n: int, most: int = 2000) -> int:
    return max(1, min(n, most))


def latest(docs: DataFrame, path: str = "source_path", at: str = "ingested_at", tie: str = "doc_id") -> DataFrame:
    """The newest row of each path. ``row_number() = 1`` is cut before the shuffle (window group limit)."""
    w = Window.partitionBy(path).orderBy(F.desc(at), F.desc(tie))
    return docs.where(F.col(path).isNotNull() & (F.col(path) != "")).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def new_only(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming rows whose path and content are not stored yet."""
    return incoming.join(stored.select("source_path", "content_hash").distinct(), ["source_path", "content_hash"], "left_anti")


def client_metrics(docs: DataFrame) -> DataFrame:
    """Per client, case put aside: documents, projects, date range, money totals and margin, over latest rows."""
    money = ["revenue_amount", "cost_amount", "gross_profit"]
    rev, cost, gp = (F.coalesce(c, F.lit(0.0)) for c in money)
    has = (rev != 0) | (cost != 0) | (gp != 0)
    d2 = lambda c: F.coalesce(F.sum(F.when(has, c).cast("decimal(18,2)")), F.lit(0)).cast("double")
    one = latest(docs).withColumn("client_key", F.lower(F.trim("client_name"))).where("client_key != ''")
    date = F.nullif(F.col("report_date"), F.lit(""))
    out = one.groupBy("client_key").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_distinct(F.nullif(F.col("project_key"), F.lit(""))).alias("projects"),
        F.coalesce(F.min(date), F.lit("")).alias("first_report"),
        F.coalesce(F.max(date), F.lit("")).alias("last_report"),
        F.count_if(F.col("financial_type").isin("revenue", "cost", "mixed") | (rev != 0) | (cost != 0)).alias("financial_documents"),
        F.count_if(has).alias("documents_with_financials"),
        d2(rev).alias("revenue_total"),
        d2(cost).alias("cost_total"),
        d2(F.when(gp != 0, gp).otherwise(rev - cost)).alias("gross_profit_total"),
    )
    margin = F.when(F.col("revenue_total") > 0, F.col("gross_profit_total") / F.col("revenue_total") * 100).otherwise(0.0)
    return out.withColumn("gross_margin_pct", F.round(margin, 2)).withColumn("avg_profit", F.round(F.col("gross_profit_total") / F.greatest(F.lit(1), F.col("documents_with_financials")), 4))


def kind_histogram(docs: DataFrame) -> DataFrame:
    return docs.groupBy(F.coalesce(F.nullif(F.col("document_kind"), F.lit("")), F.lit("unknown")).alias("document_kind")).agg(F.count(F.lit(1)).alias("n"))


def kind_counts(docs: DataFrame) -> DataFrame:
    """A map of kinds and counts per client."""
    per = docs.groupBy("client_name", "document_kind").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("client_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("document_kind", "n")))).alias("document_kind_counts"))


def client_summary(profiles: DataFrame, timeline: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows of each of the three tables per client."""
    parts = [t.where("client_name is not null").groupBy("client_name").agg(F.count(F.lit(1)).alias(n)) for t, n in ((profiles, "profile_nodes"), (timeline, "timeline_events"), (vectors, "vector_chunks"))]
    out = parts[0].join(parts[1], "client_name", "full").join(parts[2], "client_name", "full")
    return out.fillna(0)


def distinct_values(docs: DataFrame, column: str) -> DataFrame:
    return docs.select(F.trim(column).alias(column)).where(f"{column} != ''").distinct()


def contacts(docs: DataFrame) -> DataFrame:
    return docs.select("client_name", F.explode("contacts").alias("contact")).withColumn("contact", F.trim("contact")).where("contact != ''").distinct()


def reports(docs: DataFrame, client: str | None = None, kind: str | None = None, contact: str | None = None, date_from: str | None = None, date_to: str | None = None, limit: int = 2000) -> DataFrame:
    """Report rows, newest first. Undated reports pass the date bounds; a kind other than report gives nothing."""
    out = docs.where("document_kind = 'report'")
    if client:
        out = out.where(F.col("client_name") == client)
    if kind:
        out = out.where(F.col("document_kind") == kind)
    if contact:
        out = out.where(F.instr(F.lower(F.concat_ws(" ", "contacts")), contact.lower()) > 0)
    undated = F.col("report_date").isNull() | (F.col("report_date") == "")
    if date_from:
        out = out.where(undated | (F.col("report_date") >= date_from))
    if date_to:
        out = out.where(undated | (F.col("report_date") <= date_to))
    return out.orderBy(F.desc("ingested_at"), F.desc("doc_id")).limit(clamp(limit))


def timeline(events: DataFrame, client: str | None = None, limit: int = 200, date_from: str | None = None, date_to: str | None = None, tie: str = "event_id") -> DataFrame:
    """Timeline rows, newest first. The limit comes before the date bounds, and undated rows fail both."""
    out = events if client is None else events.where(F.col("client_name") == client)
    out = out.orderBy(F.desc(F.coalesce("event_date", "created_at")), F.desc(tie)).limit(clamp(limit))
    if date_from:
        out = out.where(F.col("event_date") >= date_from)
    if date_to:
        out = out.where(F.col("event_date") <= date_to)
    return out


def enriched_timeline(events: DataFrame, docs: DataFrame) -> DataFrame:
    """Timeline rows with their latest document (its project and kind, name and link), the client's contacts and a date to show."""
    also = [c for c in ("project_key", "project_name", "project_code", "source_type") if c in docs.columns]
    doc = latest(docs).select(F.col("source_path").alias("source_document"), "document_kind", "report_date", *also)
    who = contacts(docs).groupBy("client_name").agg(F.array_sort(F.collect_set("contact")).alias("client_contacts"))
    out = events.join(doc, "source_document", "left").join(who, "client_name", "left")
    path = F.coalesce("source_document", F.lit(""))
    out = out.withColumn("document_name", basename(path)).withColumn("document_href", document_link(path))
    return out.withColumn("document_kind", F.coalesce("document_kind", F.lit("unknown"))).withColumn("display_date", F.coalesce("event_date", "report_date", "created_at")).withColumn("missing_date", F.col("event_date").isNull() & F.col("report_date").isNull())


def metadata_matches(filters: dict[str, object], columns: dict[str, str]) -> Column:
    """The metadata filter language: a list wants any of its values, a scalar its own; case and
    outer spaces don't count, an empty list doesn't filter, null is the empty text."""
    norm = lambda v: "" if v is None else str(v).strip().lower()
    ok = F.lit(True)
    for key, wanted in filters.items():
        many = isinstance(wanted, (list, tuple, set))
        if many and not wanted:
            continue
        values = [norm(v) for v in (wanted if many else [wanted])]
        if columns.get(key, "").startswith("array"):
            ok &= F.arrays_overlap(F.transform(F.coalesce(F.col(key), F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), F.array(*[F.lit(v) for v in values]))
        else:
            ok &= F.lower(F.trim(F.coalesce(F.col(key).cast("string"), F.lit("")))).isin(*values)
    return ok


def data_quality(docs: DataFrame) -> DataFrame:
    return docs.agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.col("client_name").isNull() | (F.col("client_name") == "")).alias("null_client"),
        F.count_if((F.col("document_kind") == "report") & (F.col("report_date").isNull() | (F.col("report_date") == ""))).alias("reports_missing_date"),
    )


def case_collisions(docs: DataFrame) -> DataFrame:
    names = docs.select(F.trim("client_name").alias("name")).where("name != ''")
    return names.groupBy(F.lower("name").alias("folded")).agg(F.array_sort(F.collect_set("name")).alias("names")).where(F.size("names") > 1)


#: What versions are compared by, in this order, and how changes are worded.
VERSION_FIELDS = ("report_type", "document_kind", "client_name", "report_date")
VERSION_LISTS = {"authors": "Authors", "contacts": "Contacts", "findings": "Key findings", "recommendations": "Recommendations"}
FIRST_VERSION, NEW_CONTENT, NO_CHANGE = "Initial version captured.", "Document content changed from previous version.", "No significant structured changes detected."


def versions(docs: DataFrame) -> DataFrame:
    """Versions of each path with their label and what changed against the version before.

    ``docs``: source_path, content_hash, ingested_at, doc_id, the fields of ``VERSION_FIELDS`` (null is told as ``None``)
    and the lists of ``VERSION_LISTS``, of which the first four values that came or went are named. A content seen before under the
    same path is no new version.
    """
    key = forward(F.col("source_path"))
    first = Window.partitionBy("path", "content_hash").orderBy("ingested_at", "doc_id")
    own = docs.withColumn("path", key).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    w = Window.partitionBy("path").orderBy("ingested_at", "doc_id")
    compared = [*VERSION_FIELDS, "content_hash", *VERSION_LISTS]
    own = own.withColumn("__n", F.row_number().over(w)).withColumn("__p", F.lag(F.struct(*compared)).over(w))
    quoted = lambda c: F.concat(F.lit("'"), F.coalesce(c.cast("string"), F.lit("None")), F.lit("'"))
    before = lambda c: F.col(f"__p.{c}")
    parts = [F.when(~before(c).eqNullSafe(F.col(c)), F.concat(F.lit(f"{c} changed from "), quoted(before(c)), F.lit(" to "), quoted(F.col(c)), F.lit("."))) for c in VERSION_FIELDS]
    parts.append(F.when(before("content_hash") != F.col("content_hash"), NEW_CONTENT))
    none = F.array().cast("array<string>")
    for c, label in VERSION_LISTS.items():
        old, new = F.coalesce(before(c), none), F.coalesce(F.col(c), none)
        for word, values in (("added", F.array_except(new, old)), ("removed", F.array_except(old, new))):
            parts.append(F.when(F.size(values) > 0, F.concat(F.lit(f"{label} {word}: "), F.array_join(F.slice(F.array_sort(values), 1, 4), ", "), F.lit("."))))
    changes = F.array_compact(F.array(*parts))
    diff = F.when(F.col("__n") == 1, F.array(F.lit(FIRST_VERSION))).when(F.size(changes) == 0, F.array(F.lit(NO_CHANGE))).otherwise(changes)
    return own.withColumn("changes", diff).withColumn("label", F.concat(F.lit("Version "), F.col("__n"))).withColumn("version", F.col("__n")).drop("__n", "__p")


def node_history(rows: DataFrame, fact_columns: list[str]) -> DataFrame:
    """Profile nodes as slowly changing rows: each state, whether it replaced another one, and whether it
    is the current one. ``rows``: client_name, node_path, ingested_at, doc_id and the facts."""
    w = Window.partitionBy("client_name", "node_path").orderBy("ingested_at", "doc_id")
    facts = F.struct(*fact_columns)
    changed = F.lag(facts).over(w).isNotNull() & ~F.lag(facts).over(w).eqNullSafe(facts)
    later = Window.partitionBy("client_name", "node_path").orderBy(F.desc("ingested_at"), F.desc("doc_id"))
    return rows.withColumn("superseded", changed).withColumn("is_current", F.row_number().over(later) == 1)


def project_accumulation(rows: DataFrame) -> DataFrame:
    """Running unions of a project's kinds, authors, contacts and references, and its last known date.

    Only the row that names a value first adds it, so the running lists hold each value once; blanks are left out.
    """
    order = ["ingested_at", "doc_id"]
    w = Window.partitionBy("client_name", "project_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    lists = {"kinds": F.array("document_kind"), "authors": F.col("authors"), "contacts": F.col("contacts"), "refs": F.col("related_references")}
    named = lambda n: lambda x: F.struct(F.lit(n).alias("list"), x.alias("value"))
    every = F.concat(*[F.transform(ordered_union(c), named(n)) for n, c in lists.items()])
    said = rows.select("client_name", "project_key", *order, F.posexplode(every).alias("__at", "__x")).select("client_name", "project_key", *order, "__at", "__x.*")
    seen = Window.partitionBy("client_name", "project_key", "list", "value").orderBy(*order, "__at")
    new = said.withColumn("__n", F.row_number().over(seen)).where("__n = 1").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("__at", "list", "value"))).alias("__new"))
    out = rows.join(new, "doc_id", "left")
    own = lambda n: F.transform(F.filter("__new", lambda x: x["list"] == n), lambda x: x["value"])
    out = out.withColumns({f"{n}_so_far": F.flatten(F.collect_list(own(n)).over(w)) for n in lists})
    return out.withColumn("date_so_far", F.last(F.nullif("report_date", F.lit("")), ignorenulls=True).over(w)).drop("__new")


def project_rollup(docs: DataFrame) -> DataFrame:
    """One row per client and project: first name and code, references, people, counts, latest date."""
    order = F.struct("ingested_at", "doc_id")
    pick = lambda c: F.min_by(F.nullif(F.col(c), F.lit("")), F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), order))
    return docs.where("project_key != ''").groupBy("client_name", "project_key").agg(
        pick("project_name").alias("project_name"),
        pick("project_code").alias("project_code"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("related_references")))).alias("references"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("contacts")))).alias("contacts"),
        F.count_if(F.col("document_kind") == "report").alias("reports"),
        F.count_if(F.col("document_kind") != "report").alias("other_documents"),
        F.max("report_date").alias("latest_date"),
    )


def greedy_budget(rows: DataFrame, partition: list[str], order: list[Column], size: Column, budget: int) -> DataFrame:
    """Rows before the first that would overrun the budget; the first row always stays."""
    w = Window.partitionBy(*partition).orderBy(*order)
    run = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    over = F.max((F.col("__run") > budget).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__run", run).withColumn("__over", over).withColumn("__n", F.row_number().over(w)).where("__over = 0 or __n = 1").drop("__run", "__over", "__n")
