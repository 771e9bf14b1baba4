"""Named queries over the star-schema tables, each with its SQL twin where SQL can say it.

Business documents are rendered from orders: the text goes through the same extraction as real
files, and the SQL computes the expected fields from the structured columns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dates, extract, money, text
from ..operators import documents as docs_ops
from ..operators import events as event_ops
from ..operators import cascade, derived, evaluation, fields, grouping, pages, resolve, retrieval, scans, store
from ..streaming import ingest

SPELLED_SQL = "spelled as (select *, case when doc_id % 5 = 0 then upper(client_name) when doc_id % 7 = 0 then lower(client_name) else client_name end as spelt from docs)"

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql.replace("{docs}", RENDERED_SQL).replace("{spelled}", SPELLED_SQL)
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# Rendered documents ---------------------------------------------------------------------------

RENDERED_SQL = """docs as (
 select o_orderkey as doc_id, c_name as client_name, ['invoice','quote','purchase_order','report'][(o_orderkey % 4 + 1)::int] as document_kind,
  'docs/' || ['invoice','quote','purchase_order','report'][(o_orderkey % 4 + 1)::int] || '_' || c_custkey || '.txt' as source_path, 'M. ' || c_mktsegment as contact,
  'PRJ-' || n_nationkey as project_code, o_orderpriority as project_name, strftime(o_orderdate, '%Y-%m-%d') as report_date, o_orderdate as ingested_at,
  cast(o_totalprice as decimal(18,2))::double as amount, o_orderkey % 4 < 2 as is_revenue, o_orderkey // 4 % 4 as spelling
 from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)"""


def rendered(spark: SparkSession, d: str) -> DataFrame:
    """One text document per order, in four kinds; a customer's orders of a kind are versions of one path.

    Labels, dates and amounts are spelt in four ways.
    """
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    c = t(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    n = t(spark, d, "nation").select("n_nationkey")
    # A table of few row groups would leave all patterns to as many tasks.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    o = o.repartition(parts, "o_orderkey")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    of_kind = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    way = F.pmod(F.floor(F.col("o_orderkey") / 4), F.lit(4))
    spelt = lambda *ways: reduce(lambda w, kw: w.when(way == kw[0], kw[1]), enumerate(ways), F.when(F.lit(False), ""))
    text_of = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    name, project, code = F.col("c_name"), F.col("o_orderpriority"), text_of("PRJ-", F.col("n_nationkey").cast("string"))
    day = lambda shape: F.date_format("o_orderdate", shape)
    amount = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    revenue = F.col("o_orderkey") % 4 < 2
    label = lambda a, b: F.when(revenue, a).otherwise(b)
    kind = of_kind("invoice", "quote", "purchase_order", "report")
    body = F.concat_ws(
        "\n",
        of_kind("Sales Invoice", "Quotation", "Purchase Order", "Inspection Report"),
        spelt(text_of("Client Name: ", name), text_of("client - ", name), text_of("For Client: ", name), text_of("  CLIENT:\n  **", name, "**")),
        text_of(spelt("Contact: ", "Client Contact - ", "contact : ", "CONTACT:\n"), "M. ", F.col("c_mktsegment")),
        text_of(spelt("Project: ", "Project Name - ", "project name : ", "PROJECT:"), project),
        text_of(spelt("Project Code: ", "Job Code: ", "Reference: ", "project code - "), code),
        spelt(text_of("Date: ", day("yyyy-MM-dd")), text_of("Report Date: ", day("MMMM d, yyyy")), text_of("Date - ", day("d MMM yyyy")), text_of("Date: ", day("MM/dd/yyyy"))),
        spelt(text_of(label("Invoice Total: USD ", "Total Cost: USD "), amount), text_of(label("- **Quote Total** | ", "- **Actual Cost** | "), amount), text_of(label("Invoice total\n\nUSD ", "Estimated cost\n\nUSD "), amount), text_of(label("Contract Value ", "Supplier Cost "), amount)),
    )
    return j.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("docs/"), kind, F.lit("_"), F.col("c_custkey").cast("string"), F.lit(".txt")).alias("source_path"), F.col("o_orderdate").alias("ingested_at"), text.by_itself(body).alias("text"))


def analysed(spark: SparkSession, d: str) -> DataFrame:
    """Rendered documents with all that classification and extraction find."""
    return with_fields(rendered(spark, d)).drop("text")


def with_fields(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (doc_id, source_path, ingested_at, text, and columns in ``keep``) with all that classification and extraction find.

    Every field is a column of its own, so a query evaluates the patterns of those fields alone that it reads, each once a row.
    """
    t, low = F.col("__t"), F.col("__low")
    r = docs.withColumn("__t", F.substring("text", 1, extract.REGEX_CHARS)).withColumn("__low", F.lower("__t"))
    found, raw = extract.text_fields(t, low), extract.raw_finds(t, low)
    best, report = extract.kind_scores(low, F.col("source_path"))
    own = ("report_type", "findings", "recommendations", "project_name", "project_code")
    r = r.select("doc_id", "source_path", "ingested_at", "text", *keep, "__t", text.once(best).alias("__best"), text.once(report).alias("__report"), text.once(extract.found_client(t, low)).alias("__client"), *[text.once(found[c]).alias(c) for c in own], *[text.once(raw[c]).alias(c) for c in raw])
    kind = extract.kind_of({"best": F.col("__best"), "report": F.col("__report")})[1]
    lists = {c: text.once(text.ordered_union(F.col(c))) for c in extract.LISTS}
    r = r.withColumns({"document_kind": text.once(kind), "client_name": text.once(extract.client_of(F.col("__client"))), "report_date": text.once(dates.report_date(t, F.col("report_date"))), **lists})
    m = money.with_financials(r)
    return m.select(
        "doc_id", "source_path", "ingested_at", "text", *keep, text.once(text.content_hash(F.col("text"))).alias("content_hash"), text.once(text.guess_title(F.col("text"), F.col("source_path"))).alias("title"), "document_kind", "client_name", "report_type", "report_date", "authors", "contacts", "findings", "recommendations",
        text.slug(F.col("project_code")).alias("project_key"), "project_name", "project_code", "related_references", *[c for c in m.columns if c not in r.columns],
    )


@query("client_metrics", """with {docs}, latest as (select * from (select *, row_number() over (partition by source_path order by ingested_at desc, doc_id desc) n from docs) where n = 1),
 g as (select lower(client_name) client_key, count(*) documents, count(distinct project_code) projects, min(report_date) first_report, max(report_date) last_report, count(*) financial_documents,
  count(*) documents_with_financials, coalesce(sum(case when is_revenue then amount::decimal(18,2) end), 0)::double revenue_total, coalesce(sum(case when not is_revenue then amount::decimal(18,2) end), 0)::double cost_total from latest group by 1)
 select client_key, documents, projects, first_report, last_report, financial_documents, documents_with_financials, revenue_total, cost_total, (revenue_total::decimal(18,2) - cost_total::decimal(18,2))::double gross_profit_total,
  case when revenue_total > 0 then round((revenue_total::decimal(18,2) - cost_total::decimal(18,2))::double / revenue_total * 100, 2) else 0.0 end gross_margin_pct,
  round((revenue_total::decimal(18,2) - cost_total::decimal(18,2))::double / greatest(1, documents_with_financials), 4) avg_profit from g""")
def client_metrics(spark, d):
    # Only a path's newest version counts, so the patterns run on those alone.
    return docs_ops.client_metrics(with_fields(docs_ops.latest(rendered(spark, d))))


@query("classified_documents", "with {docs} select doc_id, document_kind, true as is_client_related from docs")
def classified(spark, d):
    return rendered(spark, d).withColumn("c", extract.classify(F.col("text"), F.col("source_path"))).select("doc_id", "c.document_kind", "c.is_client_related")


@query("extracted_fields", "with {docs} select doc_id, client_name, report_date, project_code, project_name from docs")
def extracted_fields(spark, d):
    return analysed(spark, d).select("doc_id", "client_name", "report_date", "project_code", "project_name")


@query("document_financials", "with {docs} select doc_id, case when is_revenue then 'revenue' else 'cost' end financial_type, case when spelling in (0, 2) then 'USD' else '' end currency, case when is_revenue then amount end revenue_amount, case when not is_revenue then amount end cost_amount from docs")
def document_financials(spark, d):
    return analysed(spark, d).select("doc_id", "financial_type", "currency", "revenue_amount", "cost_amount")


@query("kind_histogram", "with {docs} select document_kind, count(*) n from docs group by 1")
def kind_histogram(spark, d):
    return docs_ops.kind_histogram(analysed(spark, d))


@query("kind_counts", "with {docs}, k as (select client_name, document_kind, count(*) n from docs group by 1, 2) select client_name, string_agg(document_kind || '=' || n, ',' order by document_kind) kinds from k group by 1")
def kind_counts(spark, d):
    m = docs_ops.kind_counts(analysed(spark, d))
    return m.select("client_name", F.array_join(F.transform(F.map_entries("document_kind_counts"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("kinds"))


@query("latest_documents", "with {docs} select source_path, doc_id from (select *, row_number() over (partition by source_path order by ingested_at desc, doc_id desc) n from docs) where n = 1")
def latest_documents(spark, d):
    return docs_ops.latest(rendered(spark, d)).select("source_path", "doc_id")


@query("client_summary", "with {docs}, a as (select client_name, count(*) profile_nodes from docs where document_kind = 'report' group by 1), b as (select client_name, count(*) timeline_events from docs where document_kind = 'quote' group by 1), c as (select client_name, count(*) vector_chunks from docs group by 1) select client_name, coalesce(profile_nodes, 0) profile_nodes, coalesce(timeline_events, 0) timeline_events, coalesce(vector_chunks, 0) vector_chunks from a full join b using (client_name) full join c using (client_name)")
def client_summary(spark, d):
    # Read three times, so what the patterns found is written once.
    a = grouping.checkpointed(analysed(spark, d).select("client_name", "document_kind"))
    return docs_ops.client_summary(a.where("document_kind = 'report'"), a.where("document_kind = 'quote'"), a)


@query("report_lookup", "with {docs} select doc_id, report_date from docs where document_kind = 'report' and report_date >= '1995-01-01' and report_date <= '1996-12-31' order by ingested_at desc, doc_id desc limit 100")
def report_lookup(spark, d):
    return docs_ops.reports(analysed(spark, d), date_from="1995-01-01", date_to="1996-12-31", limit=100).select("doc_id", "report_date")


@query("metadata_filter", "with {docs} select doc_id from docs where document_kind in ('quote', 'report') and project_code = 'PRJ-7'")
def metadata_filter(spark, d):
    a = analysed(spark, d)
    return a.where(docs_ops.metadata_matches({"document_kind": ["Quote ", "report"], "project_code": "prj-7", "title": []}, dict(a.dtypes))).select("doc_id")


@query("data_quality", "with {docs} select count(*) documents, count(*) filter (doc_id % 9 = 0) null_client, count(*) filter (document_kind = 'report' and doc_id % 11 = 0) reports_missing_date from docs")
def data_quality(spark, d):
    """With some clients and dates blotted out of the texts."""
    blot = F.when(F.col("doc_id") % 9 == 0, F.regexp_replace("text", "(?i)client( name)? *[:-]", "")).otherwise(F.col("text"))
    blot = F.when(F.col("doc_id") % 11 == 0, F.regexp_replace(blot, "(?im)^(report )?date.*$", "")).otherwise(blot)
    return docs_ops.data_quality(with_fields(rendered(spark, d).withColumn("text", blot)))


@query("filename_mismatch", "with {docs} select doc_id from docs where document_kind = 'invoice' and doc_id % 3 = 0 and spelling <> 1")
def filename_mismatch(spark, d):
    """Some invoices come in files that are named for quotes; one that speaks of a quote total then is one."""
    named = F.when(F.col("doc_id") % 3 == 0, F.replace("source_path", F.lit("invoice_"), F.lit("quote_"))).otherwise(F.col("source_path"))
    a = with_fields(rendered(spark, d).withColumn("source_path", named))
    return a.where(extract.filename_mismatch(F.col("source_path"), F.col("document_kind"))).select("doc_id")


@query("report_versions", """with {docs}, r as (select *, case when doc_id % 13 = 0 then upper(client_name) else client_name end shown from docs), v as (select *, lag(report_date) over w p, lag(shown) over w pc, row_number() over w n from r window w as (partition by source_path order by ingested_at, doc_id))
 select source_path, n::int as version, 'Version ' || n as label, case when n = 1 then 'Initial version captured.' else concat_ws(' ', case when pc <> shown then 'client_name changed from ''' || pc || ''' to ''' || shown || '''.' end, case when p <> report_date then 'report_date changed from ''' || p || ''' to ''' || report_date || '''.' end, 'Document content changed from previous version.') end changes from v""")
def report_versions(spark, d):
    """Some versions spell their client in capitals."""
    a = analysed(spark, d).withColumn("client_name", F.when(F.col("doc_id") % 13 == 0, F.upper("client_name")).otherwise(F.col("client_name")))
    return docs_ops.versions(a).select(F.col("path").alias("source_path"), "version", "label", F.array_join("changes", " ").alias("changes"))


@query("node_history", "with {docs} select doc_id, coalesce(lag(document_kind) over w is distinct from document_kind and row_number() over w > 1, false) superseded, row_number() over (partition by client_name, project_code order by ingested_at desc, doc_id desc) = 1 is_current from docs window w as (partition by client_name, project_code order by ingested_at, doc_id)")
def node_history(spark, d):
    a = analysed(spark, d).withColumn("node_path", F.col("project_key"))
    return docs_ops.node_history(a.select("client_name", "node_path", "ingested_at", "doc_id", "document_kind"), ["document_kind"]).select("doc_id", "superseded", "is_current")


@query("project_accumulation", "with {docs} select doc_id, (count(distinct document_kind) over w)::int n_kinds, (count(distinct contact) over w)::int n_contacts, report_date date_so_far from docs window w as (partition by client_name, project_code order by ingested_at, doc_id rows unbounded preceding)")
def project_accumulation(spark, d):
    a = analysed(spark, d).select("doc_id", "client_name", "project_key", "ingested_at", "document_kind", "authors", "contacts", "related_references", "report_date")
    # Read twice, so what the patterns found is written once.
    return docs_ops.project_accumulation(grouping.checkpointed(a)).select("doc_id", F.size("kinds_so_far").alias("n_kinds"), F.size("contacts_so_far").alias("n_contacts"), "date_so_far")


@query("project_rollup", "with {docs} select client_name, project_code, count(*) filter (document_kind = 'report') reports, count(*) filter (document_kind <> 'report') other_documents, max(report_date) latest_date from docs group by 1, 2")
def project_rollup(spark, d):
    return docs_ops.project_rollup(analysed(spark, d)).select("client_name", "project_code", "reports", "other_documents", "latest_date")


@query("enriched_timeline", """with {docs}, l as (select * from (select *, row_number() over (partition by source_path order by ingested_at desc, doc_id desc) n from docs) where n = 1)
 select docs.doc_id, l.document_kind, docs.contact client_contacts, docs.doc_id % 3 = 0 and l.doc_id % 5 = 0 missing_date,
  case when docs.doc_id % 3 <> 0 then docs.report_date when l.doc_id % 5 <> 0 then l.report_date else '9999' end display_date from docs join l using (source_path)""")
def enriched_timeline(spark, d):
    # Read three times, so what the patterns found is written once.
    a = grouping.checkpointed(analysed(spark, d).select("doc_id", "client_name", "source_path", "ingested_at", "document_kind", "report_date", "contacts", "project_key", "project_name", "project_code"))
    ev = a.select("doc_id", "client_name", F.col("source_path").alias("source_document"), F.when(F.col("doc_id") % 3 != 0, F.col("report_date")).alias("event_date"), F.lit("9999").alias("created_at"))
    known = a.withColumn("report_date", F.when(F.col("doc_id") % 5 != 0, F.col("report_date")))
    return docs_ops.enriched_timeline(ev, known).select("doc_id", "document_kind", F.array_join("client_contacts", ",").alias("client_contacts"), "missing_date", "display_date")


@query("timeline_page", """with {docs}, l as (select * from (select *, row_number() over (partition by source_path order by ingested_at desc, doc_id desc) n from docs) where n = 1),
 e as (select *, case when doc_id % 3 <> 0 then report_date end event_date, client_name || ' ' || document_kind said from docs order by coalesce(case when doc_id % 3 <> 0 then report_date end, '1995-06-01') desc, doc_id desc limit 2000)
 select e.doc_id, e.event_date, l.document_kind, l.project_code, l.project_name, regexp_extract(e.source_path, '[^/]*$') document_name, '/document?path=' || replace(e.source_path, '/', '%2F') document_href from e join l using (source_path)
 where l.document_kind = 'quote' and e.contact ilike '%m. bu%' and e.event_date >= '2000-07-17' and e.event_date <= '2001-02-28'""")
def timeline_page(spark, d):
    """Of the newest 2,000 rows (each third undated) the quotes of some contacts in a time that is bounded in two spellings."""
    a = grouping.checkpointed(analysed(spark, d).select("doc_id", "client_name", "source_path", "ingested_at", "document_kind", "report_date", "contacts", "project_key", "project_name", "project_code"))
    ev = a.select("doc_id", "client_name", F.col("source_path").alias("source_document"), F.when(F.col("doc_id") % 3 != 0, F.col("report_date")).alias("event_date"), F.lit("1995-06-01").alias("created_at"))
    out = pages.timeline_page(ev, a, kind="quote", contact=" M. BU", date_from="17/07/2000", date_to="2001-02-28", limit=2000, tie="doc_id")
    return out.select("doc_id", "event_date", "document_kind", "project_code", "project_name", "document_name", "document_href")


@query("timeline_limit_then_filter", "with e as (select event_id, strftime(ts, '%Y-%m-%d') event_date from events order by strftime(ts, '%Y-%m-%d') desc, event_id desc limit 500) select event_id, event_date from e where event_id % 5 <> 0 and event_date <= (select strftime(max(ts) - interval 1 day, '%Y-%m-%d') from events)")
def timeline_limit(spark, d):
    """The newest 500 of all events; undated ones (each fifth, dated by its record) and those of the last day fail the bound."""
    day = F.date_format("ts", "yyyy-MM-dd")
    e = t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 != 0, day).alias("event_date"), day.alias("created_at"))
    last = e.agg(F.date_format(F.date_sub(F.max(F.to_date("created_at")), 1), "yyyy-MM-dd")).first()[0]
    return docs_ops.timeline(e, limit=500, date_to=last).select("event_id", "event_date")


# Clients --------------------------------------------------------------------------------------

def spelled(spark: SparkSession, d: str) -> DataFrame:
    """Rendered documents whose client is spelt in up to three ways."""
    c = F.col("client_name")
    return analysed(spark, d).withColumn("client_name", F.when(F.col("doc_id") % 5 == 0, F.upper(c)).when(F.col("doc_id") % 7 == 0, F.lower(c)).otherwise(c)).withColumn("source_stem", text.stem(F.col("source_path")))


@query("canonical_names", "with {docs}, {spelled}, v as (select lower(spelt) folded, spelt, count(*) n from spelled group by 1, 2) select folded, spelt canonical from (select *, row_number() over (partition by folded order by n desc, spelt) r from v) where r = 1")
def canonical_names(spark, d):
    return resolve.canonical_names(spelled(spark, d))


@query("case_collisions", "with {docs}, {spelled} select lower(spelt) folded, array_to_string(list_sort(list(distinct spelt)), '|') names from spelled group by 1 having count(distinct spelt) > 1")
def case_collisions(spark, d):
    return docs_ops.case_collisions(spelled(spark, d)).select("folded", F.array_join("names", "|").alias("names"))


@query("distinct_clients", "with {docs}, {spelled} select distinct spelt client_name from spelled")
def distinct_clients(spark, d):
    return docs_ops.distinct_values(spelled(spark, d), "client_name")


_DUPLICATES_SQL = """{docs}, {spelled}, s as (select spelt, regexp_replace(lower(spelt), '[^a-z0-9]', '', 'g') k, count(*) n, list(distinct lower(project_code)) codes, list(distinct regexp_replace(source_path, '.*/|[.]txt$', '', 'g')) stems from spelled group by 1),
 o as (select *, row_number() over (partition by k order by n desc, lower(spelt), spelt) place from s),
 p as (select t.spelt target, c.spelt source, t.n tn, c.n cn, 0.9::double + 0.03::double + case when list_has_any(t.codes, c.codes) then 0.02::double + 0.02::double + 0.03::double else 0 end + case when list_has_any(t.stems, c.stems) then 0.03::double else 0 end + case when least(t.n, c.n) >= 3 then 0.01::double else 0 end score
  from o t join o c on t.k = c.k and t.place = 1 and c.place > 1),
 found as (select target, source, round(least(score, 1.0), 6) confidence from p where score >= 0.95)"""


def _signs(spark, d):
    """What tells duplicate clients."""
    return spelled(spark, d).select("client_name", "doc_id", "project_code", "project_key", "related_references", "source_stem")


@query("duplicate_clients", "with " + _DUPLICATES_SQL + " select target, source, confidence from found")
def duplicate_clients(spark, d):
    """Documents that share a code share a reference, too: every text names its code as one."""
    # Documents are read once; the pairs found are written, so whoever reads them twice runs no pattern twice.
    return grouping.checkpointed(resolve.duplicate_clients(_signs(spark, d)).withColumn("confidence", F.round("confidence", 6)))


@query("auto_merged_clients", "with " + _DUPLICATES_SQL + " select coalesce(f.target, s.spelt) client_name, count(*) n from spelled s left join found f on f.source = s.spelt group by 1")
def auto_merged_clients(spark, d):
    """Documents of each client after sure duplicates have been merged."""
    docs = grouping.checkpointed(_signs(spark, d))
    merges = resolve.merge_map(resolve.duplicate_clients(docs))
    return store.rename_client(docs.select("client_name", "doc_id"), merges).groupBy("client_name").agg(F.count(F.lit(1)).alias("n"))


@query("clients_by_reference", "select distinct l_suppkey::varchar client_name from lineitem where l_partkey % 50 = 3")
def clients_by_reference(spark, d):
    li = t(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("client_name"), F.array(F.concat(F.lit(" part-"), F.col("l_partkey").cast("string"))).alias("related_references"))
    wanted = t(spark, d, "part").where("p_partkey % 50 = 3").select(F.concat(F.lit("PART-"), F.col("p_partkey").cast("string")).alias("ref"))
    return resolve.clients_by_reference(li, wanted)


@query("client_in_path", "select o_orderkey doc_id, c_name client_name from orders join customer on o_custkey = c_custkey")
def client_in_path(spark, d):
    o, c = t(spark, d, "orders").select("o_orderkey", "o_custkey"), t(spark, d, "customer").select("c_custkey", "c_name")
    paths = o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("in/"), F.regexp_replace("c_name", "[#_ ]", "-"), F.lit("/x.txt")).alias("source_path"))
    return resolve.client_in_path(paths, c.select(F.col("c_name").alias("client_name")))


def _halves(spark, d):
    """Even documents as new ones, odd ones as stored."""
    a = grouping.checkpointed(analysed(spark, d).withColumn("refs", F.array("project_code")).select("client_name", "doc_id", "project_key", "project_code", "project_name", "refs", "report_date"))
    return a.where("doc_id % 2 = 0"), a.where("doc_id % 2 = 1")


_MATCHES_SQL = """{docs}, p as (select i.doc_id, s.doc_id matched_id, 15 + case when i.project_name = s.project_name then 4 else 0 end score, s.project_name from docs i join docs s on i.client_name = s.client_name and i.doc_id % 2 = 0 and s.doc_id % 2 = 1),
 r as (select *, row_number() over w n, lead(score) over w runner_up from p window w as (partition by doc_id order by score desc, matched_id)), hit as (select * from r where n = 1 and score - coalesce(runner_up, -999) >= 2)"""


@query("project_matches", "with " + _MATCHES_SQL + " select doc_id, matched_id, score::bigint score from hit")
def project_matches(spark, d):
    """All documents of a client share key, code and reference (15 points), some the name (4)."""
    return resolve.match_projects(*_halves(spark, d))


@query("resolved_projects", "with " + _MATCHES_SQL + " select docs.doc_id, lower(project_code) project_key, coalesce(hit.project_name, docs.project_name) project_name from docs left join hit using (doc_id) where docs.doc_id % 2 = 0")
def resolved_projects(spark, d):
    return resolve.resolve_projects(*_halves(spark, d)).select("doc_id", "project_key", "project_name")


def _clustered(spark, d):
    a = analysed(spark, d).withColumn("refs", F.col("related_references")).withColumn("year", F.substring("report_date", 1, 4))
    return a.select("client_name", "doc_id", "ingested_at", "project_key", "project_code", "project_name", "refs", "year")


@query("project_clusters")
def project_clusters(spark, d):
    return grouping.cluster_projects(_clustered(spark, d))


@query("project_cluster_keys")
def project_cluster_keys(spark, d):
    docs = grouping.checkpointed(_clustered(spark, d))
    return resolve.cluster_keys(grouping.cluster_projects(docs), docs).drop("refs")


#: What groups and their roll-up read; the patterns of other fields aren't run.
_GROUPED = ("client_name", "doc_id", "ingested_at", "document_kind", "project_key", "project_name", "project_code", "report_type", "title", "document_stem", "report_date", "related_references", "contacts", "authors")


def _partly_keyed(spark, d):
    """Documents of which two in three have lost their key, some of these their code as well; each client's newest keeps both."""
    k, newest = F.col("doc_id"), F.row_number().over(Window.partitionBy("client_name").orderBy(F.desc("ingested_at"), "doc_id")) == 1
    a = analysed(spark, d).withColumn("document_stem", text.stem(F.col("source_path"))).withColumn("newest", newest)
    return a.withColumns({"project_key": F.when((k % 3 == 0) | F.col("newest"), F.col("project_key")), "project_code": F.when((k % 6 != 1) | F.col("newest"), F.col("project_code"))}).select(*_GROUPED)


@query("fuzzy_groups", "with {docs} select client_name, doc_id, lower(project_code) project_key from docs")
def fuzzy_groups(spark, d):
    """Each client's documents name one code as a reference and share their contact, so all of them belong to its key."""
    return grouping.fuzzy_groups(_partly_keyed(spark, d))


@query("fuzzy_rollup", "with {docs} select client_name, lower(project_code) project_key, count(*) filter (document_kind = 'report') reports, count(*) filter (document_kind <> 'report') other_documents, max(report_date) latest_date from docs group by 1, 2")
def fuzzy_rollup(spark, d):
    return grouping.grouped_rollup(grouping.checkpointed(_partly_keyed(spark, d))).select("client_name", "project_key", "reports", "other_documents", "latest_date")


# Strings --------------------------------------------------------------------------------------


@query("content_hashes", "select doc_id, sha256(text) content_hash from documents")
def content_hashes(spark, d):
    return t(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query("exact_duplicates", "select sha256(text) content_hash, count(*) n, min(doc_id) first_id from documents group by 1 having count(*) > 1")
def exact_duplicates(spark, d):
    h = t(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))
    return h.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("new_documents", "select doc_id from documents where doc_id % 2 = 1 and sha256(text) not in (select sha256(text) from documents where doc_id % 2 = 0 and text is not null)")
def new_documents(spark, d):
    h = t(spark, d, "documents").select("doc_id", F.lit("p").alias("source_path"), text.content_hash(F.col("text")).alias("content_hash"))
    return docs_ops.new_only(h.where("doc_id % 2 = 1"), h.where("doc_id % 2 = 0")).select("doc_id")


@query("slugs", "select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') slug, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) plain from part")
def slugs(spark, d):
    return t(spark, d, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"), text.plain_name(F.col("p_name")).alias("plain"))


@query("name_keys", "select c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') name_key from customer")
def name_keys(spark, d):
    return t(spark, d, "customer").select("c_custkey", text.name_key(F.col("c_name")).alias("name_key"))


@query("token_counts", "select doc_id, len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{2,}'), lambda x: not list_contains(['the','and','for','with','from','this','that','what','when','where','which','about','project','client','field'], x))) n_tokens from documents")
def token_counts(spark, d):
    """Documents of every language and of none; a null text has no tokens."""
    return t(spark, d, "documents").select("doc_id", F.size(text.retrieval_tokens(F.coalesce("text", F.lit("")))).cast("long").alias("n_tokens"))


@query("node_paths", "select distinct 'Projects' node_path from orders union all select distinct 'Projects/' || o_orderpriority from orders union all select distinct 'Projects/' || o_orderpriority || '/' || o_orderstatus from orders")
def node_paths(spark, d):
    p = t(spark, d, "orders").select(F.concat_ws("/", F.lit("Projects"), "o_orderpriority", "o_orderstatus").alias("p")).distinct()
    return p.select(F.explode(text.path_prefixes(F.col("p"))).alias("node_path")).distinct()


@query("normal_dates", "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') a, strftime(o_orderdate, '%Y-%m-%d') b, strftime(o_orderdate, '%Y-%m-%d') c from orders")
def normal_dates(spark, d):
    o = t(spark, d, "orders")
    shape = lambda p: dates.normal_date(F.date_format("o_orderdate", p))
    return o.select("o_orderkey", shape("M/d/yyyy").alias("a"), shape("MMMM d, yyyy").alias("b"), shape("yyyy-MM-dd").alias("c"))


# Retrieval ------------------------------------------------------------------------------------


#: Searches ask with every row whose id is divisible by 50, against all rows.
ASKED = 50


@query("cosine_topk", """with q as (select vec_id query_id, embedding q from embeddings where vec_id % 50 = 0), s as (select query_id, vec_id row_id, round(list_cosine_similarity(embedding::double[], q::double[]), 4) cos, row_number() over (partition by query_id order by list_cosine_similarity(embedding::double[], q::double[]) desc, vec_id) r from embeddings, q)
 select query_id, row_id, cos from s where r <= 10""")
def cosine_topk(spark, d):
    e = t(spark, d, "embeddings")
    q = e.where(F.col("vec_id") % ASKED == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return retrieval.candidates(q, e.select(F.col("vec_id").alias("row_id"), "embedding"), 10).select("query_id", "row_id", F.round("cos", 4).alias("cos"))


@query("bm25_pool", r"""with p as (select item_id, regexp_extract_all(lower(text), '[a-z0-9]{2,}') w from benchmark), st as (select ['the','and','for','with','from','this','that','what','when','where','which','about','project','client','field'] s),
 tk as (select item_id, list_filter(w, lambda x: not list_contains(s, x)) w from p, st), q as (select item_id query_id, unnest(w) term from tk where item_id % 50 = 0), qf as (select query_id, term, count(*) qtf from q group by 1, 2),
 n as (select count(*) n, avg(greatest(len(w), 1)) al from tk), tm as (select item_id, unnest(w) term from tk), tf as (select query_id, item_id, term, qtf, count(*) tf from tm join qf using (term) group by 1, 2, 3, 4), df as (select query_id, term, count(*) df from tf group by 1, 2),
 r as (select query_id, item_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.4 / (tf + 1.4 * (1 - 0.72 + 0.72 * greatest(len(w), 1) / al)) * (1 + 0.05 * greatest(0, qtf - 1))) raw from tf join df using (query_id, term) join tk using (item_id), n group by 1, 2)
 select query_id, item_id, round(raw / max(raw) over (partition by query_id), 6) lexical from r""")
def bm25_pool(spark, d):
    b = t(spark, d, "benchmark")
    asked = b.where(F.col("item_id") % ASKED == 0).select(F.col("text").alias("q"), F.col("item_id").alias("query_id"))
    return retrieval.bm25(b.crossJoin(F.broadcast(asked)), "query_id", "item_id", "text", "q").select("query_id", "item_id", F.round("lexical", 6).alias("lexical"))


@query("mmr_rerank")
def mmr_rerank(spark, d):
    e = t(spark, d, "embeddings")
    q = e.where(F.col("vec_id") % ASKED == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    near = retrieval.candidates(q, e.select(F.col("vec_id").alias("row_id"), "embedding"), 60)
    return retrieval.mmr(near.withColumn("score", (F.col("cos") + 1) / 2), 8)


@query("chunks")
def chunks(spark, d):
    return retrieval.chunks(t(spark, d, "documents").select("doc_id", "text"))


@query("hybrid_search")
def hybrid_search(spark, d):
    rows = retrieval.embedded(t(spark, d, "benchmark").select(F.col("item_id").alias("row_id"), F.col("text").alias("chunk_text")))
    q = rows.where(F.col("row_id") % ASKED == 0).select(F.col("row_id").alias("query_id"), F.col("chunk_text").alias("query_text"), F.col("embedding").alias("q"))
    return retrieval.search(q, rows)


def _document_chunks(spark, d):
    """Chunks of all documents; one without an id is named by its content."""
    docs = t(spark, d, "documents").select("doc_id", "text")
    named = docs.withColumn("row_name", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("#"), text.content_hash(F.col("text")))))
    return retrieval.chunks(named).withColumn("row_id", F.concat_ws(":", "row_name", "chunk_index")).drop("row_name")


@query("bm25_pool_all")
def bm25_pool_all(spark, d):
    """All chunks of ``documents`` are the pool of each query, the first chunks of every 50th document."""
    rows = _document_chunks(spark, d)
    asked = rows.where((F.col("doc_id") % ASKED == 0) & (F.col("chunk_index") == 0)).select(F.col("row_id").alias("query_id"), F.col("chunk_text").alias("q"))
    return retrieval.bm25_postings(rows.select("row_id", "chunk_text"), asked).select("query_id", "row_id", F.round("lexical", 6).alias("lexical"))


@query("bm25_documents", r"""with d as (select doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{2,}'), lambda x: not list_contains(['the','and','for','with','from','this','that','what','when','where','which','about','project','client','field'], x)) w from documents where doc_id is not null),
 n as (select count(*) n, avg(greatest(len(w), 1)) al from d), qf as (select query_id, term, count(*) qtf from (select doc_id query_id, unnest(w) term from d where doc_id % 50 = 0) group by 1, 2), tf as (select doc_id, term, count(*) tf from (select doc_id, unnest(w) term from d) group by 1, 2), df as (select term, count(*) df from tf group by 1),
 r as (select query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.4 / (tf + 1.4 * (1 - 0.72 + 0.72 * greatest(len(w), 1) / al)) * (1 + 0.05 * greatest(0, qtf - 1))) raw from tf join qf using (term) join df using (term) join d using (doc_id), n group by 1, 2),
 s as (select query_id, doc_id, round(raw / max(raw) over (partition by query_id), 6) lexical from r), o as (select *, row_number() over (partition by query_id order by lexical desc, doc_id) place from s) select query_id, doc_id, lexical from o where place <= 10""")
def bm25_documents(spark, d):
    """The ten best of all documents for each 50th document's text."""
    docs = t(spark, d, "documents").where("doc_id is not null").select("doc_id", "text")
    asked = docs.where(F.col("doc_id") % ASKED == 0).select(F.col("doc_id").alias("query_id"), F.col("text").alias("q"))
    found = retrieval.bm25_postings(docs, asked, row="doc_id", text="text", most=10).withColumn("lexical", F.round("lexical", 6))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lexical"), "doc_id"))
    return found.withColumn("place", place).where("place <= 10").select("query_id", "doc_id", "lexical")


@query("hybrid_search_all")
def hybrid_search_all(spark, d):
    rows = _document_chunks(spark, d)
    asked = rows.where((F.col("doc_id") % ASKED == 0) & (F.col("chunk_index") == 0)).select(F.col("row_id").alias("query_id"), F.col("chunk_text").alias("query_text"))
    # Vectors are drawn from the texts where they are compared.
    return retrieval.search(retrieval.embedded(asked, "query_text").withColumnRenamed("embedding", "q"), rows.select("row_id", "chunk_text"))


@query("top_document_per_source", "with a as (select source, doc_id, n_chars, row_number() over (partition by lang, source order by n_chars desc, doc_id) r, lang from documents), b as (select *, row_number() over (partition by lang order by n_chars desc, source) k from a where r = 1) select lang, source, doc_id, n_chars score from b where k <= 3")
def top_document_per_source(spark, d):
    h = t(spark, d, "documents").select("lang", "source", F.col("doc_id").alias("row_id"), F.col("n_chars").alias("score"))
    return retrieval.top_per_source(h, ["lang"], "source").select("lang", "source", F.col("row_id").alias("doc_id"), "score")


@query("greedy_budget", "with w as (select doc_id, sum(n_chars) over (partition by source order by doc_id) run, row_number() over (partition by source order by doc_id) n from documents) select doc_id from w where run <= 20000 or n = 1")
def greedy_budget(spark, d):
    return docs_ops.greedy_budget(t(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.col("doc_id")], F.col("n_chars"), 20000).select("doc_id")


@query("retrieval_metrics", """with h as (select lang query_id, source, row_number() over (partition by lang order by doc_id) r from documents), k as (select query_id, lower(source) s, min(r) r from h where r <= 8 group by 1, 2), w as (select distinct lang query_id, lower(source) s from documents where doc_id % 11 = 0),
 per as (select query_id, count(*) nw from w group by 1), ng as (select query_id, count(*) ng from h where r <= 8 group by 1), ok as (select query_id, count(*) nk, min(r) f from k join w using (query_id, s) group by 1)
 select count(*) queries, round(avg(case when nk > 0 then 1.0 else 0.0 end), 4) hit_rate, round(avg(coalesce(nk, 0) / greatest(coalesce(ng, 0), 1)), 4) "precision", round(avg(coalesce(nk, 0) / nw), 4) recall, round(avg(coalesce(1 / f, 0)), 4) mrr, count(*) filter (coalesce(nk, 0) = 0) misses from per left join ng using (query_id) left join ok using (query_id)""")
def retrieval_metrics(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "lang", "source")
    hits = docs.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))).select(F.col("lang").alias("query_id"), "source", "rank")
    return retrieval.retrieval_metrics(hits, docs.where("doc_id % 11 = 0").select(F.col("lang").alias("query_id"), "source"))


@query("retrieval_misses", """with h as (select o_custkey query_id, lower(o_orderpriority) s, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) r from orders),
 w as (select o_custkey query_id, list_sort(list_distinct(list(lower(o_orderpriority)))) e from orders where o_orderkey % 7 = 0 group by 1), g as (select query_id, list(s order by r) found from h where r <= 2 group by 1)
 select query_id, array_to_string(e, ',') expected, array_to_string(found, ',') top_results from w join g using (query_id) where not list_has_any(e, found)""")
def retrieval_misses(spark, d):
    """A customer's newest two orders as hits, whose priorities should be among those of every seventh order."""
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.concat(F.lit("p\\"), "o_orderpriority").alias("source"), "o_orderdate", "o_orderkey")
    hits = o.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))))
    out = retrieval.retrieval_misses(hits, o.where("o_orderkey % 7 = 0"), k=2)
    return out.select("query_id", F.array_join("expected_sources", ",").alias("expected"), F.array_join("top_results", ",").alias("top_results"))


# Event log ------------------------------------------------------------------------------------


def event_rows(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "events").select(F.col("event_id").alias("line"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("event"))


@query("event_counts", "select event_type event, count(*) n from events group by 1")
def event_counts(spark, d):
    return event_ops.event_counts(event_rows(spark, d))


def timed(spark: SparkSession, d: str) -> DataFrame:
    return event_ops.durations(event_rows(spark, d), starts="view", ends=("purchase", "error"))


_TIMED = "p as (select event_id line, event_type event, ts, last_value(case when event_type = 'view' then ts end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) s from events), d as (select line, event, greatest(0.0, (epoch_us(ts) - epoch_us(s)) / 1e6) as secs from p where event in ('purchase', 'error') and s is not null)"


@query("paired_durations", f"with {_TIMED} select line, event, secs as \"seconds\" from d")
def paired_durations(spark, d):
    return timed(spark, d).select("line", "event", "seconds")


@query("duration_stats", f"with {_TIMED}, g as (select event, count(*) n, max(secs) max_s, list_sort(list(secs)) v from d group by 1) select event, n, max_s, v[round_even((n - 1) * 0.5, 0)::int + 1] p50_s, v[round_even((n - 1) * 0.95, 0)::int + 1] p95_s from g")
def duration_stats(spark, d):
    return event_ops.duration_stats(timed(spark, d), ["event"]).select("event", "n", "max_s", "p50_s", "p95_s")


@query("slowest", f"with {_TIMED} select line, secs as \"seconds\" from d order by secs desc, line limit 10")
def slowest(spark, d):
    return event_ops.slowest(timed(spark, d)).select("line", "seconds")


# Row-level changes ----------------------------------------------------------------------------


@query("upserted_orders", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) n from orders) where n = 1")
def upserted_orders(spark, d):
    o = t(spark, d, "orders").withColumn("at", F.struct("o_orderdate", "o_orderkey"))
    return store.keep_latest(o, ["o_custkey"], "at").select("o_custkey", "o_orderkey")


@query("merged_client", "with {docs} select case when client_name in (select c_name from customer where c_custkey <= 20) then 'MERGED' else client_name end client_name, count(*) n from docs group by 1")
def merged_client(spark, d):
    mapping = t(spark, d, "customer").where("c_custkey <= 20").select(F.col("c_name").alias("source"), F.lit("MERGED").alias("target"))
    return store.rename_client(analysed(spark, d).select("client_name", "doc_id"), mapping).groupBy("client_name").agg(F.count(F.lit(1)).alias("n"))


@query("reassigned_projects", "with {docs} select case when project_code = 'PRJ-3' and document_kind = 'quote' then 'moved' else lower(project_code) end project_key, count(*) n from docs group by 1")
def reassigned_projects(spark, d):
    a = grouping.checkpointed(analysed(spark, d).select("doc_id", "source_path", "client_name", "document_kind", "project_key", "project_name", "project_code"))
    change = a.where("project_code = 'PRJ-3' and document_kind = 'quote'").select("source_path", "client_name", F.lit("moved").alias("project_key"), F.lit("m").alias("project_name"), F.lit("M").alias("project_code")).distinct()
    out, _ = store.reassign_projects(a, change)
    return out.groupBy("project_key").agg(F.count(F.lit(1)).alias("n"))


_MOVED = "document_kind = 'quote' and project_code in ('PRJ-3', 'PRJ-4')"


def _moves(a: DataFrame) -> DataFrame:
    """Quotes of one project move to another, those of a second one lose theirs."""
    to = F.col("project_code") == "PRJ-3"
    named = lambda v: F.when(to, v).otherwise(" ")
    return a.where(_MOVED).select("client_name", "source_path", named("moved").alias("project_key"), named("Moved").alias("project_name"), named("M-1").alias("project_code"), F.array(F.lit(" R-9 "), F.lit("")).alias("related_references"), F.col("project_key").alias("old_project_key")).distinct()


def _project_tables(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], DataFrame]:
    a = analysed(spark, d).select("doc_id", "source_path", "client_name", "document_kind", "project_key", "project_name", "project_code")
    # Five tables and the changes are made of it, so what the patterns found is written once.
    a = grouping.checkpointed(a.withColumn("related_references", F.array("project_code")))
    rows = a.drop("document_kind")
    owned = a.select("client_name", "project_key", "document_kind").distinct()
    tables = {
        "documents": rows, "vectors": rows.withColumnRenamed("source_path", "source_document"), "versions": rows.withColumn("snapshot", F.struct(*cascade.PROJECT)),
        "project_summaries": owned.where("document_kind = 'invoice'"), "project_key_fields": owned,
    }
    return tables, _moves(a)


_MOVED_SQL = f"""{{docs}}, m as (select *, {_MOVED} hit, project_code = 'PRJ-3' "to" from docs),
 after as (select doc_id, document_kind, client_name, hit, case when not hit then lower(project_code) when "to" then 'moved' end project_key, case when not hit then project_code when "to" then 'M-1' end project_code, case when hit then 'R-9' else project_code end refs, project_code before from m),
 touched as (select distinct client_name, unnest([project_key, lower(before)]) project_key from after where hit), owned as (select distinct client_name, lower(project_code) project_key, document_kind from docs)"""


@query("reassigned_tables", f"""with {_MOVED_SQL} select 'documents' table_name, doc_id::varchar id, project_key, project_code, refs from after union all select 'vectors', doc_id::varchar, project_key, project_code, refs from after
 union all select 'versions', doc_id::varchar, project_key, coalesce(project_code, '') || '/' || coalesce(project_code, ''), before from after
 union all select t, client_name || document_kind, project_key, null, null from (select 'project_key_fields' t, * from owned union all select 'project_summaries', * from owned where document_kind = 'invoice') o where not exists (select 1 from touched x where x.client_name = o.client_name and x.project_key = o.project_key)""")
def reassigned_tables(spark, d):
    out, _ = cascade.reassign(*_project_tables(spark, d))
    refs, none = F.array_join("related_references", ",").alias("refs"), F.lit(None).cast("string")
    both = F.concat_ws("/", F.coalesce("project_code", F.lit("")), F.coalesce("snapshot.project_code", F.lit(""))).alias("project_code")
    parts = [out[n].select(F.lit(n).alias("table_name"), F.col("doc_id").cast("string").alias("id"), "project_key", both if n == "versions" else "project_code", refs) for n in ("documents", "vectors", "versions")]
    parts += [out[n].select(F.lit(n).alias("table_name"), F.concat("client_name", "document_kind").alias("id"), "project_key", none.alias("project_code"), none.alias("refs")) for n in ("project_summaries", "project_key_fields")]
    return reduce(DataFrame.unionByName, parts)


@query("reassigned_counts", f"""with {_MOVED_SQL} select 'updated_documents' as name, count(*) n from after where hit union all select 'updated_vectors', count(*) from after where hit union all select 'updated_versions', count(*) from after where hit
 union all select 'cleared_project_summaries', count(*) from owned join touched using (client_name, project_key) where document_kind = 'invoice' union all select 'cleared_project_key_fields', count(*) from owned join touched using (client_name, project_key)""")
def reassigned_counts(spark, d):
    return cascade.reassign(*_project_tables(spark, d))[1]


_REDATED_SQL = """{docs}, l as (select source_path, arg_max(doc_id, struct_pack(ingested_at, doc_id)) newest, document_kind = 'report' and regexp_extract(source_path, '_([0-9]+)[.]', 1)::int % 5 = 0 hit from docs group by source_path, document_kind),
 j as (select docs.*, l.hit, l.newest from docs join l using (source_path)), pr as (select client_name, lower(project_code) project_key, list(distinct source_path order by source_path) paths, max(case when doc_id % 2 = 0 then report_date end) own from docs group by 1, 2),
 pp as (select client_name, project_key, own, list_transform(paths, lambda p: p || '=' || case when p like '%report%' and regexp_extract(p, '_([0-9]+)[.]', 1)::int % 5 = 0 then '2030-02-03' else '' end) entries from pr)"""


@query("report_date_cascade", f"""with {_REDATED_SQL} select 'documents' table_name, doc_id::varchar id, case when hit and doc_id = newest then '2030-02-03' else report_date end report_date from j
 union all select 'timeline', doc_id::varchar, case when doc_id % 3 <> 0 then report_date when hit then '2030-02-03' end from j
 union all select 'profiles', client_name || '/' || project_key, concat_ws(';', coalesce(own, case when len(list_filter(entries, lambda e: e like '%2030%')) > 0 then '2030-02-03' end), array_to_string(entries, ';')) from pp
 union all select 'found', source_path, 'true' from l where hit union all select 'found', 'nowhere.txt', 'false'""")
def report_date_cascade(spark, d):
    """Dates set for the reports of every fifth customer, and for a path that no document has."""
    a = grouping.checkpointed(analysed(spark, d).select("doc_id", "source_path", "ingested_at", "content_hash", "document_kind", "client_name", "project_key", "report_date"))
    events = a.select("doc_id", F.col("source_path").alias("source_document"), F.when(F.col("doc_id") % 3 != 0, F.col("report_date")).alias("event_date"))
    entries = F.transform(F.array_sort(F.collect_set("source_path")), lambda p: F.struct(p.alias("path"), F.lit(None).cast("string").alias("date")))
    profiles = a.groupBy("client_name", F.col("project_key").alias("node_path")).agg(entries.alias("source_reports"), F.max(F.when(F.col("doc_id") % 2 == 0, F.col("report_date"))).alias("report_date"))
    fifth = F.regexp_extract("source_path", r"_(\d+)[.]", 1).cast("int") % 5 == 0
    changes = a.where((F.col("document_kind") == "report") & fifth).select(F.regexp_replace("source_path", "/", "\\\\").alias("source_path")).distinct().unionByName(spark.range(1).select(F.lit("nowhere.txt").alias("source_path")))
    out = cascade.set_report_dates(a, events, profiles, changes.withColumn("report_date", F.lit("2030-02-03")))
    told = F.concat_ws(";", "report_date", F.array_join(F.transform("source_reports", lambda r: F.concat(r["path"], F.lit("="), F.coalesce(r["date"], F.lit("")))), ";"))
    rows = lambda n, i, v: out[n].select(F.lit(n).alias("table_name"), i.cast("string").alias("id"), v.cast("string").alias("report_date"))
    parts = [rows("documents", F.col("doc_id"), F.col("report_date")), rows("timeline", F.col("doc_id"), F.col("event_date")), rows("profiles", F.concat_ws("/", "client_name", "node_path"), told), rows("found", F.col("source_path"), F.col("found"))]
    return reduce(DataFrame.unionByName, parts)


@query("suspicious_cleanup", """with {docs}, m as (select *, regexp_extract(source_path, '_([0-9]+)[.]', 1)::int % 10 = 0 hit from docs)
 select 'documents' table_name, doc_id::varchar id, case when not hit then client_name end client_name, case when not hit then project_code end detail from m union all select 'vectors', doc_id::varchar, case when not hit then client_name end, null from m
 union all select distinct 'profiles', project_code, client_name, null from m where not hit union all select 'history', doc_id::varchar, client_name, null from m where not hit and doc_id % 2 = 0 union all select 'timeline', doc_id::varchar, client_name, null from m where not hit and doc_id % 3 = 0
 union all select 'findings', 'docs/' || lower(client_name) || '.txt', client_name, concat_ws('/', count(distinct project_code), count(*) filter (doc_id % 2 = 0), count(*) filter (doc_id % 3 = 0), count(*), 0) from m where hit group by client_name""")
def suspicious_cleanup(spark, d):
    """Every tenth customer's documents lie at one path that is named like the customer."""
    a = analysed(spark, d).select("doc_id", "source_path", "client_name", "project_key", "project_name", "project_code", "related_references")
    tenth = F.regexp_extract("source_path", r"_(\d+)[.]", 1).cast("int") % 10 == 0
    a = a.withColumn("source_path", F.when(tenth, F.concat(F.lit("docs/"), F.lower("client_name"), F.lit(".txt"))).otherwise(F.col("source_path")))
    a = grouping.checkpointed(a.withColumn("project_code", F.upper("project_code")))
    by = a.select("doc_id", "client_name", F.col("source_path").alias("source_document"))
    nodes = a.select("client_name", F.col("project_code").alias("node_path")).distinct()
    out, told = cascade.cleanup_suspicious({"documents": a, "vectors": by, "profiles": nodes, "history": by.where("doc_id % 2 = 0"), "timeline": by.where("doc_id % 3 = 0")})
    rows = lambda n, key, detail: out[n].select(F.lit(n).alias("table_name"), F.col(key).cast("string").alias("id"), "client_name", detail.alias("detail"))
    none = F.lit(None).cast("string")
    parts = [rows("documents", "doc_id", F.col("project_code")), *(rows(n, "doc_id", none) for n in ("vectors", "history", "timeline")), rows("profiles", "node_path", none)]
    counts = F.concat_ws("/", *(F.col(c).cast("string") for c in ("profiles", "history", "timeline", "vectors_cleared", "documents_deleted")))
    return reduce(DataFrame.unionByName, [*parts, told.select(F.lit("findings").alias("table_name"), F.col("source_path").alias("id"), "client_name", counts.alias("detail"))])


@query("node_states", """with {docs}, f as (select *, 'n' || doc_id % 2 facts from docs), s as (select *, lead(facts) over w nf, lead(source_path) over w superseded_by, count(distinct source_path) over (partition by client_name, project_code order by ingested_at, doc_id rows unbounded preceding) n_reports from f window w as (partition by client_name, project_code order by ingested_at, doc_id)),
 k as (select * from s where superseded_by is null or nf <> facts) select doc_id, superseded_by, n_reports::int n_reports, (row_number() over (partition by client_name, project_code order by ingested_at, doc_id))::int as "version" from k""")
def node_states(spark, d):
    """States of each project's node, where only a name tells the documents apart."""
    a = analysed(spark, d).select("client_name", F.col("project_key").alias("node_path"), "ingested_at", "doc_id", "source_path", "report_date")
    rows = a.withColumnRenamed("report_date", "day").withColumn("report_date", F.lit(None).cast("string")).withColumn("project_name", F.concat(F.lit("n"), (F.col("doc_id") % 2).cast("string")))
    return cascade.node_states(rows).select("doc_id", "superseded_by", F.size("source_reports").alias("n_reports"), "version")


@query("node_pages", """with {docs}, f as (select *, 'n' || doc_id % 2 facts from docs), s as (select *, lead(facts) over w nf, lead(source_path) over w superseded_by, list(source_path) over (w rows unbounded preceding) seen from f window w as (partition by client_name, project_code order by ingested_at, doc_id)),
 k as (select * from s where superseded_by is null or nf <> facts) select doc_id, case when superseded_by is null then 'Superseded' else 'Superseded by ' || replace(superseded_by, 'docs/', '') end as "label", '/document?path=' || replace(superseded_by, '/', '%2F') superseded_href,
 array_to_string(list_sort(list_distinct(list_transform(seen, lambda p: replace(p, 'docs/', '') || '=/document?path=' || replace(p, '/', '%2F')))), ';') reports from k""")
def node_pages(spark, d):
    """States of each project's node as its page shows them: what replaced them, and links to the reports behind them."""
    a = analysed(spark, d).select("client_name", F.col("project_key").alias("node_path"), "ingested_at", "doc_id", "source_path", F.lit(None).cast("string").alias("report_date"))
    rows = grouping.checkpointed(a).withColumn("project_name", F.concat(F.lit("n"), (F.col("doc_id") % 2).cast("string")))
    out = pages.node_links(pages.history_labels(cascade.node_states(rows)))
    told = F.transform("source_reports", lambda r: F.concat(r["name"], F.lit("="), r["href"]))
    return out.select("doc_id", "label", "superseded_href", F.array_join(F.array_sort(told), ";").alias("reports"))


@query("report_page", """with {docs} select doc_id, replace(source_path, 'docs/', '') document_name, '/document?path=' || replace(source_path, '/', '%2F') document_href, '/report/versions?path=' || replace(source_path, '/', '%2F') versions_href, doc_id % 11 = 0 missing_date
 from docs where document_kind = 'report' and (doc_id % 11 = 0 or report_date >= '1995-01-01') order by ingested_at desc, doc_id desc limit 2000""")
def report_page(spark, d):
    """The newest reports with their links; each eleventh has no date and passes the bound."""
    a = analysed(spark, d).withColumn("report_date", F.when(F.col("doc_id") % 11 != 0, F.col("report_date")))
    return pages.report_links(docs_ops.reports(a, date_from="1995-01-01")).select("doc_id", "document_name", "document_href", "versions_href", "missing_date")


@query("deleted_nodes", """with {docs}, g as (select client_name, project_code, count(*) n, regexp_extract(min(source_path), '_([0-9]+)[.]', 1)::int % 4 = 0 hit from docs group by 1, 2)
 select client_name, project_code node_path, case when hit then 'deleted' else 'kept' end state, case when hit then 1 else n end n from g""")
def deleted_nodes(spark, d):
    """The nodes of every fourth customer go with their history; the others keep theirs, a row for each document."""
    a = grouping.checkpointed(analysed(spark, d).select("client_name", F.col("project_code").alias("node_path"), "source_path"))
    nodes = a.select("client_name", "node_path").distinct()
    gone = a.where(F.regexp_extract("source_path", r"_(\d+)[.]", 1).cast("int") % 4 == 0)
    left, history, counts = store.delete_nodes(nodes, a, gone)
    kept = left.join(history, ["client_name", "node_path"]).groupBy("client_name", "node_path").agg(F.lit("kept").alias("state"), F.count(F.lit(1)).alias("n"))
    return kept.unionByName(counts.withColumn("state", F.lit("deleted")))


@query("first_events", "select event_type, user_id, min(event_id) event_id, false stored from events where event_type <> 'error' group by 1, 2 union all select event_type, user_id, event_id, true from events where event_type = 'error'")
def first_events(spark, d):
    """Of each user's events of a kind the first is put in, but of the kind that is stored already none."""
    e = t(spark, d, "events").select("event_type", "user_id", "event_id")
    stored = e.where("event_type = 'error'").withColumn("stored", F.lit(True))
    known = e.join(stored.select("event_type").distinct(), "event_type", "left_semi").select("event_type", "user_id", "event_id")
    incoming = e.where("event_type <> 'error'").unionByName(known).withColumn("stored", F.lit(False))
    return store.insert_absent(stored, incoming, ["event_type", "user_id"], ["event_id"])


# Evaluation -----------------------------------------------------------------------------------


@query("financial_evaluation", """with {docs}, latest as (select * from (select *, row_number() over (partition by source_path order by ingested_at desc, doc_id desc) n from docs) where n = 1),
 a as (select client_name, coalesce(sum(case when is_revenue then amount::decimal(18,2) end), 0)::double r, coalesce(sum(case when not is_revenue then amount::decimal(18,2) end), 0)::double c from latest group by 1),
 w as (select c_name client_name, case when c_custkey % 2 = 0 then coalesce(r, 0) + 0.5 else 150000.0 end er, case when c_custkey % 2 = 0 then coalesce(c, 0) - 1.0 else 100000.0 end ec, coalesce(r, 0) r, coalesce(c, 0) c from customer left join a on a.client_name = c_name where c_custkey % 3 = 0),
 d as (select client_name, round(r - er, 2) delta_revenue, round(c - ec, 2) delta_cost, round((r::decimal(18,2) - c::decimal(18,2))::double - (er - ec), 2) delta_profit from w)
 select *, abs(delta_revenue) <= 1.0 and abs(delta_cost) <= 1.0 and abs(delta_profit) <= 1.0 ok from d""")
def financial_evaluation(spark, d):
    """Every third client against totals that are its own but for a little, or fixed ones."""
    m = docs_ops.client_metrics(analysed(spark, d))
    c = t(spark, d, "customer").where("c_custkey % 3 = 0")
    own = c.join(m, F.lower("c_name") == F.col("client_key"), "left")
    even = F.col("c_custkey") % 2 == 0
    total = lambda n: F.coalesce(n, F.lit(0.0))
    expected = own.select(F.col("c_name").alias("client_name"), F.when(even, total("revenue_total") + 0.5).otherwise(150000.0).alias("revenue"), F.when(even, total("cost_total") - 1.0).otherwise(100000.0).alias("cost"), F.lit(None).cast("double").alias("profit"))
    return evaluation.financial_evaluation(m, expected).select("client_name", "delta_revenue", "delta_cost", "delta_profit", "ok")


_CASES_SQL = """c as (select o_orderpriority model, o_orderkey % 7 <> 0 ok, case when o_orderkey % 5 = 0 then 'absent' else 'filled' end status, case when o_orderkey % 3 = 0 then 'absent' else 'filled' end expected_status,
 case when o_orderkey % 2 = 0 then 'ai' else 'rule' end method, o_totalprice::int % 90 latency, list_distinct(['pay', 'order', (o_orderkey % 10)::varchar]) a, list_distinct(['pay', (o_orderkey % 4)::varchar]) e from orders),
 f as (select *, case when len(list_intersect(a, e)) = 0 then 0.0::double else 2.0::double * len(list_intersect(a, e)) / (len(a) + len(e)) end f1 from c),
 s as (select *, case when not ok then 0.0::double else least(1.0::double, case when status = expected_status then 0.6::double + case when expected_status = 'absent' then 0.3::double else 0.3::double * f1 end else 0.0::double end + case when method = 'ai' then 0.1::double else 0.0::double end) end score from f)"""


def cases(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    text_of = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    return t(spark, d, "orders").select(
        F.col("o_orderpriority").alias("model"), (k % 7 != 0).alias("ok"), F.when(k % 5 == 0, "absent").otherwise("filled").alias("status"), F.when(k % 3 == 0, "absent").otherwise("filled").alias("expected_status"),
        F.when(k % 2 == 0, " AI").otherwise("rule").alias("method"), F.pmod(F.round("o_totalprice").cast("int"), F.lit(90)).cast("double").alias("latency_seconds"),
        text_of("Pay-order/", k % 10).alias("value"), text_of("pay  ", k % 4).alias("expected_value"),
    )


@query("benchmark_summary", "with " + _CASES_SQL + """, g as (select model, count(*) case_count, round(avg(ok::int), 4) ok_rate, round(avg((ok and method = 'ai')::int), 4) ai_method_rate, round(avg((ok and status = expected_status)::int), 4) status_accuracy,
 round(avg(score), 4) avg_score, round(avg(latency), 3) avg_latency_seconds, round(coalesce(avg(f1) filter (ok and expected_status = 'filled' and status = 'filled'), 0), 4) filled_value_similarity from s group by 1)
 select model, case_count, ok_rate, ai_method_rate, status_accuracy, avg_score, filled_value_similarity from g""")
def benchmark_summary(spark, d):
    return evaluation.benchmark_summary(cases(spark, d)).select("model", "case_count", "ok_rate", "ai_method_rate", "status_accuracy", "avg_score", "filled_value_similarity")


@query("benchmark_cases", """with {docs}, p as (select client_name, project_code, max(project_name) project_name, max(ingested_at) updated_at, count(*) n from docs group by 1, 2),
 x as (select *, unnest([{'k': 'scope', 's': case when n % 2 = 0 then 'filled' else 'failed' end, 'v': n::varchar, 'm': 'ai'}, {'k': 'timeline', 's': 'absent', 'v': '', 'm': case when n % 3 = 0 then 'ai' else 'rule' end}, {'k': 'gaps', 's': 'filled', 'v': 'none', 'm': 'rule'}], recursive := true), generate_subscripts([1, 2, 3], 1) place_in from p),
 o as (select *, dense_rank() over (order by updated_at desc, client_name, project_code) project from x where m = 'ai' and s in ('filled', 'absent'))
 select (row_number() over (order by project, place_in))::int place, client_name, project_code project_key, k field_key, s expected_status, v expected_value from o where project <= 8 order by project, place_in limit 9""")
def benchmark_cases(spark, d):
    """Stored answers of each project, by a model or by rules, of which the newest make the benchmark."""
    g = analysed(spark, d).groupBy("client_name", F.col("project_code").alias("project_key")).agg(F.max("project_name").alias("project_name"), F.max("ingested_at").alias("updated_at"), F.count(F.lit(1)).alias("n"))
    field = lambda value, status, method: F.struct(*[(F.lit(x) if isinstance(x, str) else x).alias(c) for c, x in (("value", value), ("status", status), ("method", method))])
    own = F.create_map(F.lit("scope"), field(F.concat(F.lit(" "), F.col("n").cast("string")), F.when(F.col("n") % 2 == 0, "filled").otherwise("failed"), "AI "), F.lit("timeline"), field("", "absent", F.when(F.col("n") % 3 == 0, "ai").otherwise("rule")), F.lit("gaps"), field("none", "filled", "rule"))
    return evaluation.benchmark_cases(g.withColumn("fields", own)).drop("project_name")


@query("summary_quality", "select o_orderkey, case when o_orderkey % 9 = 0 then 0.0 else round(0.45 * least((o_orderkey % 900) / 650.0, 1.0) + 0.35 * (o_orderkey % 4) / greatest(1, o_orderkey % 5) + 0.2 * greatest(0.0, 1 - (o_orderkey % 3) / greatest(1, o_orderkey % 6)::double), 4) end::double score from orders")
def summary_quality(spark, d):
    k = F.col("o_orderkey")
    score = evaluation.summary_quality(k % 9 != 0, F.repeat(F.lit("x"), (k % 900).cast("int")), k % 4, k % 5, k % 3, k % 6)
    return t(spark, d, "orders").select("o_orderkey", score.alias("score"))


@query("row_counts", "select 'orders' as name, count(*) n from orders union all select 'documents', count(*) from documents union all select 'events', count(*) from events union all select 'embeddings', count(*) from embeddings")
def row_counts(spark, d):
    return evaluation.row_counts({n: t(spark, d, n) for n in ("orders", "documents", "events", "embeddings")})


@query("manifest_check", "with {docs} select doc_id, document_kind, document_kind <> 'quote' mismatch from docs where source_path like 'docs/quote_%' or source_path like 'docs/report_%'")
def manifest_check(spark, d):
    a = analysed(spark, d).select("doc_id", "source_path", "document_kind")
    m = a.select(F.col("source_path").alias("path")).distinct().where("path like 'docs/quote_%' or path like 'docs/report_%'").withColumn("expected_kind", F.lit("quote"))
    return evaluation.manifest_check(a, m).select("doc_id", "document_kind", "mismatch")


# Projects and fields --------------------------------------------------------------------------


@query("non_reports", "with {docs} select doc_id, document_kind from docs where document_kind <> 'report'")
def non_reports(spark, d):
    return scans.non_reports(analysed(spark, d)).select("doc_id", "document_kind")


@query("project_documents", "with {docs} select doc_id, project_key, report_date from (select *, lower(project_code) project_key from docs) where client_name = (select min(c_name) from customer join orders on c_custkey = o_custkey)")
def project_documents(spark, d):
    first = t(spark, d, "customer").join(t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).agg(F.min("c_name")).first()[0]
    return scans.project_documents(analysed(spark, d), first).select("doc_id", "project_key", "report_date")


@query("visual_timeline", "select event_id, case when event_id % 5 = 0 then 0 else epoch_ms(date_trunc('day', ts)) end \"timestamp\", case when event_id % 5 = 0 then 'Undated' else strftime(ts, '%Y-%m-%d') end date_label, event_type summary, 'Document' document_name from events")
def visual_timeline(spark, d):
    e = t(spark, d, "events")
    shown = F.when(F.col("event_id") % 5 != 0, F.date_format("ts", "yyyy-MM-dd"))
    none = F.lit(None).cast("string")
    rows = e.select("event_id", shown.alias("display_date"), none.alias("created_at"), F.col("event_type").alias("summary"), none.alias("client_name"), none.alias("document_kind"), none.alias("project_name"), none.alias("source_document"))
    return scans.visual_timeline(rows).select("event_id", "timestamp", "date_label", "summary", "document_name")


@query("decorated_documents", "with {docs} select doc_id, replace(source_path, 'docs/', '') document_name, regexp_replace(source_path, 'docs/|[.]txt', '', 'g') document_stem, '/document?path=' || replace(source_path, '/', '%2F') document_href, document_kind = 'report' is_report, contact contacts from docs")
def decorated_documents(spark, d):
    out = scans.decorated(with_fields(rendered(spark, d)), F.substring("text", 1, 400), money.currency_amounts(F.col("text")))
    return out.select("doc_id", "document_name", "document_stem", "document_href", "is_report", F.array_join("contacts", ",").alias("contacts"))


@query("project_hints", """with {docs} select client_name, lower(project_code) project_key, min(project_code) project_code, count(distinct source_path) n_sources, string_agg(distinct year(report_date::date)::varchar, ',' order by year(report_date::date)::varchar) as "years" from docs group by 1, 2""")
def project_hints(spark, d):
    return fields.project_hints(analysed(spark, d)).select("client_name", "project_key", "project_code", F.size("sources").cast("long").alias("n_sources"), F.array_join("years", ",").alias("years"))


@query("project_fields", """with {docs}, p as (select client_name, lower(project_code) project_key, count(*) n from docs group by 1, 2), f as (select unnest([{'key': 'scope', 'label': 'Project Scope'}, {'key': 'timeline', 'label': 'Timeline'}, {'key': 'gaps', 'label': 'Known Gaps'}], recursive := true))
 select client_name, project_key, key, "label", case when key = 'scope' and n % 2 = 0 then n::varchar else '' end "value", case when key = 'timeline' then 'absent' when key = 'scope' then 'filled' else '' end status,
 case key when 'scope' then 'ai' when 'timeline' then 'fallback' else '' end "method", case when key = 'timeline' then case when n % 2 = 0 then 'no answer' else 'AI generation unavailable.' end else '' end error_message, (key = 'scope' and n % 2 <> 0) or key = 'gaps' needs_generation from p, f""")
def project_fields(spark, d):
    """Stored fields of each project as its page shows them: a model's answer without a method, a fallback told by its evidence, one that isn't there."""
    g = analysed(spark, d).groupBy("client_name", "project_key").agg(F.count(F.lit(1)).alias("n"))
    even = F.col("n") % 2 == 0
    field = lambda value, status, evidence: F.struct(*[x.alias(c) for c, x in (("value", value), ("status", F.lit(status)), ("evidence", evidence), ("method", F.lit(None).cast("string")), ("error_message", F.lit("")))])
    own = F.create_map(F.lit("scope"), field(F.when(even, F.col("n").cast("string")), "filled", F.lit("e")), F.lit("timeline"), field(F.lit("  "), "absent", F.concat(F.lit("Fallback due to LLM unavailability:"), F.when(even, " no answer").otherwise("  "))))
    return pages.key_field_rows(g.withColumn("fields", own), [("scope", "Project Scope"), ("timeline", "Timeline"), ("gaps", "Known Gaps")]).drop("position")


@query("summary_failures", """with {docs}, o as (select *, row_number() over (partition by client_name, project_code order by ingested_at, doc_id) n, row_number() over (partition by client_name, project_code order by ingested_at desc, doc_id desc) r,
 case document_kind when 'invoice' then 'Sales Invoice' when 'quote' then 'Quotation' when 'purchase_order' then 'Purchase Order' else 'Inspection Report' end title from docs)
 select client_name, lower(project_code) project_key, case when count(*) % 3 = 0 then 'http_error_503' when count(*) % 3 = 1 then 'request_timed_out' else 'unknown_error' end error_code,
 case when count(*) % 3 = 0 then 'Local model service returned HTTP error (503).' when count(*) % 3 = 1 then 'Request to local model timed out.' else 'Unknown error.' end error_message, count(*) document_count,
 string_agg(title, '|' order by n) filter (n <= 12) titles, string_agg(doc_id || ':' || left(repeat(document_kind || ' ', 40), 180), '|' order by r) filter (r <= 12) previews from o group by 1, 2""")
def summary_failures(spark, d):
    """A failed summary of every project: its documents in order, the newest ones as hits."""
    a = grouping.checkpointed(analysed(spark, d).select("doc_id", "client_name", "project_key", "project_name", "ingested_at", "document_kind", "title", "source_path"))
    w = Window.partitionBy("client_name", "project_key")
    docs = a.withColumn("position", F.row_number().over(w.orderBy("ingested_at", "doc_id"))).withColumn("document_name", text.basename(F.col("source_path")))
    hits = a.withColumn("rank", F.row_number().over(w.orderBy(F.desc("ingested_at"), F.desc("doc_id")))).select("client_name", "project_key", "rank", F.col("doc_id").alias("score"), F.col("client_name").alias("hit_client"), F.col("source_path").alias("source_document"), F.repeat(F.concat("document_kind", F.lit(" ")), F.lit(40)).alias("chunk_text"))
    n = F.count(F.lit(1)) % 3
    none = F.lit(None).cast("string")
    failed = a.groupBy("client_name", "project_key").agg(F.max("project_name").alias("project_name"), F.when(n == 0, "http_error_503").when(n == 1, "request_timed_out").alias("error_code")).withColumns({"strategy": F.lit("map_reduce"), "error_message": none, "query_text": none})
    out = pages.failure_records(failed, docs, hits)
    previews = F.transform("rag_hits", lambda h: F.concat(h["score"].cast("string"), F.lit(":"), h["chunk_preview"]))
    return out.select("client_name", "project_key", "error_code", "error_message", "document_count", F.array_join("document_titles", "|").alias("titles"), F.array_join(previews, "|").alias("previews"))


@query("summary_contexts", """with h as (select doc_id, doc_id % 40 query_id, coalesce(lang, '') || '/' || coalesce(source, '') || doc_id % 90 source_document, case when doc_id % 3 > 0 then lang end client, left(coalesce(text, ''), 420) shown, row_number() over (partition by doc_id % 40 order by n_chars desc, doc_id) r from documents where doc_id is not null),
 b as (select query_id, source_document, arg_min(struct_pack(client, shown), r) x, min(r) r from h group by 1, 2), c as (select *, row_number() over (partition by query_id order by r) n, '[' || coalesce(nullif(x.client, ''), 'unknown client') || ' | ' || regexp_extract(source_document, '([^/]*)$', 1) || ']' || chr(10) || x.shown told from b),
 u as (select *, sum(length(told)) over (partition by query_id order by n) used from c where n <= 12) select query_id, string_agg(told, chr(10) || chr(10) order by n) context from u where used <= 2200 or n = 1 group by 1""")
def summary_contexts(spark, d):
    """Forty queries over all documents, the longest first: what a summary's prompt shows of their sources."""
    w = Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "doc_id")
    h = t(spark, d, "documents").where("doc_id is not null").withColumn("query_id", F.col("doc_id") % 40).withColumn("rank", F.row_number().over(w))
    source = F.concat(F.coalesce("lang", F.lit("")), F.lit("/"), F.coalesce("source", F.lit("")), (F.col("doc_id") % 90).cast("string"))
    return fields.summary_context(h.select("query_id", "rank", F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("client_name"), source.alias("source_document"), F.col("text").alias("chunk_text")))


@query("rule_summaries", """with {docs}, k as (select client_name, project_code, document_kind, min(struct_pack(ingested_at, doc_id)) f from docs group by all), kk as (select *, row_number() over (partition by client_name, project_code order by f) n from k),
 ks as (select client_name, project_code, string_agg(document_kind, ', ' order by n) filter (n <= 3) kinds, bool_or(document_kind in ('quote', 'purchase_order')) logistics, bool_or(document_kind = 'invoice') invoiced from kk group by 1, 2),
 g as (select client_name, project_code, min(contact) contact, arg_min(project_name, struct_pack(ingested_at, doc_id)) project_name, count(*) n, min(report_date) lo, max(report_date) hi from docs group by 1, 2)
 select client_name, lower(project_code) project_key, project_name || ' covers ' || kinds || ' work for ' || client_name || ' across ' || n || ' related documents dated between ' || lo || ' and ' || hi || '. Key participants include ' || contact ||
 ', and the document set links the work through references such as ' || project_code || '. Recommendations: Recommendations are not explicitly captured in the available metadata. Issues and key findings: No explicit issues or findings were extracted from the available documents. The available records indicate that ' ||
 case when not logistics and not invoiced then 'commercial status is only partially evidenced in the stored documents' else concat_ws(', ', case when logistics then 'logistics and access coordination are documented' end, case when invoiced then 'invoice records are present' end) end ||
 '. Conclusions should be based on the documented findings and recommended actions above.' summary from g join ks using (client_name, project_code)""")
def rule_summaries(spark, d):
    a = analysed(spark, d).withColumn("related_references", F.array("project_code")).withColumn("excerpt", F.lit("")).withColumn("currency_amounts", F.array().cast("array<string>"))
    return fields.rule_summary(grouping.checkpointed(a.drop("content_hash", "title", "findings", "recommendations")))


@query("field_rescoring", """with h as (select lang query_id, source source_document, text chunk_text, doc_id, (n_chars % 100) / 100.0::double score, lower(text) low from documents where lang is not null and source is not null),
 s as (select *, score + 0.04 + case when doc_id % 2 = 0 then 0.12 else 0 end total from h where contains(low, 'an')),
 o as (select *, row_number() over (partition by query_id, source_document order by total desc, chunk_text) r from s) select query_id, source_document, round(total, 6) score from (select *, row_number() over (partition by query_id order by total desc, source_document, chunk_text) place from o where r = 1) where place <= 3""")
def field_rescoring(spark, d):
    none = F.lit(None).cast("string")
    h = t(spark, d, "documents").where("lang is not null and source is not null").select(
        F.col("lang").alias("query_id"), F.col("source").alias("source_document"), F.col("text").alias("chunk_text"), (F.col("n_chars") % 100 / 100.0).alias("score"), F.when(F.col("doc_id") % 2 == 0, "Key").otherwise("x").alias("project_key"), none.alias("project_code"), none.alias("report_date"),
        F.array().cast("array<string>").alias("related_references"), F.lit("key").alias("hint_key"), none.alias("hint_code"), F.array(F.lit("r")).alias("hint_references"), F.array(F.lit("2020")).alias("hint_years"),
    )
    return fields.rescored(h, "an").select("query_id", "source_document", F.round("score", 6).alias("score"))


@query("local_evidence")
def local_evidence(spark, d):
    """What speaks for a quoted price in the first six documents of each project."""
    w = Window.partitionBy("client_name", "project_key").orderBy("ingested_at", "doc_id")
    # Client and project tell which documents are the first; only on those do the other patterns run.
    own = with_fields(rendered(spark, d)).select("doc_id", "source_path", "ingested_at", "text", "client_name", "project_key")
    first = own.withColumn("position", F.row_number().over(w)).where("position <= 6").withColumnsRenamed({"client_name": "__client_name", "project_key": "__project_key"})
    a = with_fields(first, ("position", "__client_name", "__project_key")).drop("client_name", "project_key").withColumnsRenamed({"__client_name": "client_name", "__project_key": "project_key"})
    a = a.withColumn("excerpt", F.col("text")).withColumn("currency_amounts", money.currency_amounts(F.col("text"))).withColumn("document_name", F.lit(None).cast("string"))
    return fields.local_evidence(a, "quoted")


@query("extra_hits", "with h as (select doc_id % 20 query_id, coalesce(source, '') source_document, n_chars % 97 score, doc_id chunk_text, doc_id % 3 = 0 own from documents), o as (select * from h where own), e as (select * from h where not own and not exists (select 1 from o where o.query_id = h.query_id and o.source_document = h.source_document)), b as (select *, 0 turn from o union all select *, 1 turn from e) select query_id, chunk_text doc_id, (row_number() over (partition by query_id order by turn, score desc, source_document, chunk_text))::int as \"rank\" from b")
def extra_hits(spark, d):
    h = t(spark, d, "documents").select((F.col("doc_id") % 20).alias("query_id"), F.coalesce("source", F.lit("")).alias("source_document"), (F.col("n_chars") % 97).alias("score"), F.col("doc_id").alias("chunk_text"))
    return scans.extra_hits(h.where("chunk_text % 3 = 0"), h.where("chunk_text % 3 <> 0")).select("query_id", F.col("chunk_text").alias("doc_id"), "rank")


@query("answers", "select o_orderkey key, case when o_orderkey % 4 = 0 then 'missing_in_batch' when o_orderkey % 3 = 0 or o_orderkey % 5 = 0 then 'absent_or_rejected' when o_orderkey % 7 = 0 then 'insufficient_evidence' else 'accepted' end status, case when o_orderkey % 4 = 0 or o_orderkey % 3 = 0 or o_orderkey % 5 = 0 or o_orderkey % 7 = 0 then 'Information not present' else o_orderpriority end normalized_answer from orders")
def answers(spark, d):
    k = F.col("key")
    q = t(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderkey").alias("position"), "o_orderpriority")
    given = q.where(k % 4 != 0).select("key", (k % 3 != 0).alias("is_present"), F.when(k % 5 == 0, " Insufficient evidence to say").otherwise(F.col("o_orderpriority")).alias("answer"), F.when(k % 7 == 0, "short").otherwise("long enough").alias("evidence"))
    return fields.batch_answers(q.select("key", "position"), given).select("key", "status", "normalized_answer")


@query("resolved_clients", "with {docs} select doc_id, client_name from docs")
def resolved_clients(spark, d):
    """Extracted names stand, and where every fifth is blotted out the references of the client's other documents tell it."""
    a = with_fields(rendered(spark, d)).withColumn("confidence", F.lit(0.8)).withColumn("is_client_related", F.lit(True))
    own = F.array(F.concat(F.lit("REF-"), F.regexp_extract("source_path", r"_(\d+)[.]", 1)))
    rows = a.select("doc_id", "source_path", "text", "confidence", "is_client_related", F.when(F.col("doc_id") % 5 != 0, F.col("client_name")).alias("client_name"), own.alias("related_references"))
    known = a.select("client_name", own.alias("related_references")).distinct()
    return resolve.resolved_clients(rows, known).select("doc_id", "client_name")


# Derived texts and ingest -----------------------------------------------------------------------

_FIELD_KEYS = ("title", "date", "participants", "quoted", "gaps")


def _project_parts(a: DataFrame, part: Column) -> DataFrame:
    """What ``_project_facts`` needs of the documents of each project and part: one row, however many they are."""
    quotes = F.count_if(F.col("document_kind") == "quote")
    return a.groupBy("client_name", "project_key", part.alias("part")).agg(F.max("project_name").alias("project_name"), F.max("report_date").alias("d"), F.min(F.col("contacts")[0]).alias("c"), quotes.alias("q"), F.count(F.lit(1)).alias("n"))


def _project_facts(parts: DataFrame) -> DataFrame:
    """Fields, summary and answers of each project, from the parts of its documents."""
    value = lambda v: F.struct(v.cast("string").alias("value"), F.lit("present").alias("status"), F.lit("rules").alias("method"))
    g = parts.groupBy("client_name", "project_key").agg(F.max("project_name").alias("project_name"), F.max("d").alias("d"), F.min("c").alias("c"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    fields_of = F.create_map(F.lit("date"), value(F.col("d")), F.lit("title"), value(F.col("project_name")), F.lit("participants"), value(F.col("c")), F.lit("quoted"), value(F.when(F.col("q") > 0, F.col("q").cast("string")).otherwise(F.lit("  "))))
    said = F.concat(F.lit("  Work  for "), F.col("client_name"), F.lit(". Recommendations:none"))
    answers = F.create_map(F.lit("scope"), F.concat(F.col("n").cast("string"), F.lit(" documents ")), F.lit("dates"), F.col("d"), F.lit("risks"), F.lit(" "))
    return g.select("client_name", "project_key", "project_name", fields_of.alias("fields"), F.when(F.col("n") > 1, said).otherwise(F.lit(" ")).alias("summary"), F.lit("rules").alias("summary_method"), answers.alias("answers"))


def _derived_sql(docs: str) -> str:
    return f"""(select source_document, document_kind, chunk_text from (select client_name, lower(project_code) project_key, max(project_name) project_name, max(report_date) d, min(contact) c, count(*) filter (document_kind = 'quote') q, count(*) n from {docs} group by 1, 2) g,
 lateral (select unnest([struct_pack(source_document := '__project_fields__/' || client_name || '/' || project_key, document_kind := 'project_fields', chunk_text := 'Client: ' || client_name || chr(10) || 'Project: ' || project_name || chr(10) || 'Project key: ' || project_key || chr(10)
  || 'Key fields:' || chr(10) || '- title: ' || project_name || ' (status=present, method=rules)' || chr(10) || '- date: ' || d || ' (status=present, method=rules)' || chr(10) || '- participants: ' || c || ' (status=present, method=rules)' || chr(10)
  || '- quoted: ' || case when q > 0 then q::varchar else 'Information not present' end || ' (status=present, method=rules)' || chr(10) || '- gaps: Information not present (status=unknown, method=unknown)'),
 struct_pack(source_document := case when n > 1 then '__project_summary__/' || client_name || '/' || project_key end, document_kind := 'project_summary', chunk_text := 'Client: ' || client_name || chr(10) || 'Project: ' || project_name || chr(10) || 'Project key: ' || project_key || chr(10)
  || 'Summary method: rules' || chr(10) || 'Summary:' || chr(10) || 'Work for ' || client_name || '.' || chr(10) || 'Recommendations: none' || chr(10) || 'Questionnaire:' || chr(10) || '- dates: ' || d || chr(10) || '- scope: ' || n || ' documents')], recursive := true)) where source_document is not null)"""


@query("derived_index", f"""with {{docs}}, earlier as (select * from docs where doc_id % 10 <> 0), b as {_derived_sql("earlier")}, a as {_derived_sql("docs")}
 select a.source_document, a.document_kind, a.chunk_text, case when b.source_document is null then 'added' when b.chunk_text <> a.chunk_text then 'changed' else 'kept' end state, 384::bigint n_dims from a left join b using (source_document)""")
def derived_index(spark, d):
    """The index of nine tenths of the documents, then of all of them."""
    a = grouping.checkpointed(_project_parts(analysed(spark, d), F.col("doc_id") % 10 != 0))

    def texts(parts: DataFrame) -> DataFrame:
        facts = _project_facts(parts)
        return derived.field_texts(facts, _FIELD_KEYS).unionByName(derived.summary_texts(facts))

    # The index holds texts: vectors are their hashes' and are drawn at the end, so none is written.
    none = spark.createDataFrame([], ", ".join(f"{c} string" for c in derived.COLUMNS))
    before, _ = derived.refreshed(none, texts(a.where("part")))
    after, changed = derived.refreshed(grouping.checkpointed(before), texts(a))
    told = after.join(changed.select(*derived.KEY, "state"), list(derived.KEY), "left").select("source_document", "document_kind", "chunk_text", F.coalesce("state", F.lit("kept")).alias("state"))
    return retrieval.embedded(told).select("source_document", "document_kind", "chunk_text", "state", F.size("embedding").cast("long").alias("n_dims"))


@query("progress_events", """with {docs}, s as (select *, case when doc_id % 11 = 0 then 'error' when doc_id % 13 = 0 then 'unsupported' when doc_id % 7 = 0 then 'skipped_duplicate' else 'ingested' end st from docs),
 e as (select *, case st when 'error' then ['file_started', 'file_error'] when 'unsupported' then ['file_unsupported'] when 'skipped_duplicate' then ['file_started', 'file_read', 'file_skipped_duplicate', 'file_completed']
  else ['file_started', 'file_read', 'classification_completed', 'extraction_completed', 'project_resolution_completed', 'document_record_saved', 'report_version_saved', 'file_completed'] end es from s),
 u as (select *, unnest(es) event, generate_subscripts(es, 1) - 1 n from e)
 select doc_id, source_path path, n, event, case when event in ('file_completed', 'file_error', 'file_unsupported') then st end status, case when st = 'ingested' and event in ('classification_completed', 'file_completed') then document_kind end document_kind,
  case when st = 'ingested' and event = 'file_completed' then client_name end client_name, case when event = 'project_resolution_completed' then lower(project_code) end project_key from u""")
def progress_events(spark, d):
    """Events of an ingest in which every seventh document is known, and some can't be read."""
    r = rendered(spark, d)
    bad = F.when(F.col("doc_id") % 11 == 0, "no such file").when(F.col("doc_id") % 13 == 0, "unsupported")
    known = r.where("doc_id % 7 = 0").select("source_path", text.content_hash(F.col("text")).alias("content_hash"))
    rows = r.select("doc_id", "source_path", F.lit("text").alias("source_type"), "text", bad.alias("error"))
    return ingest.progress_events(ingest.outcomes(rows, known), keep=("doc_id",)).select("doc_id", "path", "n", "event", "status", "document_kind", "client_name", "project_key")


@query("ingest_statuses", "with {docs}, s as (select case when doc_id % 11 = 0 then 'error' when doc_id % 13 = 0 then 'unsupported' when doc_id % 7 = 0 then 'skipped_duplicate' else 'ingested' end status from docs) select status, count(*) n from s where status in ('skipped_duplicate', 'ingested') group by 1")
def ingest_statuses(spark, d):
    """With what status the files of ``progress_events`` were completed."""
    return event_ops.status_counts(progress_events(spark, d))
