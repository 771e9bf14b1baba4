"""Changes that run through several tables: projects of documents, report dates, and the history of profile nodes.

Each takes the state of its tables before and gives that after. Changes are tables themselves and are joined, so any
number of paths and clients changes in one pass; what a change takes along in other tables is told by semi and anti joins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import forward
from .resolve import suspicious_clients

PROJECT = ("project_key", "project_name", "project_code")
#: The facts of a node in which a difference counts.
FACTS = ("document_kind", "report_type", "authors", "contacts", "findings", "recommendations", "report_date", "project_name", "project_code", "project_summary", "document_kinds", "related_references")


def filled(c: str) -> Column:
    """Without spaces at the ends; null if nothing is left."""
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def reassign(tables: dict[str, DataFrame], changes: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables after documents got other projects, and a row of the five counts.

    ``changes``: client_name, source_path, project_key, project_name, project_code (blank: none), related_references and
    old_project_key; of several rows of one path and client the last by project key counts. Documents change if path and client are those of
    a change. Vectors (by source_document) and versions (by source_path, with their ``snapshot`` struct) change by path; for them a path that several
    clients' changes name takes the client first in the alphabet. Summaries and key fields of a client's project go if a document came to it or left it.
    ``tables``: documents, vectors, versions, project_summaries and project_key_fields.
    """
    refs = F.filter(F.transform(F.coalesce("related_references", F.array().cast("array<string>")), lambda r: F.trim(r)), lambda r: r != "")
    new = F.struct(*(filled(c).alias(c) for c in PROJECT), refs.alias("related_references"), filled("old_project_key").alias("old"))
    wanted = changes.where("trim(source_path) != ''").groupBy(F.col("client_name").alias("__client"), F.trim("source_path").alias("__path")).agg(F.max(new).alias("__new"))
    by_path = wanted.groupBy("__path").agg(F.min_by("__new", "__client").alias("__new"))

    def changed(t: DataFrame, on: Column, by: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        j = t.join(by, on, "left").withColumn("__hit", F.col("__new").isNotNull())
        put = lambda c, old: F.when(F.col("__hit"), F.col(f"__new.{c}")).otherwise(old)
        j = j.withColumns({c: put(c, F.col(c)) for c in columns})
        if "snapshot" in t.columns:
            j = j.withColumn("snapshot", reduce(lambda s, c: s.withField(c, put(c, F.col(f"snapshot.{c}"))), PROJECT, F.col("snapshot")))
        return j

    documents, vectors, versions = tables["documents"], tables["vectors"], tables["versions"]
    docs = changed(documents, (F.trim(documents["source_path"]) == F.col("__path")) & (documents["client_name"] == F.col("__client")), wanted, (*PROJECT, "related_references"))
    vecs = changed(vectors, F.trim(vectors["source_document"]) == F.col("__path"), by_path, (*PROJECT, "related_references"))
    vers = changed(versions, F.trim(versions["source_path"]) == F.col("__path"), by_path, PROJECT)
    touched = docs.where("__hit").select("client_name", F.explode(F.array("__new.project_key", "__new.old")).alias("project_key")).where("project_key is not null").distinct()
    out = {"documents": docs.select(*documents.columns), "vectors": vecs.select(*vectors.columns), "versions": vers.select(*versions.columns)}
    counts = [("updated_documents", docs.where("__hit")), ("updated_vectors", vecs.where("__hit")), ("updated_versions", vers.where("__hit"))]
    for name in ("project_summaries", "project_key_fields"):
        out[name] = tables[name].join(touched, ["client_name", "project_key"], "left_anti").select(*tables[name].columns)
        counts.append((f"cleared_{name}", tables[name].join(touched, ["client_name", "project_key"], "left_semi")))
    each = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, t in counts]
    return out, reduce(DataFrame.unionByName, each)


def set_report_dates(documents: DataFrame, timeline: DataFrame, profiles: DataFrame, changes: DataFrame) -> dict[str, DataFrame]:
    """Documents, timeline and profiles after dates were set by hand, and ``found``: each path and whether any document has it.

    ``changes``: source_path and report_date; of several dates of a path the latest counts. A path's rows with the content of its
    newest row get the date. Timeline rows of a known path get it where they have none. In profiles the entries of
    ``source_reports`` (structs of path and date) for a known path get it, and a profile without a report date takes that of its first such entry.
    Either kind of slash will do.
    """
    wanted = changes.groupBy(forward(F.col("source_path")).alias("__path")).agg(F.max("report_date").alias("__date"))
    newest = documents.groupBy(forward(F.col("source_path")).alias("__path")).agg(F.max_by("content_hash", F.struct("ingested_at", "doc_id")).alias("__hash"))
    known = wanted.join(newest, "__path")
    docs = documents.join(known, (forward(documents["source_path"]) == F.col("__path")) & (documents["content_hash"] == F.col("__hash")), "left")
    events = timeline.join(known, forward(timeline["source_document"]) == F.col("__path"), "left")
    entries = profiles.select("client_name", "node_path", F.posexplode("source_reports").alias("__at", "__r")).withColumn("__path", forward(F.col("__r.path")))
    dated = entries.join(known, "__path").groupBy("client_name", "node_path").agg(F.map_from_entries(F.collect_list(F.struct("__at", "__date"))).alias("__dates"), F.min_by("__date", "__at").alias("__first"))
    dated = dated.select(F.col("client_name").alias("__client"), F.col("node_path").alias("__node"), "__dates", "__first")
    nodes = profiles.join(dated, profiles["client_name"].eqNullSafe(F.col("__client")) & (profiles["node_path"] == F.col("__node")), "left")
    redated = F.transform("source_reports", lambda r, i: r.withField("date", F.coalesce(F.col("__dates")[i], r["date"])))
    nodes = nodes.withColumn("source_reports", F.when(F.col("__first").isNull(), F.col("source_reports")).otherwise(redated)).withColumn("report_date", F.coalesce(F.nullif("report_date", F.lit("")), "__first", "report_date"))
    return {
        "documents": docs.withColumn("report_date", F.coalesce("__date", "report_date")).select(*documents.columns),
        "timeline": events.withColumn("event_date", F.coalesce("event_date", "__date")).select(*timeline.columns),
        "profiles": nodes.select(*profiles.columns),
        "found": wanted.join(newest.select("__path", F.lit(True).alias("found")), "__path", "left").select(F.col("__path").alias("source_path"), F.coalesce("found", F.lit(False)).alias("found")),
    }


def cleanup_suspicious(tables: dict[str, DataFrame], documents_too: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without the clients that ``suspicious_clients`` finds, and a row for each of them with its counts.

    ``tables``: documents, vectors, profiles, history and timeline. Profiles, history and timeline of such clients go. Their vectors lose the client; their documents lose
    client, project and references, or, with ``documents_too``, all that has the path of a found document goes from every table, entries of ``source_reports`` too.
    Counts: profiles, history, timeline and vectors_cleared by client, documents_deleted by path (0 unless ``documents_too``); what goes
    by its path counts there only, and a path that several found clients share counts for the first of them in the alphabet.
    """
    found = suspicious_clients(tables["documents"])
    clients = found.select(F.col("client_name").alias("__client"))
    paths = found.groupBy(forward(F.col("source_path")).alias("__path")).agg(F.min("client_name").alias("client_name"))
    at = lambda t: forward(F.col("source_path" if "source_path" in t.columns else "source_document"))
    out, deleted = dict(tables), None
    if documents_too:
        placed = tables["documents"].withColumn("__path", at(tables["documents"]))
        deleted = placed.join(paths, "__path", "left_semi").groupBy("__path").agg(F.count(F.lit(1)).alias("documents_deleted")).join(paths, "__path").drop("__path")
        for name, t in tables.items():
            if {"source_path", "source_document"} & set(t.columns):
                t = t.withColumn("__path", at(t)).join(paths, "__path", "left_anti").select(*t.columns)
            if "source_reports" in t.columns:
                t = _without_reports(t, paths)
            out[name] = t
    counted = []
    for name in ("profiles", "history", "timeline", "vectors"):
        mine = out[name].join(clients, F.col("client_name") == F.col("__client"), "left_semi")
        counted.append(mine.groupBy("client_name").agg(F.count(F.lit(1)).alias("vectors_cleared" if name == "vectors" else name)))
    counted.append(found.select("client_name", F.lit(0).cast("long").alias("documents_deleted")) if deleted is None else deleted.groupBy("client_name").agg(F.sum("documents_deleted").alias("documents_deleted")))
    told = reduce(lambda a, b: a.join(b, "client_name", "left"), counted, found).na.fill(0)
    for name in ("profiles", "history", "timeline"):
        out[name] = out[name].join(clients, F.col("client_name") == F.col("__client"), "left_anti")
    for name in ("vectors", "documents"):
        t = out[name].join(clients, F.col("client_name") == F.col("__client"), "left").withColumn("__own", F.col("__client").isNotNull())
        blank = ("client_name",) if name == "vectors" else ("client_name", *PROJECT)
        t = t.withColumns({c: F.when(~F.col("__own"), F.col(c)) for c in blank if c in t.columns})
        if name == "documents" and "related_references" in t.columns:
            t = t.withColumn("related_references", F.when(F.col("__own"), F.array().cast("array<string>")).otherwise(F.col("related_references")))
        out[name] = t.select(*out[name].columns)
    return out, told


def _without_reports(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes whose ``source_reports`` lost the entries of the paths."""
    entries = nodes.select("client_name", "node_path", F.posexplode("source_reports").alias("__at", "__r")).withColumn("__path", forward(F.col("__r.path")))
    lost = entries.join(paths.select("__path"), "__path", "left_semi").groupBy(F.col("client_name").alias("__owner"), F.col("node_path").alias("__node")).agg(F.collect_set("__at").alias("__lost"))
    j = nodes.join(lost, nodes["client_name"].eqNullSafe(F.col("__owner")) & (nodes["node_path"] == F.col("__node")), "left")
    kept = F.filter("source_reports", lambda r, i: ~F.array_contains("__lost", i))
    return j.withColumn("source_reports", F.when(F.col("__lost").isNull(), F.col("source_reports")).otherwise(kept)).select(*nodes.columns)


def node_states(rows: DataFrame) -> DataFrame:
    """The states of every profile node: each stretch of documents with the same facts, by the last of them.

    ``rows``: client_name, node_path, ingested_at, doc_id, source_path, report_date and any of ``FACTS``. A state that another one
    replaced names the document that did so in ``superseded_by``; the one without is current. ``source_reports`` has the paths seen up to the
    state's end in the order of their first documents, each with its last known date; ``version`` counts a node's states from 1.
    """
    w = Window.partitionBy("client_name", "node_path").orderBy("ingested_at", "doc_id")
    facts = F.struct(*[c for c in FACTS if c in rows.columns])
    marked = rows.withColumns({"__next": F.lead(facts).over(w), "superseded_by": F.lead("source_path").over(w), "__place": F.row_number().over(w)})
    last = marked.withColumn("__ends", F.col("superseded_by").isNull() | ~F.col("__next").eqNullSafe(facts))
    # A path's entry changes where it is new or has a date that it hadn't; only such rows are gathered.
    own = Window.partitionBy("client_name", "node_path", "source_path").orderBy("ingested_at", "doc_id")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    date = F.nullif("report_date", F.lit(""))
    news = (F.row_number().over(own) == 1) | (date.isNotNull() & ~F.last(date, ignorenulls=True).over(before).eqNullSafe(date))
    entry = F.struct(F.min("__place").over(own).alias("first"), F.col("source_path").alias("path"), date.alias("date"))
    gathered = F.collect_list(F.when(F.col("__news"), F.col("__entry"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    states = last.withColumns({"__news": news, "__entry": entry}).withColumn("__seen", gathered).where("__ends")
    dates = F.aggregate("__seen", F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["path"]), F.create_map(e["path"], F.coalesce(e["date"], F.try_element_at(m, e["path"])))))
    paths = F.array_sort(F.array_distinct(F.transform("__seen", lambda e: F.struct(e["first"], e["path"]))))
    states = states.withColumn("__dates", dates).withColumn("source_reports", F.transform(paths, lambda p: F.struct(p["path"].alias("path"), F.try_element_at(F.col("__dates"), p["path"]).alias("date"))))
    return states.withColumn("version", F.row_number().over(w)).drop("__next", "__place", "__ends", "__news", "__entry", "__seen", "__dates")


def node_history_by_path(states: DataFrame) -> DataFrame:
    """(client_name, node_path, versions): each node's replaced states, newest first."""
    old = states.where("superseded_by is not null")
    entry = F.struct((-F.col("version")).alias("place"), "version", "superseded_by", F.col("doc_id"), *[c for c in FACTS if c in states.columns], "source_reports")
    return old.groupBy("client_name", "node_path").agg(F.array_sort(F.collect_list(entry)).alias("versions"))
