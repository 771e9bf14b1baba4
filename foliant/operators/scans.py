"""Reads and writes of the stored tables: scans, projections for display, appends, JSON lines, reset with a backup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import moment
from ..functions.text import basename, document_link, document_references, ordered_union, stem, url_quote
from .documents import clamp

PROJECT_COLUMNS = ("doc_id", "source_path", "document_kind", "title", "report_type", "report_date", "project_key", "project_name", "project_code", "ingested_at")


def all_documents(docs: DataFrame) -> DataFrame:
    """Newest first."""
    return docs.orderBy(F.desc("ingested_at"), F.desc("doc_id"))


def client_nodes(nodes: DataFrame, client: str) -> DataFrame:
    return nodes.where(F.col("client_name") == client).orderBy("node_path")


def node(nodes: DataFrame, client: str, path: str) -> DataFrame:
    return nodes.where((F.col("client_name") == client) & (F.col("node_path") == path)).limit(1)


def failures(rows: DataFrame, limit: int = 20) -> DataFrame:
    """Newest summary failures first."""
    return rows.orderBy(F.desc("created_at"), F.desc("failure_id")).limit(clamp(limit))


def project_documents(docs: DataFrame, client: str, project: str | None = None) -> DataFrame:
    """A client's documents, or those of one project, in the columns of a project page; latest date first, then name,
    both descending."""
    out = docs.where(F.col("client_name") == client)
    if project:
        out = out.where(F.col("project_key") == project)
    return out.select(*PROJECT_COLUMNS).orderBy(F.desc(F.coalesce("report_date", F.date_format("ingested_at", "yyyy-MM-dd"))), F.desc(basename(F.col("source_path"))))


def non_reports(docs: DataFrame) -> DataFrame:
    return docs.where(F.coalesce("document_kind", F.lit("unknown")) != "report")


def visual_timeline(events: DataFrame) -> DataFrame:
    """Timeline rows as a chart takes them: epoch milliseconds (0 for undated ones) and defaults for what is missing."""
    shown = F.coalesce(F.nullif("display_date", F.lit("")), F.nullif("created_at", F.lit("")))
    name = F.nullif(basename(F.col("source_document")), F.lit(""))
    or_else = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other)).alias(c)
    return events.select(
        "event_id",
        F.coalesce(F.unix_millis(moment(shown)), F.lit(0).cast("long")).alias("timestamp"),
        F.coalesce(shown, F.lit("Undated")).alias("date_label"),
        or_else("summary", "Event"), or_else("client_name", "Unknown client"), or_else("document_kind", "unknown"), or_else("project_name", ""),
        F.coalesce(name, F.lit("Document")).alias("document_name"),
        F.when(name.isNotNull(), document_link(F.col("source_document"))).otherwise("#").alias("document_href"),
    ).orderBy("timestamp", "summary", "event_id")


def decorated(docs: DataFrame, excerpt: Column, amounts: Column) -> DataFrame:
    """Documents as a project page shows them: names, links, cleaned lists and references, excerpt and amounts."""
    text = lambda c, other="": F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(other))
    path = F.col("source_path")
    none = F.array().cast("array<string>")
    kind = text("document_kind", "unknown")
    return docs.select(
        "doc_id", "source_path", basename(path).alias("document_name"), stem(path).alias("document_stem"), document_link(path).alias("document_href"),
        F.concat(F.lit("/report/versions?path="), url_quote(path)).alias("versions_href"), kind.alias("document_kind"),
        F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.nullif(basename(path), F.lit("")), F.lit("Untitled document")).alias("title"),
        *[text(c).alias(c) for c in ("client_name", "project_key", "project_name", "project_code", "report_type")],
        *[ordered_union(F.coalesce(F.col(c), none)).alias(c) for c in ("findings", "recommendations", "authors", "contacts")],
        document_references([F.col("project_code")], F.col("related_references")).alias("related_references"),
        excerpt.alias("excerpt"), amounts.alias("currency_amounts"), (kind == "report").alias("is_report"),
    )


def merge_candidates(pairs: DataFrame) -> DataFrame:
    """Pairs of clients to merge, the surest first, then by names with case put aside."""
    return pairs.orderBy(F.desc("confidence"), F.lower("target"), F.lower("source"), "target", "source")


def append(rows: DataFrame, path: str) -> None:
    """Rows added to a table's folder, whatever is there already (vectors, failures, documents)."""
    rows.write.mode("append").parquet(path)


def append_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    rows.write.mode("append").json(path)


def as_json(rows: DataFrame) -> DataFrame:
    """(value): one JSON object a row, nulls included."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def reset(spark: SparkSession, path: str, stamp: str, backup: bool = True) -> str | None:
    """Take a warehouse folder away: renamed to ``.bak_<stamp>`` (with a number if that is there), or deleted. The backup's
    path, or None."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return None
    if not backup:
        fs.delete(at, True)
        return None
    new, n = f"{path}.bak_{stamp}", 0
    while fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new)):
        n += 1
        new = f"{path}.bak_{stamp}_{n}"
    fs.rename(at, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new))
    return new


def extra_hits(own: DataFrame, extra: DataFrame, key: str = "query_id") -> DataFrame:
    """Hits followed by those of sources that none of them has."""
    seen = own.select(key, "source_document").distinct()
    new = extra.join(seen, [key, "source_document"], "left_anti").withColumn("turn", F.lit(1))
    both = own.withColumn("turn", F.lit(0)).unionByName(new.select(*own.columns, "turn"))
    w = Window.partitionBy(key).orderBy("turn", F.desc("score"), "source_document", "chunk_text")
    return both.withColumn("rank", F.row_number().over(w)).drop("turn")

