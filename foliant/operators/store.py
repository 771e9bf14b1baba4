"""Row-level changes as DataFrame transformations: upserts, deletes, merges, reassignment.

Each function takes the state before and returns the state after; ``save`` swaps a table's
folder. Lists of changed paths or clients come as DataFrames and are joined, never looped over.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import forward, ordered_union

SCALARS = ("project_name", "project_code", "report_type", "report_date", "title", "document_kind", "summary")
LISTS = ("findings", "recommendations", "authors", "contacts", "document_kinds", "related_references")


def keep_latest(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """One row per key: the newest."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Incoming rows replace stored ones of their key; columns in ``keep`` stay as stored."""
    old = stored.select(*keys, *(F.col(c).alias(f"__{c}") for c in keep))
    new = incoming.join(old, keys, "left")
    for c in keep:
        new = new.withColumn(c, F.coalesce(f"__{c}", c)).drop(f"__{c}")
    return stored.join(incoming.select(*keys), keys, "left_anti").unionByName(new.select(*stored.columns))


def insert_absent(stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Incoming rows whose key (nulls count as empty) is not there yet; of equal ones the first by ``order``."""
    w = Window.partitionBy(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).orderBy(*order)
    first = incoming.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    told = lambda side, k: F.coalesce(F.col(f"{side}.{k}").cast("string"), F.lit(""))
    same = reduce(lambda a, b: a & b, [told("old", k) == told("new", k) for k in keys])
    return stored.unionByName(first.alias("new").join(stored.alias("old"), same, "left_anti"))


def replace_rows(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the incoming keys are taken out, the incoming rows put in."""
    same = reduce(lambda a, b: a & b, [F.coalesce(stored[k].cast("string"), F.lit("")) == F.coalesce(incoming[k].cast("string"), F.lit("")) for k in keys])
    return stored.join(incoming, same, "left_anti").unionByName(incoming)


def set_map_entry(entries: Column, key: Column, value: Column) -> Column:
    """A map with one entry set (a repeated key would be an error)."""
    return F.map_concat(F.map_filter(entries, lambda k, v: k != key), F.create_map(key, value))


def upsert_report(reports: Column, path: Column, date: Column) -> Column:
    """``source_reports`` with a path's date set, or the path added."""
    changed = F.transform(reports, lambda r: F.when(r["path"] == path, F.struct(r["path"].alias("path"), F.coalesce(date, r["date"]).alias("date"))).otherwise(r))
    return F.when(F.exists(reports, lambda r: r["path"] == path), changed).otherwise(F.concat(reports, F.array(F.struct(path.alias("path"), date.alias("date")))))


def merge_facts(target: str, source: str) -> list[Column]:
    """Merged fact columns: the target's scalars win unless empty, lists are united source first, reports are those of both by
    path (the target's date of a path wins), and of additional fields the target's win."""
    scalar = [F.coalesce(F.nullif(F.col(f"{target}.{c}"), F.lit("")), F.col(f"{source}.{c}")).alias(c) for c in SCALARS]
    lists = [ordered_union(F.col(f"{source}.{c}"), F.col(f"{target}.{c}")).alias(c) for c in LISTS]
    return scalar + lists


def merged_reports(target: Column, source: Column) -> Column:
    """``source_reports`` of both, each path once: the target's unless it has no date."""
    none = F.array().cast("array<struct<path:string,date:string>>")
    a, b = F.coalesce(target, none), F.coalesce(source, none)
    dated = lambda r: F.try_element_at(F.filter(b, lambda s: s["path"] == r["path"]), F.lit(1))["date"]
    own = F.transform(a, lambda r: F.struct(r["path"].alias("path"), F.coalesce(r["date"], dated(r)).alias("date")))
    return F.concat(own, F.filter(b, lambda s: ~F.exists(a, lambda r: r["path"] == s["path"])))


def merged_fields(target: Column, source: Column) -> Column:
    """``additional_fields`` of both; of one key the target's value stays."""
    none = F.create_map().cast("map<string,string>")
    a = F.coalesce(target, none)
    return F.map_concat(F.map_filter(F.coalesce(source, none), lambda k, v: ~F.map_contains_key(a, k)), a)


def merge_counts(tables: dict[str, DataFrame], source: str) -> DataFrame:
    """(name, n) of the rows of each table that a merge of ``source`` into another client moves."""
    parts = [t.where(F.col("client_name") == source).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def merge_clients(nodes: DataFrame, source: str, target: str) -> DataFrame:
    """Profile nodes after ``source`` is merged into ``target``: nodes of both are merged, others move."""
    if not source.strip() or not target.strip() or source.strip() == target.strip():
        raise ValueError("two different client names are needed")
    s, t = nodes.where(F.col("client_name") == source).alias("s"), nodes.where(F.col("client_name") == target).alias("t")
    facts = merge_facts("t", "s")
    if "source_reports" in nodes.columns:
        facts.append(merged_reports(F.col("t.source_reports"), F.col("s.source_reports")).alias("source_reports"))
    if "additional_fields" in nodes.columns:
        facts.append(merged_fields(F.col("t.additional_fields"), F.col("s.additional_fields")).alias("additional_fields"))
    both = s.join(t, F.col("s.node_path") == F.col("t.node_path"), "full").select(F.lit(target).alias("client_name"), F.coalesce("t.node_path", "s.node_path").alias("node_path"), *facts)
    return nodes.where(~F.col("client_name").isin(source, target)).select(both.columns).unionByName(both)


def rename_client(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """``client_name`` by a (source, target) table."""
    return rows.join(mapping, rows.client_name == mapping.source, "left").withColumn("client_name", F.coalesce("target", "client_name")).drop("source", "target")


def reassign_projects(docs: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with new project columns, and the touched (client, project) keys, old and new."""
    new = changes.select("source_path", "client_name", *(F.col(c).alias(f"__{c}") for c in ("project_key", "project_name", "project_code")))
    out = docs.join(new, ["source_path", "client_name"], "left")
    hit = F.col("__project_key").isNotNull() & ~F.col("__project_key").eqNullSafe(F.col("project_key"))
    touched = out.where(hit).select("client_name", F.explode(F.array("project_key", "__project_key")).alias("project_key")).where("project_key is not null").distinct()
    for c in ("project_key", "project_name", "project_code"):
        out = out.withColumn(c, F.coalesce(f"__{c}", c))
    return out.select(*docs.columns), touched


def set_report_date(docs: DataFrame, path: str, date: str) -> DataFrame:
    """The date of every row with the path (either slash) and the content of its latest row."""
    same = forward(F.col("source_path")) == forward(F.lit(path))
    newest = docs.where(same).agg(F.max_by("content_hash", F.struct("ingested_at", "doc_id")).alias("h"))
    marked = docs.join(F.broadcast(newest), on=F.lit(True))
    return marked.withColumn("report_date", F.when(same & (F.col("content_hash") == F.col("h")), F.lit(date)).otherwise(F.col("report_date"))).drop("h")


def delete_document(tables: dict[str, DataFrame], path: str) -> dict[str, DataFrame]:
    """Every table without rows of a path, in either spelling, and ``source_reports`` without it."""
    out = {}
    for name, t in tables.items():
        column = "source_path" if "source_path" in t.columns else "source_document"
        if column in t.columns:
            t = t.where(~forward(F.col(column)).eqNullSafe(forward(F.lit(path))))
        if "source_reports" in t.columns:
            t = t.withColumn("source_reports", F.filter("source_reports", lambda r: forward(r["path"]) != forward(F.lit(path))))
        out[name] = t
    return out


def delete_client(tables: dict[str, DataFrame], client: str, documents_too: bool = False) -> dict[str, DataFrame]:
    """Profiles, history and timeline lose the client; vectors and documents lose only its name, project
    and references, unless documents go too."""
    out = {}
    for name, t in tables.items():
        own = F.col("client_name").eqNullSafe(F.lit(client))
        if name in ("profiles", "history", "timeline") or (name == "documents" and documents_too):
            out[name] = t.where(~own)
        else:
            t = t.withColumn("__own", own)
            own = F.col("__own")
            blank = [c for c in ("client_name", "project_key", "project_name", "project_code") if c in t.columns]
            for c in reversed(blank):
                t = t.withColumn(c, F.when(~own, F.col(c)))
            if "related_references" in t.columns:
                t = t.withColumn("related_references", F.when(own, F.array().cast("array<string>")).otherwise(F.col("related_references")))
            out[name] = t.drop("__own")
    return out


def delete_nodes(profiles: DataFrame, history: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``profiles`` and ``history`` without the nodes of ``gone`` (client_name, node_path), and how many profile rows each of these
    took away (n, 0 for a node that isn't there)."""
    key = ["client_name", "node_path"]
    wanted = gone.select(*key).distinct()
    found = profiles.join(wanted, key, "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    counts = wanted.join(found, key, "left").select(*key, F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return profiles.join(wanted, key, "left_anti"), history.join(wanted, key, "left_anti"), counts


def save(df: DataFrame, path: str) -> None:
    """Write a table beside the old one, then swap the folders through Hadoop's file system."""
    spark: SparkSession = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at, new, old = (jvm.org.apache.hadoop.fs.Path(path + s) for s in ("", ".new", ".old"))
    fs = at.getFileSystem(conf)
    df.write.mode("overwrite").parquet(path + ".new")
    fs.delete(old, True)
    if fs.exists(at):
        fs.rename(at, old)
    fs.rename(new, at)
    fs.delete(old, True)
