"""Grouping of a client's documents into projects, component by component of what they share.

Both groupings are order-dependent loops: a document joins the best of the groups that stand so far, and the
groups grow. A document can only join a group with which it shares evidence (a key, code, name, reference ...),
so documents are first cut into components of shared evidence by a distributed search, and the loop runs in each
component alone, with an index from evidence to groups. The result is that of the loop over the whole client; a client of
any size is as many tasks as it has components.
"""

from __future__ import annotations

import re
import tempfile
from collections import defaultdict, namedtuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import plain_name, project_tokens, slug
from .documents import project_rollup

#: Titles that name no project, and words that are left out of a name made from a title.
PLAIN_TITLES = ("technical consulting report", "report", "final report")
TITLE_NOISE = r"(?i)\b(q|po|rev|report|invoice|quote|purchase order|access request|email chain)\b"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to ``spark.checkpoint.dir``; a private folder serves only local runs in which that is unset."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="foliant-core-"))
    return df.checkpoint(eager=True)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the undirected edges (a, b): the least node that each node reaches.

    Large-star and small-star passes in turns; each is a grouped minimum and a join, so no component is gathered.
    """
    now = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        now = checkpointed(small.where("u != v").distinct())
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first())
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        before = state


def with_block(docs: DataFrame, evidence: Column, stored: bool = False) -> DataFrame:
    """``docs`` with ``block``: rows of one client that share evidence (an array of texts), directly or through others, have
    the same. Equal hashes may join two blocks, which changes no result.

    The nodes are the least pieces of evidence of rows, by which a row finds its block: all rows that name a piece link theirs with the least
    of these, so pieces that the same rows name are one set of edges. ``docs`` are written once, as they are read twice, unless they come from
    ``stored`` rows.
    """
    items = F.array_distinct(F.transform(evidence, lambda e: F.xxhash64(F.lit("item"), "client_name", e)))
    marked = docs.withColumn("__items", items).withColumn("__least", F.coalesce(F.array_min("__items"), F.xxhash64(F.lit("row"), "client_name", "doc_id")))
    marked = marked if stored else checkpointed(marked)
    named = marked.select(F.col("__least").alias("a"), F.explode("__items").alias("b")).distinct()
    found = components(named.withColumn("m", F.min("a").over(Window.partitionBy("b"))).select("a", F.col("m").alias("b")))
    return marked.drop("__items").join(found, F.col("__least") == F.col("node"), "left").withColumn("block", F.coalesce("label", "__least")).drop("__least", "node", "label")


def text_of(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))


def tagged(kind: str, values: Column) -> Column:
    """Evidence of one kind: texts that aren't empty, marked with the kind."""
    return F.transform(F.filter(values, lambda v: v.isNotNull() & (v != "")), lambda v: F.concat(F.lit(kind + ":"), v))


def listed(c: str, fold) -> Column:
    return F.array_distinct(F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda v: fold(F.trim(v))), lambda v: v.isNotNull() & (v != "")))


def year_of(c: Column) -> Column:
    return F.regexp_extract(c, r"\b(20\d{2}|19\d{2})\b", 1)


def cluster_projects(docs: DataFrame) -> DataFrame:
    """(client_name, doc_id, cluster): greedy clustering of each client's documents, newest first.

    A document joins the first best group that scores 7 or more: a key of the group scores 7, a code 6, a name 4, each
    shared reference 5, a year of the group 1 and another year -1. Clusters count from 0 in the order of their first documents.
    Columns: client_name, doc_id, ingested_at, project_key, project_code, project_name, refs, year.
    """
    plain = docs.select("client_name", "doc_id", "ingested_at", text_of("project_key").alias("key"), F.upper(text_of("project_code")).alias("code"), plain_name(text_of("project_name")).alias("name"), listed("refs", F.upper).alias("refs"), year_of(text_of("year")).alias("year"))
    evidence = F.concat(tagged("k", F.array("key")), tagged("c", F.array("code")), tagged("n", F.array("name")), tagged("r", F.col("refs")))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("ingested_at", "descending"), ("doc_id", "ascending")])
        by: dict[tuple, set[int]] = defaultdict(set)
        years: list[set] = []
        place = []
        for key, code, name, refs, year in zip(*(rows[c].to_pylist() for c in ("key", "code", "name", "refs", "year")), strict=True):
            own = [(k, v, s) for k, v, s in (("k", key, 7), ("c", code, 6), ("n", name, 4)) if v] + [("r", r, 5) for r in refs]
            score: dict[int, int] = defaultdict(int)
            for k, v, s in own:
                for g in by[k, v]:
                    score[g] += s
            if year:
                for g in score:
                    score[g] += (1 if year in years[g] else -1) if years[g] else 0
            best = min(score, key=lambda g: (-score[g], g), default=None)
            if best is None or score[best] < 7:
                best = len(years)
                years.append(set())
            for k, v, _ in own:
                by[k, v].add(best)
            if year:
                years[best].add(year)
            place.append(best)
        return rows.select(["client_name", "block", "doc_id"]).append_column("n", pa.array(place, pa.int32())).append_column("at", rows["ingested_at"])

    blocks = with_block(plain, evidence)
    at = dict(docs.dtypes)["ingested_at"]
    placed = checkpointed(blocks.groupBy("client_name", "block").applyInArrow(run, f"client_name string, block long, doc_id long, n int, at {at}"))
    # The first document of a cluster is the newest; only one row for each cluster is numbered.
    newest = F.max(F.struct("at", (-F.col("doc_id")).alias("id")))
    clusters = placed.groupBy("client_name", "block", "n").agg(newest.alias("first"))
    numbers = clusters.withColumn("cluster", F.row_number().over(Window.partitionBy("client_name").orderBy(F.desc("first"))) - 1)
    numbers = numbers.select(F.col("client_name").alias("c"), F.col("block").alias("b"), F.col("n").alias("m"), F.col("cluster").cast("int").alias("cluster"))
    return placed.join(numbers, F.col("client_name").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")) & (F.col("n") == F.col("m"))).select("client_name", "doc_id", "cluster")


def derived_name(client: Column) -> Column:
    """A project's name for a document: its own, its report type, or what is left of its title (or its file's name)."""
    title, stem = text_of("title"), text_of("document_stem")
    t = F.when((title == "") | plain_name(title).isin(*PLAIN_TITLES), stem).otherwise(title)
    t = F.regexp_replace(F.regexp_replace(t, r"[_\-]+", " "), r"(?i)\bv\d+\b", " ")
    t = F.when(client != "", F.regexp_replace(t, F.concat(F.lit(r"(?i)\Q"), client, F.lit(r"\E")), F.lit(" "))).otherwise(t)
    t = F.regexp_replace(F.regexp_replace(t, TITLE_NOISE, " "), r"\b\d{2,4}\b", " ")
    t = F.initcap(F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^[ \-]+|[ \-]+$", ""))
    return F.coalesce(F.nullif(text_of("project_name"), F.lit("")), F.nullif(text_of("report_type"), F.lit("")), F.nullif(t, F.lit("")), F.lit("Untitled Project"))


def fuzzy_groups(docs: DataFrame, stored: bool = False) -> DataFrame:
    """(client_name, doc_id, project_key): the group of every document, newest first.

    A document with a key goes to that key's group. One without goes to the first best group that scores 4 or more, else to the
    key made from its code or name. Scored are the group's code (6), its name (5), each shared reference (3), shared contacts (2),
    two or more shared tokens of title and file name (2), shared authors (1) and the year of the group's latest document (1).
    Columns: client_name, doc_id, ingested_at, project_key, project_name, project_code, report_type, title, document_stem,
    report_date and the lists related_references, contacts and authors. ``stored`` rows are read twice rather than written anew.
    """
    client = text_of("client_name")
    tokens = lambda *cs: F.array_distinct(F.concat(*[project_tokens(text_of(c)) for c in cs]))
    name = derived_name(client)
    made = slug(F.coalesce(F.nullif(text_of("project_code"), F.lit("")), name), "untitled-project")
    # A date of either kind, as text that sorts.
    day = F.coalesce(F.nullif(text_of("report_date"), F.lit("")), F.date_format("ingested_at", "yyyy-MM-dd"), text_of("ingested_at"))
    plain = docs.select(
        "client_name", "doc_id", "ingested_at", text_of("project_key").alias("key"), made.alias("made"), F.upper(text_of("project_code")).alias("code"), text_of("project_name").alias("own_name"), name.alias("name"), plain_name(name).alias("plain"),
        listed("related_references", F.upper).alias("refs"), listed("contacts", F.lower).alias("contacts"), listed("authors", F.lower).alias("authors"), tokens("title", "document_stem").alias("tokens"),
        F.array_except(tokens("project_name", "title", "document_stem"), project_tokens(client)).alias("hints"), day.alias("day"),
    )
    evidence = F.concat(tagged("k", F.array(F.when(F.col("key") != "", F.col("key")).otherwise(F.col("made")))), tagged("c", F.array("code")), tagged("n", F.array("plain")), tagged("r", F.col("refs")), tagged("p", F.col("contacts")), tagged("t", F.array_union("tokens", "hints")))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("ingested_at", "descending"), ("doc_id", "ascending")])
        own = [c for c in rows.column_names if c not in ("client_name", "doc_id", "ingested_at", "block")]
        groups: dict[str, dict] = {}
        by: dict[tuple, dict[str, None]] = defaultdict(dict)
        keys = []
        for row in map(namedtuple("Document", own)._make, zip(*(rows[c].to_pylist() for c in own), strict=True)):
            key = row.key or best_group(row, groups, by) or row.made
            g = groups.setdefault(key, {"n": len(groups), "code": "", "name": row.name, "plain": None, "refs": set(), "contacts": set(), "authors": set(), "hints": set(), "day": "", "year": ""})
            if row.own_name and g["name"].lower().startswith("untitled "):
                g["name"], g["plain"] = row.own_name, None
            g["code"] = g["code"] or row.code
            if row.day and row.day > g["day"]:
                g["day"], g["year"] = row.day, year_in(row.day)
            for field in ("refs", "contacts", "authors", "hints"):
                g[field].update(getattr(row, field))
            if g["plain"] is None:
                g["plain"] = " ".join(re.findall("[a-z0-9]+", g["name"].lower()))
            for item in (("code", g["code"]), ("name", g["plain"]), *(("refs", r) for r in row.refs), *(("contacts", c) for c in row.contacts), *(("hints", h) for h in row.hints)):
                by[item][key] = None
            keys.append(key)
        return rows.select(["client_name", "doc_id"]).append_column("project_key", pa.array(keys, pa.string()))

    return with_block(plain, evidence, stored).groupBy("client_name", "block").applyInArrow(run, "client_name string, doc_id long, project_key string")


def year_in(day: str | None) -> str:
    found = re.search(r"\b(20\d{2}|19\d{2})\b", day or "")
    return found.group() if found else ""


def best_group(row, groups: dict[str, dict], by: dict[tuple, dict[str, None]]) -> str | None:
    """The first best of the groups that share evidence with a document, if it scores 4."""
    items = (("code", row.code), ("name", row.plain), *(("refs", r) for r in row.refs), *(("contacts", c) for c in row.contacts), *(("hints", t) for t in row.tokens))
    near = {k for item in items if item[1] for k in by.get(item, ())}
    refs, contacts, authors, tokens, year = set(row.refs), set(row.contacts), set(row.authors), set(row.tokens), year_in(row.day)
    best, most = None, 3
    for key in sorted(near, key=lambda k: groups[k]["n"]):
        g = groups[key]
        score = 6 * (bool(row.code) and row.code == g["code"]) + 5 * (bool(row.plain) and row.plain == g["plain"]) + 3 * len(g["refs"] & refs)
        score += 2 * (not contacts.isdisjoint(g["contacts"])) + (not authors.isdisjoint(g["authors"])) + 2 * (len(g["hints"] & tokens) >= 2)
        score += bool(year and year == g["year"])
        if score > most:
            best, most = key, score
    return best


def grouped_rollup(docs: DataFrame) -> DataFrame:
    """The roll-up of all documents of a client: those without a key count in the group that they fit. ``docs``: stored rows, as they are read three times."""
    keys = fuzzy_groups(docs, stored=True).select(F.col("client_name").alias("__client"), F.col("doc_id").alias("__id"), F.col("project_key").alias("__key"))
    both = docs.join(keys, F.col("client_name").eqNullSafe(F.col("__client")) & (F.col("doc_id") == F.col("__id")))
    return project_rollup(both.withColumn("project_key", F.col("__key")).select(*docs.columns))
