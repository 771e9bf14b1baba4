"""The index of derived texts: key fields and summaries of projects, kept searchable as vectors under paths of their own.

A project's fields and its summary are rendered as text, one row each, and stored beside the chunks of documents. After a
change only the rows whose text differs are embedded anew, so a run without changes computes no vector.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, strip
from .fields import ABSENT, section_breaks
from .retrieval import embedded

# Where derived texts lie, what they are called, and their lines.
FIELDS_AT, SUMMARY_AT = "__project_fields__/", "__project_summary__/"
FIELDS_KIND, SUMMARY_KIND = "project_fields", "project_summary"
FIELDS_SOURCE, SUMMARY_SOURCE = "lazy_llm_fields", "lazy_llm_summary"
NO_ANSWERS = "- none"

KEY = ("source_document", "client_name")
COLUMNS = (*KEY, "chunk_text", "project_key", "project_name", "document_kind", "source_type", "summary_method")


def said(c: Column, default: str) -> Column:
    """A value without blanks around it; null or empty: the default."""
    return strip(F.coalesce(F.nullif(c, F.lit("")), F.lit(default)))


def _headed(*rest: Column) -> Column:
    head = [F.concat(F.lit(label), F.coalesce(c, F.lit(""))) for label, c in (("Client: ", F.col("client_name")), ("Project: ", F.col("project_name")), ("Project key: ", F.col("project_key")))]
    return F.concat_ws("\n", *head, *rest)


def _rows(projects: DataFrame, at: str, text: Column, kind: str, source: str, method: Column) -> DataFrame:
    path = F.concat(F.lit(at), F.coalesce("client_name", F.lit("")), F.lit("/"), F.coalesce("project_key", F.lit("")))
    return projects.select(path.alias("source_document"), "client_name", text.alias("chunk_text"), "project_key", "project_name", F.lit(kind).alias("document_kind"), F.lit(source).alias("source_type"), method.alias("summary_method"))


def field_texts(projects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each project that has any field: every defined field in the order of ``keys`` (the definition file's), absent ones said to be so.

    ``projects``: client_name, project_key, project_name and ``fields``, a map from key to a struct of value, status and method. Fields that are not
    defined are left out.
    """

    def line(key: str) -> Column:
        f = F.try_element_at("fields", F.lit(key))
        value = F.coalesce(F.nullif(said(f["value"], ABSENT), F.lit("")), F.lit(ABSENT))
        return F.concat(F.lit(f"- {key}: "), value, F.lit(" (status="), said(f["status"], "unknown"), F.lit(", method="), said(f["method"], "unknown"), F.lit(")"))

    return _rows(projects.where("size(fields) > 0"), FIELDS_AT, _headed(F.lit("Key fields:"), *map(line, keys)), FIELDS_KIND, FIELDS_SOURCE, F.lit(None).cast("string"))


def summary_texts(projects: DataFrame) -> DataFrame:
    """A row for each project with a summary that isn't blank, the questionnaire's answers after it by key.

    ``projects``: client_name, project_key, project_name, ``summary``, ``summary_method`` and ``answers`` (a map of texts or null; blank answers are left out).
    """
    told = F.filter(F.transform(F.array_sort(F.map_entries("answers")), lambda e: F.struct(e["key"].alias("key"), strip(e["value"]).alias("value"))), lambda e: e["value"] != "")
    lines = let(F.array_join(F.transform(told, lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"])), "\n"), lambda t: F.coalesce(F.nullif(t, F.lit("")), F.lit(NO_ANSWERS)))
    broken = projects.withColumn("summary", section_breaks(F.col("summary"))).where("summary != ''")
    text = _headed(F.concat(F.lit("Summary method: "), F.coalesce("summary_method", F.lit(""))), F.lit("Summary:"), F.col("summary"), F.lit("Questionnaire:"), lines)
    return _rows(broken, SUMMARY_AT, text, SUMMARY_KIND, SUMMARY_SOURCE, F.col("summary_method"))


def is_derived(path: Column) -> Column:
    return F.startswith(path, F.lit(FIELDS_AT)) | F.startswith(path, F.lit(SUMMARY_AT))


def refreshed(vectors: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The vectors after the derived ``texts`` were stored, and what that changed: (source_document, client_name, state, chunk_text), state ``added`` or ``changed``.

    A text replaces all rows of its path and client (a null client is the empty one). Where exactly one row is stored and its text is the same,
    it stays as it is. Of several texts of a path and client the greatest counts. Derived rows without a text stay, and so do the
    vectors of documents, which take part in no join. Vectors of ``vectors`` have ``COLUMNS`` and ``embedding``; more columns are null in new rows. Without
    ``embedding`` the index holds texts whose vectors are drawn where they are read (``embedded``), and new ones get none here.
    """
    client = F.coalesce("client_name", F.lit("")).alias("__client")
    wanted = texts.groupBy("source_document", client).agg(F.max(F.struct("chunk_text", *[c for c in COLUMNS if c not in ("source_document", "chunk_text")])).alias("__t"))
    ours = is_derived(F.col("source_document"))
    stored = vectors.where(ours)
    held = stored.groupBy("source_document", client).agg(F.count(F.lit(1)).alias("__n"), F.max("chunk_text").alias("__before"))
    news = wanted.join(held, ["source_document", "__client"], "left").where(~((F.col("__n") == 1) & F.col("__before").eqNullSafe(F.col("__t.chunk_text"))) | F.col("__n").isNull())
    changed = news.select("source_document", "__client", F.when(F.col("__n").isNull(), "added").otherwise("changed").alias("state"), "__t.*")
    same = (stored["source_document"] == F.col("__path")) & (F.coalesce(stored["client_name"], F.lit("")) == F.col("__client"))
    kept = stored.join(changed.select(F.col("source_document").alias("__path"), "__client"), same, "left_anti")
    new = changed.select(*COLUMNS)
    if "embedding" in vectors.columns:
        new = embedded(new)
    rest = vectors.where(~ours | F.col("source_document").isNull())
    return rest.unionByName(kept).unionByName(new, allowMissingColumns=True), changed.select(*KEY, "state", "chunk_text")
