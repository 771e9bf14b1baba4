"""Project fields: what is asked for, where it is looked for, how hits and local evidence are scored, and what may stay.

The language model that fills a field is not part of this; everything around it is deterministic.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import moment
from ..functions.text import basename, collapse, first_words, let, ordered_union, strip
from .documents import greedy_budget, metadata_matches

# Terms, kinds, budgets and cues by field.
TERMS = {
    "title": ("title", "project", "assessment", "audit", "review"),
    "scope": ("scope", "work", "assessment", "audit", "review", "inspection"),
    "participants": ("participant", "contact", "author", "stakeholder", "team"),
    "date": ("date", "submitted", "issued", "report", "timeline", "milestone", "inspection", "approval"),
    "quoted": ("quote", "$", "price", "cost", "estimate"),
    "invoice": ("invoice", "$", "amount", "billing", "payment"),
    "findings": ("finding", "issue", "risk", "observation", "defect"),
    "recommendations": ("recommend", "action", "should", "mitigation", "next"),
    "gaps": ("missing", "unknown", "gap", "uncertain", "not provided"),
}
KINDS = {"date": ["report", "email"], "quoted": ["quote", "proposal", "email", "report"], "invoice": ["invoice", "email", "report"]}
BUDGETS = {"title": (900, 360), "scope": (1200, 420), "participants": (1100, 420), "date": (1000, 380), "quoted": (900, 340), "invoice": (900, 340), "findings": (1400, 520), "recommendations": (1400, 520), "gaps": (1200, 460)}
SNIPPET_CUES = ("finding", "issue", "risk", "defect", "recommend", "action", "should", "repair", "replace", "monitor", "mitigate", "compliance")
RECOMMENDATION_CUES = ("recommend", "should", "action", "mitigate", "repair", "replace", "monitor", "follow-up", "implement")
FINDING_CUES = ("finding", "issue", "risk", "defect", "non-compliance", "observed", "condition", "failure", "gap")
COMMERCIAL_CUES = ("quote", "quoted", "invoice", "price", "cost", "purchase order", "po", "billing")
TECHNICAL_CUES = ("recommend", "issue", "risk", "defect", "repair", "replace", "monitor", "compliance")
STATEMENT_CUES = {"findings": ("finding", "issue", "observation", "risk"), "recommendations": ("recommend", "action", "next step", "mitigation", "should", "priority", "required")}
ABSENT = "Information not present"


def terms_of(field: str) -> tuple[str, ...]:
    return TERMS.get(field, (field.lower(),))


def metadata_filters(field: str) -> dict[str, object]:
    """What a field's search is narrowed to, in the metadata filter language."""
    return {"is_client_related": True} | ({"document_kind": KINDS[field]} if field in KINDS else {})


def has_any(low: Column, cues: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(c)) for c in cues])


def n_of(low: Column, cues: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(low, F.lit(c)).cast("int") for c in cues])


def focus(text: str | None, terms: tuple[str, ...], most: int = 160) -> str:
    """The part of a text around the mention of a term with the most cues near it, cut at spaces."""
    flat = " ".join((text or "").split())
    low = flat.lower()
    places = [m.start() for term in terms for m in re.finditer(re.escape(term), low)]
    if not places:
        return flat[:most]

    def cues(at: int) -> int:
        begin = max(0, at - 60)
        return sum(c in low[begin : begin + most] for c in SNIPPET_CUES)

    begin = max(0, max(places, key=cues) - 40)
    if begin and (space := flat.rfind(" ", 0, begin)) > 0:
        begin = space + 1
    end = min(len(flat), begin + most)
    if end < len(flat) and (space := flat.find(" ", end)) > 0:
        end = space
    return flat[begin:end].strip()


def focus_snippet(text: Column, terms: tuple[str, ...], most: int = 160) -> Column:
    """``focus`` in Arrow batches."""

    @F.udf("string", useArrow=True)
    def cut(t):
        return focus(t, terms, most)

    return cut(text)


def query_text(project_name: Column, field: str, prompt: str, docs: Column) -> Column:
    """Ordered distinct words about a field: project, key, prompt, terms, and title, type and code of the first four
    documents (an array of structs)."""
    of_docs = F.flatten(F.transform(F.slice(docs, 1, 4), lambda x: F.array(x["title"], x["report_type"], x["project_code"])))
    return F.array_join(ordered_union(F.array(project_name, F.lit(field), F.lit(prompt), F.lit(" ".join(terms_of(field)))), of_docs), " ")


def project_hints(docs: DataFrame) -> DataFrame:
    """Per project its sources, references and years, and its first code."""
    order = F.struct("ingested_at", "doc_id")
    code = F.nullif(F.trim("project_code"), F.lit(""))
    years = F.array(*[F.nullif(F.regexp_extract(F.col(c).cast("string"), r"\b(19\d{2}|20\d{2})\b", 1), F.lit("")) for c in ("report_date", "ingested_at")])
    return docs.groupBy("client_name", "project_key").agg(
        F.min_by(code, F.when(code.isNotNull(), order)).alias("project_code"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("related_references", F.array().cast("array<string>")))))).alias("references"),
        F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_set(years))))).alias("years"),
        F.array_sort(F.collect_set(F.nullif(F.trim("source_path"), F.lit("")))).alias("sources"),
    )


def widened(own: DataFrame, others: DataFrame, key: str = "query_id", least: int = 3) -> DataFrame:
    """Hits within the project, and where they are fewer than ``least``, those of sources not seen yet."""
    thin = own.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).select(key)
    fresh = others.join(thin, key, "left_anti").join(own.select(key, "source_document").distinct(), [key, "source_document"], "left_anti")
    first = Window.partitionBy(key, "source_document").orderBy(F.desc("score"), "chunk_text")
    fresh = fresh.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return own.unionByName(fresh.select(*own.columns))


def rescored(hits: DataFrame, field: str, key: str = "query_id", most: int = 3) -> DataFrame:
    """Hits of a field search with what speaks for them added to their score; the best of each source, three at most.

    ``hits``: key, score, source_document, chunk_text, the metadata columns project_key, project_code,
    related_references and report_date, and the hints hint_key, hint_code, hint_references and hint_years of the
    query. A hit without any of the field's terms goes; its date's place between the oldest and the newest
    counts up to 0.05, for late or for early ones by the field.
    """
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    lower_set = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    n = n_of(F.lower("chunk_text"), terms_of(field))
    at = F.unix_micros(moment(F.col("report_date"))) / 1e6
    w = Window.partitionBy(key)
    position = (F.col("__at") - F.min("__at").over(w)) / F.greatest(F.lit(1.0), F.max("__at").over(w) - F.min("__at").over(w))
    temporal = F.lit(0.0)
    if field in ("date", "quoted", "invoice", "participants"):
        temporal = F.coalesce(0.05 * position, F.lit(0.0))
    elif field in ("title", "scope"):
        temporal = F.coalesce(0.05 * (1 - position), F.lit(0.0))
    same = lambda a, b, x: F.when((low(b) != "") & (low(a) == low(b)), x).otherwise(0.0)
    bonus = 0.04 * F.col("__n") + same("project_key", "hint_key", 0.12) + same("project_code", "hint_code", 0.08)
    bonus += F.when(F.arrays_overlap(F.array_remove(lower_set("related_references"), ""), lower_set("hint_references")), 0.08).otherwise(0.0)
    if field == "date":
        bonus += F.when(F.exists("hint_years", lambda y: F.contains(F.coalesce(F.col("report_date"), F.lit("")), y)), 0.05).otherwise(0.0)
    scored = hits.withColumn("__n", n).withColumn("__at", at).withColumn("__t", temporal).where("__n > 0").withColumn("score", F.col("score") + bonus + F.col("__t"))
    one = Window.partitionBy(key, "source_document").orderBy(F.desc("score"), "chunk_text")
    best = Window.partitionBy(key).orderBy(F.desc("score"), "source_document", "chunk_text")
    first = scored.withColumn("__r", F.row_number().over(one)).where("__r = 1")
    return first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).drop("__n", "__at", "__t", "__r")


def context_lines(hits: DataFrame, field: str, key: str = "query_id") -> DataFrame:
    """(key, context): a line for each of the three best hits, with client, file and the part in question."""
    line = F.concat(F.lit("- ["), F.coalesce("client_name", F.lit("unknown")), F.lit("|"), basename(F.col("source_document")), F.lit("] "), F.col("__focus"))
    some = hits.where("rank <= 3").withColumn("__focus", focus_snippet(F.col("chunk_text"), terms_of(field), 180)).where("__focus != ''")
    return some.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("context"))


#: Sources that a summary's context shows, characters of each, and of all together.
MOST_SOURCES, SHOWN, CONTEXT = 12, 420, 2200


def summary_query_text(project_name: Column, docs: Column) -> Column:
    """Ordered distinct words about a project: its name, and type, title, file name, code and five references of each of the first ten
    documents (an array of structs)."""
    none = F.array().cast("array<string>")
    of_docs = F.flatten(F.transform(F.slice(docs, 1, 10), lambda x: F.concat(F.array(x["report_type"], x["title"], x["document_name"], x["project_code"]), F.slice(F.coalesce(x["related_references"], none), 1, 5))))
    return F.array_join(F.array_distinct(F.concat(F.array(F.coalesce(project_name, F.lit(""))), ordered_union(of_docs))), " ")


def summary_context(hits: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, context): client, file and beginning of the best hit of each source, the best twelve sources at most and none from the first
    that would overrun the budget. ``hits``: key, rank, client_name, source_document, chunk_text."""
    best = hits.where("source_document != ''").groupBy(key, "source_document").agg(F.min_by(F.struct("rank", "client_name", F.substring("chunk_text", 1, SHOWN).alias("shown")), "rank").alias("h"))
    some = best.withColumn("__place", F.row_number().over(Window.partitionBy(key).orderBy("h.rank", "source_document"))).where(F.col("__place") <= MOST_SOURCES)
    client = F.coalesce(F.nullif("h.client_name", F.lit("")), F.lit("unknown client"))
    told = F.concat(F.lit("["), client, F.lit(" | "), basename(F.col("source_document")), F.lit("]\n"), F.coalesce("h.shown", F.lit("")))
    some = greedy_budget(some.withColumn("__told", told), [key], [F.col("__place")], F.length("__told"), CONTEXT)
    return some.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__place", "__told"))), lambda x: x["__told"]), "\n\n").alias("context"))


def local_evidence(docs: DataFrame, field: str, most: int = 4) -> DataFrame:
    """Evidence lines of a project's first six documents (``position`` from 1) for a field, the best four.

    A term found in title or excerpt counts 1; amounts (for money fields) and people (for participants)
    count 2; findings and recommendations without a cue, or in text that is only commercial, lose 2 each.
    """
    none = F.array().cast("array<string>")
    few = lambda c, n: F.array_join(F.slice(F.coalesce(F.col(c), none), 1, n), ",")
    title = strip(F.coalesce(F.nullif("title", F.lit("")), F.col("document_name"), F.lit("")))
    d = docs.where("position <= 6").withColumn("__title", title).withColumn("__excerpt", F.coalesce("excerpt", F.lit("")))
    d = d.withColumn("__low", F.lower(F.concat_ws(" ", "__title", "__excerpt"))).withColumn("__snippet", focus_snippet(F.col("__excerpt"), terms_of(field), 150))
    score, lead = n_of(F.col("__low"), terms_of(field)), F.lit("")
    if field in ("findings", "recommendations"):
        cues = FINDING_CUES if field == "findings" else RECOMMENDATION_CUES
        commercial = has_any(F.col("__low"), COMMERCIAL_CUES) & ~has_any(F.col("__low"), TECHNICAL_CUES)
        score = score - F.when(has_any(F.col("__low"), cues), 0).otherwise(2) - F.when(commercial, 2).otherwise(0)
    if field in ("quoted", "invoice"):
        there = F.size(F.coalesce("currency_amounts", none)) > 0
        score, lead = score + F.when(there, 2).otherwise(0), F.when(there, F.concat(F.lit("amounts: "), few("currency_amounts", 2), F.lit("; "))).otherwise("")
    if field == "participants":
        people = F.when(F.size(F.coalesce("contacts", none)) > 0, few("contacts", 4)).otherwise(few("authors", 4))
        score, lead = score + F.when(people != "", 2).otherwise(0), F.when(people != "", F.concat(F.lit("people: "), people, F.lit("; "))).otherwise("")
    said = F.regexp_replace(F.concat(lead, F.col("__snippet")), "^[; ]+|[; ]+$", "")
    date = F.coalesce(F.nullif("report_date", F.lit("")), F.col("ingested_at").cast("string"), F.lit(""))
    head = F.concat(F.lit("- ["), F.concat_ws(" ", F.coalesce("document_kind", F.lit("")), date, "__title"), F.lit("] refs:"), few("related_references", 3))
    rows = d.select("client_name", "project_key", score.alias("match_score"), strip(F.concat(head, F.lit(" "), said)).alias("evidence")).where("match_score > 0")
    w = Window.partitionBy("client_name", "project_key").orderBy(F.desc("match_score"), "evidence")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def looks_absent(answer: Column) -> Column:
    low = F.lower(strip(F.coalesce(answer, F.lit(""))))
    return (low == "") | F.contains(low, F.lit("insufficient evidence")) | F.contains(low, F.lit("not present")) | F.contains(low, F.lit("not enough information")) | (low == "unknown")


def answer_record(is_present: Column, answer: Column, evidence: Column) -> Column:
    """Struct of status and normalised answer: absent or rejected, without enough evidence, or accepted."""
    said, shown = strip(F.coalesce(answer, F.lit(""))), strip(F.coalesce(evidence, F.lit("")))
    status = F.when(~F.coalesce(is_present, F.lit(False)) | looks_absent(said), "absent_or_rejected").when(F.length(shown) < 8, "insufficient_evidence").otherwise("accepted")
    return let(status, lambda s: F.struct(s.alias("status"), F.when(s == "accepted", said).otherwise(F.lit(ABSENT)).alias("answer")))


def question_batches(questions: DataFrame, size: int = 3) -> DataFrame:
    """Questions (position from 0, key, question) in batches."""
    return questions.withColumn("batch", F.floor(F.col("position") / size).cast("int"))


def batch_answers(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """Every question with its answer; a question that its batch left out is absent."""
    joined = questions.join(answers.withColumn("__there", F.lit(True)), "key", "left")
    record = answer_record(F.col("is_present"), F.col("answer"), F.col("evidence"))
    missing = F.struct(F.lit("missing_in_batch").alias("status"), F.lit(ABSENT).alias("answer"))
    return joined.withColumn("record", F.when(F.col("__there"), record).otherwise(missing)).select("key", "position", "record.status", F.col("record.answer").alias("normalized_answer"))


#: Order in which other fields are told to the one that is asked for (fixed values).
TOLD_FIRST = ("title", "scope", "date", "quoted", "invoice", "participants", "findings", "recommendations", "gaps")


def known_fields(fields: Column, current: str, most: int = 3) -> Column:
    """Up to three other fields, ten words each: those of ``TOLD_FIRST`` that are there in its order, then others in the map's order;
    "none" without any."""
    first = F.array_compact(F.array(*[F.when(F.map_contains_key(fields, F.lit(k)), F.lit(k)) for k in TOLD_FIRST if k != current]))
    others = F.filter(F.map_keys(fields), lambda k: ~k.isin(*TOLD_FIRST, current))
    told = F.transform(F.slice(F.concat(first, others), 1, most), lambda k: F.concat(k, F.lit("="), first_words(F.coalesce(F.try_element_at(fields, k), F.lit("")), 10)))
    return F.coalesce(F.nullif(F.array_join(told, "; "), F.lit("")), F.lit("none"))


#: The labels that a summary must hold with the answers that fill them (the title takes the project's name), what
#: an empty summary and a nameless project are called, and the labels that begin a line.
COVERED = (("Title", None), ("Scope", "scope"), ("Participants", "participants"), ("Timeline", "timeline"), ("Quoted / Commercial", "commercial"), ("Invoice status", "commercial"), ("Findings", "risks_actions"), ("Recommendations", "risks_actions"), ("Gaps", "missing_info"))
NO_SUMMARY, NO_PROJECT = "Project summary unavailable.", "Untitled project"
LINE_LABELS = (*(label for label, _ in COVERED), "Commercial")


def covered(summary: Column, project: Column, answers: Column) -> Column:
    """A summary with a line for each label that it lacks; blank and absent answers are told as absent, values are cut to 180 characters."""

    def completed(text: Column) -> Column:
        lines = []
        for label, key in COVERED:
            given = project if key is None else F.try_element_at(answers, F.lit(key))
            said = F.nullif(strip(given), F.lit(""))
            value = F.coalesce(said, F.lit(NO_PROJECT)) if key is None else F.when(said.isNull() | looks_absent(said), ABSENT).otherwise(said)
            flat = collapse(value)
            short = F.when(F.length(flat) > 180, F.concat(F.rtrim(F.substring(flat, 1, 177)), F.lit("..."))).otherwise(flat)
            lines.append(F.when(~F.contains(F.lower(text), F.lit(f"{label.lower()}:")), F.concat(F.lit(f"{label}: "), short)))
        return F.concat_ws("\n", text, *lines)

    start = F.coalesce(F.nullif(strip(summary), F.lit("")), F.lit(NO_SUMMARY))
    return section_breaks(let(section_breaks(start), completed))


def section_breaks(text: Column, labels: tuple[str, ...] = LINE_LABELS) -> Column:
    """Blanks collapsed, then each label in turn, however it is spelt, begins a line. A label within another one ("Commercial") cuts it."""
    out = collapse(F.coalesce(text, F.lit("")))
    for label in labels:
        out = F.regexp_replace(out, rf"(?i)\s*{re.escape(label)}:", f"\n{label}: ")
    return strip(F.regexp_replace(out, r"\n{2,}", "\n"))


def statements(text: Column, cues: tuple[str, ...]) -> Column:
    """The first two sentences of 24 characters or more with a cue, each once, 220 characters at most."""
    low = "|".join(map(re.escape, cues))
    sentences = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])(?U)\s+"), strip)
    return F.slice(F.array_distinct(F.transform(F.filter(sentences, lambda s: (F.length(s) >= 24) & F.lower(s).rlike(low)), lambda s: F.substring(s, 1, 220))), 1, 2)


def rule_summary(docs: DataFrame) -> DataFrame:
    """(client_name, project_key, summary): what a project's documents say, without a model.

    Lists keep the order of the documents (ingested_at, doc_id). Only the first few items of each are
    shown, but all documents are counted and dated.
    """
    order = F.struct("ingested_at", "doc_id")
    none = F.array().cast("array<string>")
    d = docs.withColumn("__f", statements(F.col("excerpt"), STATEMENT_CUES["findings"])).withColumn("__r", statements(F.col("excerpt"), STATEMENT_CUES["recommendations"]))
    # Only a value's first document counts, so what is gathered is the distinct values, not the rows.
    lists = {"refs": "related_references", "contacts": "contacts", "authors": "authors", "amounts": "currency_amounts", "findings": "__f", "advice": "__r"}
    singles = {"kinds": F.coalesce(F.nullif("document_kind", F.lit("")), F.lit("unknown")), "types": F.nullif(F.trim("report_type"), F.lit(""))}
    named = lambda n: lambda x, i: F.struct(F.lit(n).alias("list"), i.alias("place"), x.alias("item"))
    every = F.concat(*[F.transform(F.coalesce(c, none), named(n)) for n, c in lists.items()], *[F.transform(F.array(c), named(n)) for n, c in singles.items()])
    items = d.select("client_name", "project_key", order.alias("at"), F.explode(every).alias("x")).select("client_name", "project_key", "at", "x.*")
    first = items.where("item is not null").groupBy("client_name", "project_key", "list", "item").agg(F.min(F.struct("at", "place")).alias("at"))
    w = Window.partitionBy("client_name", "project_key", "list").orderBy("at")
    shown = first.withColumn("n", F.row_number().over(w)).where("n <= 4")
    gathered = shown.groupBy("client_name", "project_key").pivot("list", [*lists, *singles]).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "item"))), lambda x: x["item"]))
    date = F.nullif(F.trim("report_date"), F.lit(""))
    name = F.nullif(F.trim("project_name"), F.lit(""))
    facts = d.groupBy("client_name", "project_key").agg(
        F.min_by(name, F.when(name.isNotNull(), order)).alias("name"),
        F.count(F.lit(1)).alias("n_docs"),
        F.coalesce(F.min(date), F.lit("undated")).alias("earliest"),
        F.coalesce(F.max(date), F.lit("undated")).alias("latest"),
        F.max(F.col("document_kind").isin("quote", "purchase_order", "access_request", "email_chain")).alias("logistics"),
        F.max(F.col("document_kind") == "invoice").alias("invoiced"),
    )
    j = facts.join(gathered, ["client_name", "project_key"], "left")
    some = lambda c, n, sep, other: F.when(F.size(F.coalesce(F.col(c), none)) > 0, F.array_join(F.slice(F.col(c), 1, n), sep)).otherwise(other)
    people = F.when(F.size(F.coalesce("contacts", none)) > 0, F.array_join(F.slice("contacts", 1, 4), ", ")).otherwise(some("authors", 4, ", ", "project stakeholders are not named in metadata"))
    bits = F.concat_ws(", ", F.when(F.col("logistics"), "logistics and access coordination are documented"), F.when(F.col("invoiced"), "invoice records are present"), F.when(F.size(F.coalesce("amounts", none)) > 0, F.concat(F.lit("noted commercial values include "), F.array_join(F.slice("amounts", 1, 3), ", "))))
    text = F.concat(
        F.coalesce("name", "project_key"), F.lit(" covers "), some("types", 3, ", ", some("kinds", 3, ", ", "unknown")), F.lit(" work for "), F.col("client_name"), F.lit(" across "), F.col("n_docs").cast("string"),
        F.lit(" related documents dated between "), F.col("earliest"), F.lit(" and "), F.col("latest"), F.lit(". Key participants include "), people,
        F.lit(", and the document set links the work through references such as "), some("refs", 4, ", ", "no commercial references yet"),
        F.lit(". Recommendations: "), some("advice", 2, "; ", "Recommendations are not explicitly captured in the available metadata."),
        F.lit(" Issues and key findings: "), some("findings", 2, "; ", "No explicit issues or findings were extracted from the available documents."),
        F.lit(" The available records indicate that "), F.coalesce(F.nullif(bits, F.lit("")), F.lit("commercial status is only partially evidenced in the stored documents")),
        F.lit(". Conclusions should be based on the documented findings and recommended actions above."),
    )
    return j.select("client_name", "project_key", text.alias("summary"))


def json_from_prose(raw: Column) -> Column:
    """The JSON object text within an answer: the whole of it, or from its first to its last brace; null without one."""
    text = strip(F.coalesce(raw, F.lit("")))
    inner = F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull() & F.substring(F.ltrim(c), 1, 1).eqNullSafe("{"), c)
    return F.coalesce(valid(text), valid(inner))


def extraction_merged(model: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """A model's extraction with its empty fields filled from the patterns' one; both have the same columns."""
    other = found.select(key, *[F.col(c).alias(f"__{c}") for c in found.columns if c != key])
    kinds = dict(model.dtypes)

    def pick(c: str) -> Column:
        if kinds[c].startswith("array"):
            return F.when(F.size(F.coalesce(F.col(c), F.array().cast(kinds[c]))) > 0, F.col(c)).otherwise(F.col(f"__{c}"))
        return F.coalesce(F.nullif(F.col(c), F.lit("").cast(kinds[c])) if kinds[c] == "string" else F.col(c), F.col(f"__{c}"))

    return model.join(other, key, "left").select(key, *[pick(c).alias(c) for c in model.columns if c != key])


def vector_rows(vectors: DataFrame, client: str | None = None, sources: list[str] | None = None, filters: dict[str, object] | None = None) -> DataFrame:
    """The rows a search runs over: a client's own (case put aside), of some documents (blanks name none), of some metadata."""
    out = vectors if not client else vectors.where(F.lower(F.coalesce("client_name", F.lit(""))) == client.lower())
    wanted = [s.strip() for s in sources or [] if s and s.strip()]
    if wanted:
        out = out.where(F.col("source_document").isin(*wanted))
    if filters:
        out = out.where(metadata_matches(filters, dict(out.dtypes)))
    return out


def vector_scan(vectors: DataFrame, client: str | None = None, sources: list[str] | None = None, filters: dict[str, object] | None = None) -> DataFrame:
    """``vector_rows`` by document and text."""
    return vector_rows(vectors, client, sources, filters).orderBy("source_document", "chunk_text")
