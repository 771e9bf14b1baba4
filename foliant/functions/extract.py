"""Document classification and field extraction as column expressions.

Only the first 120,000 characters of a text are looked at, the first 8,000 for a client guess.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import all_dates, labelled_date, report_date
from .text import basename, clean_client, filled, forward, let, name_key, ordered_union, parent, section_lines, slug, stem, strip, title_case, year

REGEX_CHARS = 120_000
CLIENT_CHARS = 8_000

# Cues by kind, in the order that settles ties.
TEXT_CUES = {
    "quote": (r"\bquote\b", r"\bquotation\b", r"\bestimate\b"),
    "purchase_order": (r"\bpurchase\s+order\b", r"\bpo\s*#?\b"),
    "access_request": (r"\baccess\s+request\b", r"\bpermit\s+to\s+work\b"),
    "email_chain": (r"(?m)^\s*-?\s*from:", r"(?m)^\s*-?\s*to:", r"(?m)^\s*-?\s*subject:", r"(?m)^\s*-?\s*sent:", r"\bemail\s+chain\b", r"\bfrom:\s*\S+@\S+", r"\bsubject:\b"),
    "invoice": (r"\binvoice\b", r"\bamount\s+due\b"),
    "expense_report": (r"\bexpense\s+report\b", r"\bexpense\s+summary\b", r"\btravel\s+expense\b", r"\bcost\s+breakdown\b"),
    "timesheet": (r"\btimesheet\b", r"\bhours\s+worked\b"),
}
PATH_CUES = {
    "quote": ("quote", "quotation", "estimate"),
    "purchase_order": ("purchase_order", "purchase-order", "po_", "po-"),
    "access_request": ("access_request", "access-request", "permit"),
    "email_chain": ("email_chain", "email-chain", "email"),
    "invoice": ("invoice", "inv_"),
    "expense_report": ("expense", "cost", "budget"),
    "timesheet": ("timesheet",),
}
ACCESS_WORDS = ("approval", "worker", "visitor", "permit")
REPORT_CUES = ("report", "inspection", "findings?", "recommendations?", "summary")
CLIENT_CUES = ("client", "project", "site", "unit", "line", "asset", "quote", r"purchase\s+order", r"access\s+request", "cost", "expense", "shutdown", "outage")
AREAS = {
    "Piping": "pipe|piping|pipeline|weld",
    "Electrical": "electrical|switchboard|cable|transformer",
    "Mechanical": "pump|compressor|bearing|shaft|valve",
    "Civil": "concrete|foundation|structural|beam|column",
    "Operations": "operation|outage|shutdown|throughput",
}
FINDINGS, RECOMMENDATIONS = ("findings", "key findings"), ("recommendations", "actions")
# Words of a folder's name that belong to the project.
PROJECT_PATH_TOKENS = ("piping", "electrical", "mechanical", "civil", "structural", "condition", "survey", "integrity", "assessment", "reliability", "audit", "overhaul", "review")


# The patterns of the fields, in their order. They don't mind case; ``^`` and ``$`` are the ends of lines.
CLIENT_NAME = (r"^\s*client\s*name\s*[:\-]\s*(.+)$", r"^\s*client\s*[:\-]\s*(.+)$", r"^\s*for\s+client\s*[:\-]\s*(.+)$")
AUTHORS = (r"^\s*author\s*[:\-]\s*(.+)$", r"^\s*prepared\s+by\s*[:\-]\s*(.+)$")
CONTACTS = (r"^\s*contact\s*[:\-]\s*(.+)$", r"^\s*client\s+contact\s*[:\-]\s*(.+)$")
REPORT_TYPE = (r"^\s*report\s*type\s*[:\-]\s*(.+)$", r"^\s*document\s*type\s*[:\-]\s*(.+)$")
PROJECT_NAME = (r"^\s*project\s*(?:name)?\s*[:\-]\s*(.+)$", r"^\s*subject\s*[:\-].*?\b(project|outage|upgrade|review)\b[:\-\s]*(?:.+)$")
PROJECT_CODE = (r"^\s*project\s*code\s*[:\-]\s*([A-Z0-9\-/]+)$", r"\b(?:project\s*#|job\s*#|job\s*code|reference)\s*[:#\- ]\s*([A-Z]{2,}[A-Z0-9\-/]+)\b")
QUOTE_NUMBER = r"\b(?:quote|quotation|estimate)(?:\s+(?:number|no\.?))?\s*(?:[:#\-]|\b)\s*([A-Z0-9\-/]+)\b"
ORDER_NUMBER = r"\b(?:purchase\s*order|po)(?:\s+(?:number|no\.?))?\s*(?:[:#\-]|\b)\s*([A-Z0-9\-/]+)\b"
ACCESS_REFERENCE = r"\b(?:access\s*request|permit\s*reference|permit\s*to\s*work)(?:\s+(?:number|no\.?))?\s*(?:[:#\-]|\b)\s*([A-Z0-9\-/]+)\b"
OTHER_REFERENCE = r"\b(?:project\s*code|job\s*code|job\s*#|reference)\s*[:#\- ]\s*([A-Z]{2,}[A-Z0-9\-/]+)\b"
REFERENCES = (QUOTE_NUMBER, ORDER_NUMBER, ACCESS_REFERENCE, OTHER_REFERENCE)
_FLAGS = "(?imd)"
# A letter or digit at both ends, nothing between that cleaning takes away (but for two spaces). No group is repeated, so long lines don't run deep.
PLAIN_NAME = r"^[A-Za-z0-9][A-Za-z0-9 #.&'-]*+(?<=[A-Za-z0-9])\z"
# Words of which a match holds one, for patterns that don't begin with a word of their own.
WORDS = {
    PROJECT_CODE[1]: ("project", "job", "reference"),
    QUOTE_NUMBER: ("quot", "estimate"),
    ORDER_NUMBER: ("purchase", "po"),
    ACCESS_REFERENCE: ("access", "permit"),
    OTHER_REFERENCE: ("project", "job", "reference"),
    **{p: (re.search("[a-z]+:", re.sub(r"\\.", " ", p))[0],) for p in TEXT_CUES["email_chain"] if ":" in p},
}
# Fixed value: letters, the rarest last.
RARE = "etaoinsrlcdupmghybfvkwxjqz"


def may_match(low: Column, pattern: str) -> Column:
    """Whether a text in lower case holds a word without which the pattern can't match: a search for bytes, far cheaper than the pattern."""
    words = WORDS.get(pattern) or re.findall("[a-z]{2,}", re.sub(r"\\.|\(\?m\)|.\?", " ", pattern))[:1]
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(rare_part(w))) for w in words])


def rare_part(word: str) -> str:
    """The part of a word from its rarest letter among those that leave three characters: Spark's search stops to compare at every place that
    has the first one. A text without the part is without the word."""
    return word[max(range(max(len(word) - 2, 1)), key=lambda n: (RARE.find(word[n]), -n)) :]


def word_first(pattern: str) -> str:
    """A pattern of lower-case texts that begins at a word, with the word before the test for its beginning: Java then searches for the word
    instead of testing every place of the text."""
    found = re.match(r"\\b([a-z]+)", pattern)
    if not found:
        return pattern
    word, rest = found[1], pattern[found.end() :]
    if rest[:1] in ("?", "*", "{"):
        word, rest = word[:-1], word[-1] + rest
    return rf"{word}(?<=\b{word}){rest}"


def letter_first(pattern: str) -> str:
    """A pattern that begins with one of several words, with a look at the first letter before the test for a word's beginning."""
    found = re.match(r"\\b\(\?:([^()]*)\)", pattern)
    return rf"(?=[{''.join(sorted({w[0] for w in found[1].split('|')}))}]){pattern}" if found else pattern


def _hits(low: Column, patterns) -> Column:
    return reduce(lambda a, b: a + b, [(may_match(low, p) & low.rlike(word_first(p))).cast("double") for p in patterns])


def classify(text: Column, path: Column) -> Column:
    """Struct of kind, whether it concerns a client, confidence and a rationale.

    Each kind scores a point for every cue found, the path adds its share, the earliest kind wins
    ties, and another kind wins a tie with report.
    """
    return let(let(F.lower(F.substring(text, 1, REGEX_CHARS)), lambda low: F.struct(*_scores(low, F.lower(path)), *_client_scores(low))), decision)


def document_kind(low: Column, path: Column) -> Column:
    """The kind that ``classify`` gives, for a text's beginning in lower case."""
    return let(F.struct(*kind_scores(low, path)), lambda s: kind_of(s)[1])


def kind_scores(low: Column, path: Column) -> list[Column]:
    """What ``kind_of`` decides by: the best kind but report with its score, and the score of report."""
    return _scores(low, F.lower(path))


def _scores(low: Column, where: Column) -> list[Column]:
    scored = []
    for n, kind in enumerate(TEXT_CUES):
        named = F.when(reduce(lambda a, b: a | b, [where.contains(x) for x in PATH_CUES[kind]]), 0.75).otherwise(0.0)
        if kind == "email_chain":
            # Two marks of a mail count one more, three again 0.75.
            marked = let(_hits(low, TEXT_CUES[kind]), lambda m: m + F.when(m >= 2, 1.0).otherwise(0.0) + F.when(m >= 3, 0.75).otherwise(0.0))
            score = marked + named + F.when(where.contains("email_chain"), 2.0).otherwise(0.0)
        elif kind == "access_request":
            score = _hits(low, TEXT_CUES[kind]) + named + F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in ACCESS_WORDS]) & low.rlike(r"\b(?:approval|workers?|visitor|permit)\b"), 0.75).otherwise(0.0)
        else:
            score = _hits(low, TEXT_CUES[kind]) + named
        scored.append(F.struct(F.coalesce(score, F.lit(0.0)).alias("score"), F.lit(-n).alias("place"), F.lit(kind).alias("kind")))
    report = _hits(low, [rf"\b{c}\b" for c in REPORT_CUES])
    return [F.array_max(F.array(*scored)).alias("best"), report.alias("report")]


def _client_scores(low: Column) -> list[Column]:
    says = r"\bclient\s*(?:name)?\b"
    return [_hits(low, [rf"\b{c}\b" for c in CLIENT_CUES]).alias("client"), (may_match(low, says) & low.rlike(says)).alias("says_client")]


def kind_of(s: Column) -> tuple[Column, Column]:
    other, report = s["best"]["score"], s["report"]
    is_other = (other > 0) & (other >= report)
    return is_other, F.when(is_other, s["best"]["kind"]).when(report > 0, "report").otherwise("unknown")


def decision(s: Column) -> Column:
    other, report, client = s["best"]["score"], s["report"], s["client"]
    is_other, kind = kind_of(s)
    sure = F.when(is_other, F.least(F.lit(0.97), 0.42 + 0.13 * other)).when(report > 0, F.least(F.lit(0.95), 0.45 + 0.1 * report)).otherwise(0.4)
    why = F.when(is_other, F.concat(F.lit("Detected non-report cues for "), s["best"]["kind"], F.lit("."))).when(report > 0, "Detected report-like structure and terminology.").otherwise("Insufficient strong cues for document kind.")
    related = (client >= 2) | s["says_client"] | (kind.isin("report", "quote", "purchase_order", "access_request", "email_chain") & (client > 0))
    return F.struct(kind.alias("document_kind"), related.alias("is_client_related"), sure.alias("confidence"), why.alias("rationale"))


def _first(text: Column, low: Column, *patterns: str) -> Column:
    """Group 1 of the first pattern that matches; ``low`` is the text in lower case."""
    found = [F.when(may_match(low, p), filled(F.regexp_extract(text, _FLAGS + letter_first(p), 1))) for p in patterns]
    return filled(strip(F.coalesce(*found)))


def _found(text: Column, low: Column, *patterns: str) -> Column:
    """Group 1 of all that the patterns find, one pattern's after the other's."""
    none = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(F.when(may_match(low, p), F.regexp_extract_all(text, F.lit(_FLAGS + letter_first(p)), F.lit(1))), none) for p in patterns])


def _all(text: Column, low: Column, *patterns: str) -> Column:
    return ordered_union(_found(text, low, *patterns))


def client_name(text: Column, low: Column | None = None) -> Column:
    return filled(clean_client(_first(text, F.lower(text) if low is None else low, *CLIENT_NAME)))


def found_client(text: Column, low: Column) -> Column:
    """What the patterns of clients find first, as it stands in the text."""
    return F.coalesce(*[F.when(may_match(low, p), filled(F.regexp_extract(text, _FLAGS + letter_first(p), 1))) for p in CLIENT_NAME])


def client_of(found: Column) -> Column:
    """``client_name`` of what ``found_client`` gives. A name of plain words is clean already; one look at it saves seven patterns."""
    plain = found.rlike(PLAIN_NAME) & ~F.contains(found, F.lit("  "))
    return F.when(plain, found).otherwise(filled(clean_client(filled(strip(found)))))


def references(text: Column, low: Column | None = None) -> Column:
    """Quote, order, access and other numbers. The patterns don't mind case, so a plain word after
    a cue counts as one ("po box" gives "box")."""
    return _all(text, F.lower(text) if low is None else low, *REFERENCES)


def areas(text: Column) -> Column:
    found = F.filter(F.array(*[F.when(text.rlike(rf"(?i)\b(?:{words})\b"), F.lit(area)) for area, words in AREAS.items()]), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("General")))


def scoped_paths(found: Column, project: Column) -> Column:
    """Node paths ``project/area``; the general area is called Workscope under a project."""
    return F.transform(found, lambda a: F.when(project.isNull(), F.when(a == "General", a).otherwise(F.concat(F.lit("General/"), a))).otherwise(F.concat_ws("/", F.lit("Projects"), project, F.when(a == "General", "Workscope").otherwise(a))))


def extract(text: Column) -> Column:
    """Struct of the fields that patterns find in a text."""
    both = F.struct(F.substring(text, 1, REGEX_CHARS).alias("t"), F.lower(F.substring(text, 1, REGEX_CHARS)).alias("low"))
    return let(both, lambda b: F.struct(*[c.alias(n) for n, c in text_fields(b["t"], b["low"]).items()]))


def text_fields(t: Column, low: Column) -> dict[str, Column]:
    """The fields that patterns find in a text's beginning (``low``: in lower case), each a column of its own, so that Spark leaves out
    those that nobody reads."""
    dates = all_dates(t)
    return {
        "client_name": client_name(t, low),
        "authors": _all(t, low, *AUTHORS),
        "contacts": _all(t, low, *CONTACTS),
        "report_type": _first(t, low, *REPORT_TYPE),
        "report_date": report_date(t),
        "event_dates": F.slice(dates, 1, 10),
        "findings": section_lines(t, FINDINGS),
        "recommendations": section_lines(t, RECOMMENDATIONS),
        "areas": areas(t),
        "project_name": _first(t, low, *PROJECT_NAME),
        "project_code": _first(t, low, *PROJECT_CODE),
        "quote_number": _first(t, low, QUOTE_NUMBER),
        "purchase_order_number": _first(t, low, ORDER_NUMBER),
        "access_reference": _first(t, low, ACCESS_REFERENCE),
        "related_references": references(t, low),
    }


#: Fields of ``text_fields`` that are made of what patterns find, with the patterns.
LISTS = {"authors": AUTHORS, "contacts": CONTACTS, "related_references": REFERENCES}


def raw_finds(t: Column, low: Column) -> dict[str, Column]:
    """What the patterns of ``LISTS`` and the labels of dates find, as it stands in the text."""
    return {**{c: _found(t, low, *patterns) for c, patterns in LISTS.items()}, "report_date": labelled_date(t, low)}


def looks_like_document(client: Column, path: Column) -> Column:
    """Whether a client name is but the file's or its folder's name."""
    key = name_key(client)
    return (key == "") | (key == name_key(stem(path))) | (key == name_key(parent(path)))


def guess_client(text: Column, path: Column) -> Column:
    """A client from a label, from a line that speaks of a client, or from the line below one."""
    t = F.substring(text, 1, CLIENT_CHARS)
    lines = F.transform(F.slice(F.split(t, "\n"), 1, 60), strip)
    spoken = F.filter(F.transform(lines, lambda x: F.when(F.lower(x).contains("client") & x.rlike("[:|]"), clean_client(F.regexp_extract(x, r"[:|](.*)$", 1)))), lambda x: x.isNotNull() & (x != ""))
    below = F.filter(F.transform(lines, lambda x, i: F.when(F.lower(x).isin("client", "client name"), clean_client(F.try_element_at(lines, i + 2)))), lambda x: x.isNotNull() & (x != ""))
    every = F.concat(F.array(client_name(t)), spoken, below)
    return F.try_element_at(F.filter(every, lambda c: c.isNotNull() & (c != "") & ~looks_like_document(c, path)), F.lit(1))


def client_from_path(path: Column) -> Column:
    """From a folder ``report_..._<year>_<client>_<project words>``, the file's or the one above: the words between year and project."""
    at = F.split(forward(path), "/")

    def named(folder: Column) -> Column:
        words = F.filter(F.split(F.lower(folder), "_"), lambda w: w != "")
        since = F.array_position(F.transform(words, lambda w: w.rlike(r"^\d{4}$")), True)
        after = F.when(since > 0, F.slice(words, since.cast("int") + 1, F.greatest(F.size(words), F.lit(1))))
        stop = F.array_position(F.transform(after, lambda w: w.isin(*PROJECT_PATH_TOKENS)), True)
        own = F.when(stop > 0, F.slice(after, F.lit(1), stop.cast("int") - 1)).otherwise(after)
        own = F.filter(own, lambda w: ~w.isin("report", "v2"))
        return F.when(F.lower(folder).startswith("report_"), F.nullif(clean_client(title_case(F.array_join(own, " "))), F.lit("")))

    return F.coalesce(named(F.try_element_at(at, F.lit(-2))), named(F.try_element_at(at, F.lit(-3))))


def project_from_path(path: Column, client: Column, report_type: Column) -> Column:
    """A project's name from its file's: without "report", ``v<n>``, the client and numbers of two to four digits; if nothing is left the
    report's type, else the file's whole name."""
    spaced = F.replace(stem(path), F.lit("_"), F.lit(" "))
    name = F.regexp_replace(spaced, r"(?i)\breport\b|\bv\d+\b", "")
    own = F.replace(F.coalesce(client, F.lit("")), F.lit("_"), F.lit(" "))
    name = F.when(own != "", F.regexp_replace(name, F.concat(F.lit(r"(?i)\Q"), own, F.lit(r"\E")), F.lit(""))).otherwise(name)
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"\b\d{2,4}\b", " "), r"\s+", " "), r"^[ \-]+|[ \-]+$", "")
    return F.coalesce(F.nullif(title_case(name), F.lit("")), F.nullif(strip(report_type), F.lit("")), title_case(spaced))


def project_code_of(name: Column, client: Column, date: Column) -> Column:
    """Initials of the client's first three words, three letters of the name's first three, and the year."""
    words = lambda c: F.slice(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != ""), 1, 3)
    initials = F.upper(F.array_join(F.transform(words(client), lambda w: F.substring(w, 1, 1)), ""))
    shown = F.coalesce(F.nullif(name, F.lit("")), F.lit("General Project"))
    parts = F.concat(F.array(initials), F.transform(words(shown), lambda w: F.upper(F.substring(w, 1, 3))), F.array(F.substring(F.coalesce(date, F.lit("")), 1, 4)))
    code = F.nullif(F.array_join(F.filter(parts, lambda p: p != ""), "-"), F.lit(""))
    return F.when((F.coalesce(name, F.lit("")) != "") | (F.coalesce(client, F.lit("")) != ""), code)


def infer_project(fields: Column, path: Column) -> Column:
    """Struct of project name, code, references and key: what the text says, else what the path says."""
    name = F.coalesce(fields["project_name"], project_from_path(path, fields["client_name"], fields["report_type"]))
    refs = ordered_union(F.array(fields["quote_number"], fields["purchase_order_number"], fields["access_reference"]), fields["related_references"])

    def whole(name: Column) -> Column:
        code = F.coalesce(fields["project_code"], project_code_of(name, fields["client_name"], fields["report_date"]))
        return let(code, lambda code: F.struct(name.alias("project_name"), code.alias("project_code"), refs.alias("references"), slug(F.coalesce(F.nullif(code, F.lit("")), F.nullif(name, F.lit("")), stem(path))).alias("project_key")))

    return let(name, whole)


def filename_mismatch(path: Column, kind: Column) -> Column:
    """Whether a file is named for a kind that it wasn't given."""
    p = F.lower(basename(path))
    rules = (("quote", "quote"), ("purchase_order", "purchase_order"), ("email_chain", "email_chain"), ("access_request", "access_request"))
    return reduce(lambda a, b: a | b, [p.contains(word) & (kind != want) for word, want in rules])
