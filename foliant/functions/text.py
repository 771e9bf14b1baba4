"""String expressions: normal forms, paths, titles, tokens, sections, set-like array operations.

All take and return columns and stay inside Catalyst.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the retrieval tokenizer leaves out (fixed values).
RETRIEVAL_STOPWORDS = "the and for with from this that what when where which about project client field".split()
#: Words that say nothing about a project (fixed values).
PROJECT_STOPWORDS = "client doc document engineering estimate for inspection order project purchase quote quotation report request rev revision site summary the variation work".split()
_SPACE = r"(?U)\s+"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: a lambda's variable is bound, not copied."""
    return F.transform(F.array(value), body)[0]


def once(c: Column) -> Column:
    """``c``, evaluated where it stands. Spark copies a column's expression into every filter on it and moves that down into scans and joins, where
    each copy runs the patterns again; it leaves a column alone that may depend on the row's place. This one only seems to.

    The lambda keeps the projection out of whole-stage code: there all expressions of a row are one method, and Java interprets methods beyond
    8,000 bytes for ever. On its own a projection is cut into methods that Java compiles."""
    return F.coalesce(c, F.when(F.exists(F.array(F.monotonically_increasing_id()), lambda i: i < 0), F.lit(None)))


def by_itself(c: Column) -> Column:
    """``once`` for an expression that is never null, which Spark would take out of a ``coalesce``."""
    return F.when(F.exists(F.array(F.monotonically_increasing_id()), lambda i: i >= 0), c)


def filled(c: Column) -> Column:
    """``c``, or null for the empty text. ``nullif`` names ``c`` twice, and within a condition Spark computes it twice."""
    return F.get(F.array_remove(F.array(c), F.lit("")), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends (``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, _SPACE, " "))


def newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def content_hash(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


# Paths


def forward(path: Column) -> Column:
    """One spelling for both kinds of slash."""
    return F.regexp_replace(F.trim(path), r"\\", "/")


def basename(path: Column) -> Column:
    return F.regexp_extract(forward(path), r"([^/]*)/*$", 1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"[^.](\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    """The base name without its last extension; a leading dot begins no extension."""
    return F.regexp_replace(basename(path), r"(?<=[^.])\.[^.]*$", "")


def parent(path: Column) -> Column:
    return F.regexp_extract(forward(path), r"([^/]*)/[^/]*$", 1)


# Names


def name_key(c: Column) -> Column:
    """Letters and digits of the lower-cased last path part without extension."""
    return F.regexp_replace(F.lower(stem(strip(c))), r"[^\p{L}\p{N}]", "")


def slug(c: Column, default: str = "general-project") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def plain_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def clean_client(c: Column) -> Column:
    """Without list marks, emphasis marks and trailing punctuation."""
    s = F.regexp_replace(c, r"(?U)^[-*#\s`_]+|[-*`_\s]+$", "")
    s = F.regexp_replace(s, r"\*\*|__", "")
    return F.regexp_replace(collapse(s), r"^[ :;,.\t]+|[ :;,.\t]+$", "")


def title_case(c: Column) -> Column:
    """A capital after everything that is no letter; ``initcap`` looks for spaces only."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(collapse(c), " "), 1, n), " ")


def guess_title(text: Column, path: Column) -> Column:
    """The first of twenty lines with more than eight characters, else the file's stem in words."""
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 20), strip)
    first = strip(F.substring_index(text, "\n", 1))
    # Mostly the first line is one; only the other texts are split.
    hit = F.when(F.length(first) > 8, first).otherwise(F.try_element_at(F.filter(lines, lambda x: F.length(x) > 8), F.lit(1)))
    return F.coalesce(F.substring(hit, 1, 200), F.regexp_replace(stem(path), "_", " "))


def url_quote(c: Column) -> Column:
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def document_link(path: Column) -> Column:
    return F.concat(F.lit("/document?path="), url_quote(path))


# Tokens


def retrieval_tokens(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{2,}"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*RETRIEVAL_STOPWORDS))


def project_tokens(c: Column, client: Column | None = None) -> Column:
    found = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]{3,}"), F.lit(0)))
    kept = F.filter(found, lambda t: ~t.isin(*PROJECT_STOPWORDS))
    return kept if client is None else F.array_except(kept, F.regexp_extract_all(F.lower(client), F.lit("[a-z0-9]{3,}"), F.lit(0)))


def year(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"\b((?:19|20)\d{2})\b", 1), F.lit(""))


# Lines and sentences


#: What ends a line (fixed value).
LINE_END = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\u2028\u2029]"


def text_lines(text: Column) -> Column:
    """Lines, whatever ends them."""
    return F.split(text, LINE_END)


def section_lines(text: Column, headers: tuple[str, ...], limit: int = 8) -> Column:
    """Items under the header lines, bullets taken off: of each section the lines up to a title-like one, among
    twice ``limit`` lines; ``limit`` in all."""
    ends = lambda x: x.rlike(r"^[A-Z][A-Za-z\s]{2,}$") & ~F.lower(x).isin(*headers)
    upto = lambda w: let(F.array_position(F.transform(w, ends), True).cast("int"), lambda n: F.when(n > 0, F.slice(w, F.lit(1), n - 1)).otherwise(w))

    def of(lines: Column) -> Column:
        at = F.filter(F.transform(lines, lambda x, i: F.when(F.regexp_replace(F.lower(x), "^[ :]+|[ :]+$", "").isin(*headers), i)), lambda i: i.isNotNull())
        blocks = F.transform(at, lambda i: upto(F.slice(lines, i + 2, limit * 2)))
        items = F.transform(F.filter(F.flatten(blocks), lambda x: x != ""), lambda x: F.regexp_replace(x, "^[-•* ]+", ""))
        return F.slice(items, 1, limit)

    # Most texts have no such line at all; only the others are split.
    some = text.rlike("(?imdU)^[\\s:]*(?:" + "|".join(headers) + r")[\s:]*$")
    return F.when(some, let(F.transform(text_lines(text), strip), of)).otherwise(F.array().cast("array<string>"))


def keyword_sentences(text: Column, keywords: tuple[str, ...], most: int = 2) -> Column:
    sentences = F.transform(F.split(collapse(text), r"(?<=[.!?])\s+"), strip)
    pattern = "|".join(keywords)
    hits = F.filter(sentences, lambda s: (F.length(s) >= 24) & F.lower(s).rlike(pattern))
    return F.slice(F.array_distinct(F.transform(hits, lambda s: F.substring(s, 1, 220))), 1, most)


def excerpt(text: Column, patterns: tuple[str, ...], opening: int = 1400, cap: int = 4200) -> Column:
    """The opening and, for each pattern, the window around its first match, windows with one start once."""
    flat = collapse(text)
    starts = F.array(*[F.greatest(F.regexp_instr(F.lower(flat), F.lit(p)) - 1 - 120, F.lit(0)) * F.when(F.lower(flat).rlike(p), 1) for p in patterns])
    windows = F.transform(F.array_distinct(F.filter(starts, lambda x: x.isNotNull())), lambda at: strip(F.substring(flat, at + 1, 1220)))
    return F.substring(F.array_join(F.concat(F.array(F.substring(flat, 1, opening)), windows), "\n"), 1, cap)


# Ordered sets


def ordered_union(*arrays: Column) -> Column:
    """First-seen order, case-sensitive, blanks left out."""
    every = F.transform(F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays]), strip)
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull() & (x != "")))


def ordered_union_nocase(*arrays: Column) -> Column:
    """First-seen order; of spellings that differ in case the first stays."""
    every = ordered_union(*arrays)
    lower = F.transform(every, F.lower)
    return F.filter(every, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1)


def reference_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.upper(strip(x))), lambda x: x != ""))


def document_references(scalars: list[Column], related: Column) -> Column:
    """Upper-cased references of at least three characters, without words that only look like one."""
    every = reference_set(F.concat(F.array(*[F.coalesce(c, F.lit("")) for c in scalars]), F.coalesce(related, F.array().cast("array<string>"))))
    return F.filter(every, lambda x: (F.length(x) >= 3) & ~x.isin("BOX", "NUMBER", "REQUEST", "ORDER"))


def path_prefixes(path: Column) -> Column:
    """Every prefix of a ``/``-joined node path, the shortest first."""
    parts = F.filter(F.transform(F.split(path, "/"), strip), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))
