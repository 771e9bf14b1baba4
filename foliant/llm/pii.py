"""PII sanitisation by disclosure: what a term gives away about a protected entity.

Base matches (e-mail addresses, IP addresses, card and phone numbers) are found in whole texts;
their values are the protected entities. Around each mention a window of words is its context, and
the whole text of a document that holds the entity is a wider one. Over all documents, a term ``t`` discloses an entity ``c`` by the pointwise mutual information

    PMI(c; t) = log2( p(t | context of c) / p(t) )

with ``p(t | context of c)`` from the distinct contexts of ``c`` and ``p(t)`` the share of documents
that hold ``t``; windows and whole texts are counted each for themselves, and the higher PMI holds. A
copied passage counts once: contexts that read the same are one, and of the texts that name ``c`` first
in the same window one counts, however they differ elsewhere. A disclosing term is masked wherever it
stands in documents that hold the entity; in all others as well if the test holds over all pairs of the
table, as a mask there touches texts that nothing else ties to the entity. Terms are words of any length
outside of base matches. Against the information content ``IC(c) = -log2(documents with c / documents)`` a
term whose PMI reaches ``remove`` of it is removed, one that reaches ``generalise`` of it is replaced by its
kind, but none that tells fewer than ``least_bits`` bits. No number of contexts is demanded: what may be
chance is told by a test (Chernoff's bound on a binomial count as high as the one seen, at ``chance`` over
all terms of the entity), which an entity of a single text passes with terms that are rare enough, or that
stand by it again and again.

Only DataFrame and SQL functions are used. Positions of matches come from the lengths of the
matches and of the pieces between them. Patterns are possessive and begin at a border or where
the match before ended, which gives the same matches as the plain forms in linear time.

Defined results: a null or empty text has no spans; texts of any length are read whole, in time that grows
with the text and its spans; repeated rows have the same spans each; of overlapping spans the first by start
masks, at equal starts the shorter; an empty table gives an empty result; other columns are left alone,
whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Kinds in their order; method spans come after them.
KINDS = ("email", "ip", "card", "phone")
TERM_KINDS = ("general", "term")

_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Runs of fewer than 13 digits would be dropped, and none of their parts can be longer.
    "card": r"[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without these can have no match of the kind.
HINTS = {"email": "@[A-Za-z0-9-]++[.]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){12}", "phone": r"\+[0-9]"}
SIGNS = {"email": "@", "phone": "+"}
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "", "general": "[TERM]"}
#: What is no part of a term at a word's ends (fixed values).
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Settings:
    #: Characters on either side of a mention that make its context (cut to whole words).
    window: int = 120
    #: Chance, over all terms of an entity, that one of them stands by it as often as it does.
    chance: float = 0.05
    remove: float = 0.95
    generalise: float = 0.8
    #: Bits that a term must tell of an entity: an entity that most documents hold has little to disclose.
    least_bits: float = 2.0


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    d = F.reverse(F.filter(F.split(digits, ""), lambda x: x != ""))
    value = F.transform(d, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((2 * x.cast("int")) % 10 + F.floor(2 * x.cast("int") / 10).cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x.cast("int")) % 10 == 0


def _passes(kind: str, span: Column) -> Column:
    value = span["value"]
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    n = F.length(_digits(value))
    return n.between(13, 19) & luhn(_digits(value)) if kind == "card" else n.between(9, 15)


def located(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the leftmost non-overlapping matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    steps = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda n, v: F.struct(n.alias("gap"), v.alias("value")))
    return F.when(F.size(found) > 0, _let(steps, _summed)).otherwise(F.array().cast(_PLACED))


_PLACED = "array<struct<start:int,end:int,value:string>>"
#: Spans of a run: what is folded within a run is short, so folding grows little more than the spans.
_RUN = 128


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _runs(items: Column) -> Column:
    """The items of a non-empty array in runs."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / _RUN).cast("int")), lambda i: F.slice(items, i * _RUN + 1, F.lit(_RUN)))


def _summed(steps: Column) -> Column:
    """Spans from the gaps before them and their values: each begins where the one before ends, and a gap later."""
    length = lambda x: x["gap"] + F.length(x["value"])

    def add(out: Column, x: Column) -> Column:
        at = out[F.size(out) - 1]["end"] + x["gap"]
        return F.concat(out, F.array(F.struct(at.alias("start"), (at + F.length(x["value"])).alias("end"), x["value"].alias("value"))))

    def placed(run: Column, begin: Column) -> Column:
        first = F.array(F.struct(begin.alias("start"), begin.alias("end"), F.lit("").alias("value"))).cast(_PLACED)
        return F.aggregate(run, first, add, lambda out: F.slice(out, F.lit(2), F.size(out)))

    def of(runs: Column) -> Column:
        sums = F.transform(runs, lambda r: F.aggregate(r, F.lit(0), lambda a, x: a + length(x)))
        begins = F.aggregate(sums, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(out[F.size(out) - 1] + n)))
        return F.flatten(F.zip_with(runs, F.slice(begins, F.lit(1), F.size(runs)), placed))

    return _let(_runs(steps), of)


def replaced(text: Column, ordered: Column, new) -> Column:
    """``text`` with ``new(span, is_first, hidden)`` in place of the spans (start, end, ...), which are ordered by start:
    whether no span before reaches into it, and how much of it is left beyond those before."""

    def run_of(run: Column, begin: Column) -> Column:
        # Only a run's own piece of the text is cut up for its spans.
        piece = F.substring(text, begin + 1, F.greatest(F.array_max(F.transform(run, lambda s: s["end"])) - begin, F.lit(0)))

        def cut(own: Column) -> Column:
            def step(acc: Column, s: Column) -> Column:
                keep = F.substring(own, acc["at"] - begin + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
                hidden = F.greatest(s["end"] - F.greatest(s["start"], acc["at"]), F.lit(0))
                return F.struct(F.concat(acc["out"], keep, new(s, s["start"] >= acc["at"], hidden)).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

            return F.aggregate(run, F.struct(F.lit("").alias("out"), begin.alias("at")), step, lambda a: a["out"])

        return _let(piece, cut)

    def of(runs: Column) -> Column:
        ends = F.transform(runs, lambda r: F.array_max(F.transform(r, lambda s: s["end"])))
        begins = F.aggregate(ends, F.array(F.lit(0)), lambda out, n: F.concat(out, F.array(F.greatest(out[F.size(out) - 1], n))))
        parts = F.zip_with(runs, F.slice(begins, F.lit(1), F.size(runs)), run_of)
        return F.concat(F.array_join(parts, ""), F.substring(text, begins[F.size(begins) - 1] + 1, F.length(text)))

    return F.when(F.size(ordered) > 0, _let(_runs(ordered), of)).otherwise(text)


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, value), by kind as listed, then start."""
    text = F.coalesce(text, F.lit(""))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    parts = []
    for kind in KINDS:
        spans = F.filter(located(text, PATTERNS[kind]), partial(_passes, kind))
        named = F.transform(spans, partial(_named, kind))
        there = text.contains(SIGNS[kind]) if kind in SIGNS else text.rlike("[0-9]")
        parts.append(F.when(there & text.rlike(HINTS[kind]), named).otherwise(empty))
    return F.concat(*parts)


def _named(kind: str, s: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))


def _of_kind(kind: str, s: Column) -> Column:
    return s["kind"] == kind


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _core(word: Column) -> Column:
    return F.btrim(word, F.lit(_PUNCTUATION))


def _words(text: Column) -> Column:
    return F.split(text, r"[\x20\x09-\x0D]")


_EDGES = rf"(?<![^\x20\x09-\x0D])[{re.escape(_PUNCTUATION)}]++|[{re.escape(_PUNCTUATION)}]++(?![^\x20\x09-\x0D])"


def _terms(text: Column) -> Column:
    """Distinct lower-case words without punctuation at their ends."""
    return F.array_remove(F.array_distinct(_words(F.lower(F.regexp_replace(text, _EDGES, "")))), "")


def blanked(text: Column, spans: Column) -> Column:
    """``text`` with spaces in place of the spans; positions stay."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return replaced(F.coalesce(text, F.lit("")), ordered, lambda s, is_first, hidden: F.repeat(F.lit(" "), hidden))


def _entity(span: Column) -> Column:
    return F.concat_ws(":", span["kind"], F.when(span["kind"].isin("card", "phone"), _digits(span["value"])).otherwise(F.lower(span["value"])))


def mentions(found: DataFrame, cfg: Settings) -> DataFrame:
    """A row for each base span of ``found`` (plain text, spans and key columns): the entity and its context."""
    m = found.withColumn("span", F.explode("spans"))
    left = F.expr(f"substring(plain, greatest(1, span.start + 1 - {cfg.window}), least(span.start, {cfg.window}))")
    right = F.expr(f"substring(plain, span.end + 1, {cfg.window})")
    # Words that the window cuts are left out.
    left = F.when(F.col("span.start") > cfg.window, F.regexp_replace(left, f"^{_WORD}", "")).otherwise(left)
    right = F.when(F.length("plain") > F.col("span.end") + cfg.window, F.regexp_replace(right, f"{_WORD}$", "")).otherwise(right)
    return m.withColumn("entity", _entity(F.col("span"))).withColumn("left", left).withColumn("right", right)


def _pairs(contexts: DataFrame, held: DataFrame) -> DataFrame:
    """A row for each (entity, term) of distinct contexts (entity, terms), with the entity's counts."""
    sizes = contexts.groupBy("entity").agg(F.count(F.lit(1)).alias("n_contexts"), F.sum(F.size("terms")).alias("n_tests"))
    return contexts.join(sizes.join(held, "entity"), "entity").select("entity", "n_contexts", "n_tests", "n_held", F.explode("terms").alias("term"))


def disclosures(found: DataFrame, holding: DataFrame, cfg: Settings) -> DataFrame:
    """(entity, term, ratio, everywhere) of the terms that disclose an entity, from all documents.

    ``found``: all documents with their spans; ``holding``: the distinct ones that have any.
    """
    total = max(found.count(), 1)
    n_docs = F.lit(float(total))
    # Contexts that read the same count once, in one document or in many; so do copies of a text.
    windows = mentions(holding, cfg).select("key", "entity", "span.start", F.xxhash64("left", "right").alias("context"), F.concat_ws(" ", "left", "right").alias("around"))
    near = windows.dropDuplicates(["entity", "context"]).select("entity", _terms(F.col("around")).alias("terms"))
    firsts = windows.groupBy("entity", "key").agg(F.min_by("context", "start").alias("context")).groupBy("entity", "context").agg(F.min("key").alias("key"))
    whole = firsts.join(holding.select("key", "terms"), "key").select("entity", "terms")
    of_texts = holding.select(F.explode("entities").alias("entity"), "copies")
    n_all = float(near.select("terms").unionByName(whole.select("terms")).agg(F.sum(F.size("terms"))).first()[0] or 1)
    # Documents with the entity: copies count, as they do for the terms.
    held = of_texts.groupBy("entity").agg(F.sum("copies").alias("n_held"))
    df = found.select(F.explode(_terms(blanked(F.col("text"), F.col("spans")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    content = -F.log2(F.col("n_held") / n_docs)
    q = F.col("n_term") / n_docs
    least = F.greatest(cfg.generalise * content, F.lit(cfg.least_bits))
    found_in = []
    for contexts in (near, whole):
        # A term so common that no count could reach the ratio goes before the counting.
        rows = _pairs(contexts, held).join(df, "term").where((content > 0) & (-F.log2(q) >= least - 1e-9))
        joint = rows.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_joint"), *[F.first(c).alias(c) for c in ("n_contexts", "n_tests", "n_held", "n_term")])
        p = F.col("n_joint") / F.col("n_contexts")
        pmi = F.log2(p / q)
        # Bits of evidence that p is no chance result of q.
        rest = F.when(p < 1, (F.col("n_contexts") - F.col("n_joint")) * F.log2(F.try_divide(1 - p, 1 - q))).otherwise(0.0)
        evidence = F.col("n_joint") * pmi + rest
        enough = (pmi >= cfg.least_bits) & (evidence >= F.log2(F.col("n_tests") / cfg.chance))
        given = joint.where(enough).withColumn("ratio", F.try_divide(pmi, content)).where(F.col("ratio") >= cfg.generalise)
        found_in.append(given.select("entity", "term", "ratio", (evidence >= F.log2(F.lit(n_all / cfg.chance))).alias("everywhere")))
    return found_in[0].unionByName(found_in[1]).groupBy("entity", "term").agg(F.max("ratio").alias("ratio"), F.max("everywhere").alias("everywhere"))


#: Most bits (as a power of two) of a filter of terms or texts: 2 MB. Beyond an eighth of them in values it lets more rows
#: through to a join, and loses none.
_MOST_BITS = 24


def _maybe_in(rows: DataFrame, column: str):
    """A test of a value that all of ``rows`` pass in the column and few others: one bit for each hash."""
    n_bits = min(_MOST_BITS, max(10, (32 * rows.count()).bit_length()))
    low = F.lit((1 << n_bits) - 1)
    at = F.xxhash64(column).bitwiseAND(low)
    bytes_of = rows.select(F.shiftright(at, 3).alias("byte"), F.call_function("shiftleft", F.lit(1), at.bitwiseAND(F.lit(7)).cast("int")).alias("bit")).groupBy("byte").agg(F.bit_or("bit").alias("bits")).collect()
    bits = bytearray(1 << (n_bits - 3))
    for r in bytes_of:
        bits[r.byte] = r.bits
    held = F.lit(bytes(bits))

    def test(value: Column) -> Column:
        at = F.xxhash64(value).bitwiseAND(low)
        byte = F.conv(F.hex(F.substring(held, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), at.bitwiseAND(F.lit(7)).cast("int"))) != 0

    return test


def kinds_by_text(found: DataFrame, holding: DataFrame, given: DataFrame, cfg: Settings) -> DataFrame:
    """(key, kinds): for each text the kinds of the terms that are masked in it."""
    hit = holding.select("key", F.explode("entities").alias("entity")).join(given, "entity").select("key", "term", "ratio")
    known = given.where("everywhere").groupBy("term").agg(F.max("ratio").alias("ratio"))
    if not known.isEmpty():
        known = checkpointed(known)
        terms = F.explode(F.filter(_terms(blanked(F.col("text"), F.col("spans"))), _maybe_in(known, "term")))
        hit = hit.unionByName(found.select("key", terms.alias("term")).join(known, "term").select("key", "term", "ratio"))
    hit = hit.groupBy("key", "term").agg(F.max("ratio").alias("ratio"))
    kind = F.when(F.col("ratio") >= cfg.remove, F.lit("term")).otherwise(F.lit("general"))
    return hit.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", kind))).alias("kinds"))


_TERM_SPANS = "array<struct<kind:string,start:int,end:int>>"


def term_spans(text: Column, spans: Column, kinds: Column) -> Column:
    """Spans of the terms in ``kinds``, wherever in a text they stand, by kind and start."""
    none = F.array().cast(_TERM_SPANS)

    def add(acc: Column, w: Column) -> Column:
        # A word starts where those before it end, each with one separator.
        start = acc["at"] + F.length(w) - F.length(F.ltrim(w, F.lit(_PUNCTUATION)))
        kind = F.try_element_at(kinds, F.lower(_core(w)))
        one = F.struct(kind.alias("kind"), start.alias("start"), (start + F.length(_core(w))).alias("end"))
        return F.struct((acc["at"] + F.length(w) + 1).alias("at"), F.when(kind.isNotNull(), F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    got = F.aggregate(_words(blanked(text, spans)), F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda a: F.array_sort(a["out"]))
    return F.when(kinds.isNotNull(), got).otherwise(none)


def analysed(docs: DataFrame, cfg: Settings) -> DataFrame:
    """(row, text, spans, term_spans) of ``docs``, a table of a struct ``row`` and a ``text``.

    The key is a hash of the text: equal texts have equal spans, so a repeated row needs no more.
    """
    keyed = docs.withColumn("key", F.xxhash64("text", F.length("text")))
    found = keyed.withColumn("spans", base_spans(F.col("text")))
    holding = found.where(F.size("spans") > 0).groupBy("key").agg(F.first("text").alias("text"), F.first("spans").alias("spans"), F.count(F.lit(1)).alias("copies"))
    holding = holding.select("key", "spans", "copies", blanked(F.col("text"), F.col("spans")).alias("plain"))
    holding = checkpointed(holding.withColumn("terms", _terms(F.col("plain"))).withColumn("entities", F.array_distinct(F.transform("spans", _entity))))
    small = found.select("key", "text", "spans")
    given = checkpointed(disclosures(small, holding, cfg))
    kinds = checkpointed(kinds_by_text(small, holding, given, cfg))
    # Only texts that may hold a disclosing term are moved to where its kind is known.
    maybe = _maybe_in(kinds.select("key"), "key")(F.col("key"))
    hit = keyed.where(maybe).withColumn("spans", base_spans(F.col("text"))).join(kinds, "key", "left")
    hit = hit.select("row", "text", "spans", term_spans(F.col("text"), F.col("spans"), F.col("kinds")).alias("term_spans"))
    rest = keyed.where(~maybe).select("row", "text", base_spans(F.col("text")).alias("spans"), F.array().cast(_TERM_SPANS).alias("term_spans"))
    return rest.unionByName(hit)


def find_all(docs: DataFrame, cfg: Settings | None = None) -> DataFrame:
    """The contract's columns for every document."""
    cfg = cfg or Settings()
    every = analysed(docs.select(F.struct("doc_id").alias("row"), "text"), cfg)
    counts = [F.size(F.filter("spans", partial(_of_kind, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    base = joined(F.col("spans"))
    extra = joined(F.col("term_spans"))
    return every.select("row.doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), F.concat_ws(",", F.nullif(base, F.lit("")), F.nullif(extra, F.lit(""))).alias("spans"), F.size("term_spans").cast("long").alias("n_terms"))


def sanitised(docs: DataFrame, cfg: Settings | None = None) -> DataFrame:
    """Pipeline stage: ``docs`` whose spans are masked; all other texts and columns stay. ``n_chars``, if there is
    such a column, is the length of the new text."""
    cfg = cfg or Settings()
    every = analysed(docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("row"), "text"), cfg)
    shape = "array<struct<start:int,end:int,kind:string>>"
    as_shape = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    spans = F.array_sort(F.concat(as_shape("spans").cast(shape), F.coalesce(as_shape("term_spans").cast(shape), F.array().cast(shape))))
    mask = lambda s: reduce(lambda w, m: w.when(s["kind"] == m[0], m[1]), list(MASKS.items())[1:], F.when(s["kind"] == "email", MASKS["email"]))
    new = replaced(F.col("text"), spans, lambda s, is_first, hidden: F.when(is_first, mask(s)).otherwise(""))
    masked = every.withColumn("new", F.when((F.size("spans") > 0) | (F.size("term_spans") > 0), new).otherwise(F.col("text")))
    out = {c: F.col("row").getField(c) for c in docs.columns if c != "text"} | {"text": F.col("new")}
    if "n_chars" in out:
        changed = ~F.col("new").eqNullSafe(F.col("text"))
        out["n_chars"] = F.when(changed, F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return masked.select(*[out[c].alias(c) for c in docs.columns])
