"""Money expressions: amounts after labels, currency, revenue, cost and margin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import LINE_END, by_itself, let, once, strip

# Labels in their order.
REVENUE = ("invoice total", "total invoice amount", "billable amount", "contract value", "quote total", "total amount due", "revenue")
COST_FIRST = ("total cost", "estimated cost", "actual cost")
COST_SECOND = ("supplier cost", "labour cost", "labor cost", "material cost", "travel cost", "expense", "expenses", "cost")
REVENUE_KINDS = ("quote", "invoice")
COST_KINDS = ("purchase_order", "access_request", "timesheet", "expense_report")
_NUMBER = r"(\d+(?:,\d{3})*(?:\.\d{1,2})?)"


def parse_money(c: Column) -> Column:
    """The first number of a text; signs are not looked at."""
    return F.replace(F.regexp_extract(c, _NUMBER, 1), F.lit(","), F.lit("")).try_cast("double")


def safe_float(c: Column) -> Column:
    """A number, 0 for null or nonsense."""
    return F.coalesce(F.replace(F.trim(c.cast("string")), F.lit(","), F.lit("")).try_cast("double"), F.lit(0.0))


def currency(text: Column) -> Column:
    """A dollar sign alone means USD, also after an A."""
    return let(F.lower(text), lambda low: currency_in(text, low))


def currency_in(text: Column, low: Column) -> Column:
    """``currency`` of a text that is there in lower case, too."""
    # A search for the word or sign goes before each pattern.
    has = lambda word, sign: (F.contains(low, F.lit(word)) & text.rlike(rf"(?i)\b{word}\b")) | F.contains(low, F.lit(sign))
    return F.when(has("usd", "$"), "USD").when(has("aud", "a$"), "AUD").when(has("eur", "€"), "EUR").when(has("gbp", "£"), "GBP").otherwise("")


def currency_amounts(text: Column, most: int = 5) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(?i)(?:\$|AUD\s*)\d[\d,]*(?:\.\d{2})?"), F.lit(0))
    lower = F.transform(found, F.lower)
    return F.slice(F.filter(found, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1), 1, most)


def first_money(text: Column) -> Column:
    """An amount with a currency before it, else the first plain number that is long or grouped."""
    marked = F.regexp_extract(text, r"(?i)(?:USD|AUD|EUR|GBP|A\$|\$|€|£)\s*" + _NUMBER, 1)
    plain = F.regexp_extract(text, r"(?<![A-Za-z0-9\-])((?:\d{1,3}(?:,\d{3})+|\d{4,})(?:\.\d{1,2})?)(?![A-Za-z0-9\-])", 1)
    return F.coalesce(parse_money(marked), parse_money(plain))


def plain_lines(text: Column) -> Column:
    """The text with its lines stripped, without list marks and emphasis."""
    return let(_joined(text), _plain)


def _joined(text: Column) -> Column:
    """The text with one kind of line end. Each step is taken only where a character other than the printable ones of ASCII stands in its
    place, which is cheaper to see."""
    return F.when(text.rlike(r"[^\n -~]"), F.regexp_replace(text, LINE_END, "\n")).otherwise(text)


def _plain(joined: Column) -> Column:
    blank = joined.rlike(r"\n(?:(?<=[^!-~\n]\n)|[^!-~\n])") | ~joined.rlike(r"(?s)\A[!-~].*[!-~]\z")
    stripped = F.when(blank, F.regexp_replace(joined, r"(?Um)^[\s&&[^\n]]+|[\s&&[^\n]]+$", "")).otherwise(joined)
    return F.replace(F.regexp_replace(stripped, r"(?m)^[-* ]+", ""), F.lit("**"), F.lit(""))


def labelled_amount(plain: Column, labels: tuple[str, ...]) -> Column:
    """The first amount in the text behind one of the labels and a colon or bar."""
    every = "|".join(label.replace(" ", r"\s+") for label in labels)
    found = F.regexp_extract_all(plain, F.lit(rf"(?imd)^\s*(?:{every})\s*(?::|\|)\s*([^\n]+)$"), F.lit(1))
    return F.try_element_at(F.filter(F.transform(found, parse_money), lambda x: x.isNotNull()), F.lit(1))


def amount_after_labels(plain: Column, labels: tuple[str, ...]) -> Column:
    """The first amount, in the order of the lines, on a line that begins with a label, or within two lines
    below one that is a label. Blank lines don't count."""
    every = "|".join(sorted(labels, key=len, reverse=True))

    def of(lines: Column) -> Column:
        def amount(x: Column, i: Column) -> Column:
            return let(F.regexp_extract(F.lower(x), rf"^({every})(?:$|[:| ])", 1), lambda label: F.when(label != "", behind(x, i, F.length(label))))

        def behind(x: Column, i: Column, n: Column) -> Column:
            rest = F.substring(x, n + 1, F.length(x))
            part = F.when(F.contains(x, F.lit(":")), F.regexp_extract(x, "^[^:]*:(.*)$", 1)).otherwise(F.regexp_extract(x, r"^[^|]*\|(.*)$", 1))
            below = F.coalesce(parse_money(F.try_element_at(lines, i + 2)), parse_money(F.try_element_at(lines, i + 3)))
            return F.when(rest == "", below).when(rest.rlike("^[:|]"), parse_money(part)).otherwise(parse_money(rest))

        return F.try_element_at(F.filter(F.transform(lines, amount), lambda x: x.isNotNull()), F.lit(1))

    # Lines are split from the first such one on; most texts have none at all.
    tail = F.regexp_extract(plain, rf"(?im)^[^\S\n]*(?:{every})(?:$|[:| ])(?s:.*)", 0)
    return let(tail, lambda t: F.when(t != "", let(F.filter(F.transform(F.split(t, "\n"), strip), lambda x: x != ""), of)))


def financials(text: Column, kind: Column) -> Column:
    """Struct of type, currency, revenue, cost, profit and margin of a document.

    A side without an amount is null, and 0 is an amount; profit and margin need both sides.
    """
    sides = lambda plain: F.struct(F.round(_revenue(plain, kind), 2).alias("r"), F.round(_cost(plain, F.lower(plain), kind), 2).alias("c"), currency(text).alias("code"))
    return let(let(plain_lines(text), sides), lambda v: money_struct(v["r"], v["c"], v["code"]))


def _revenue(plain: Column, kind: Column) -> Column:
    return F.coalesce(labelled_amount(plain, REVENUE), amount_after_labels(plain, REVENUE), F.when(kind.isin(*REVENUE_KINDS), first_money(plain)))


def _cost(plain: Column, low: Column, kind: Column) -> Column:
    labelled = F.coalesce(labelled_amount(plain, COST_FIRST), amount_after_labels(plain, COST_FIRST), labelled_amount(plain, COST_SECOND), amount_after_labels(plain, COST_SECOND))
    # Every label of a cost holds one of these words.
    return F.coalesce(F.when(F.contains(low, F.lit("cost")) | F.contains(low, F.lit("expense")), labelled), F.when(kind.isin(*COST_KINDS), first_money(plain)))


def with_financials(docs: DataFrame) -> DataFrame:
    """``docs`` (text, document_kind) with the fields of ``financials``: the same steps, each a column, which Spark compiles where it
    interprets what is bound in a lambda."""
    r = docs.withColumns({"__joined": once(_joined(F.col("text"))), "__lower": F.lower("text")}).withColumn("__plain", once(_plain(F.col("__joined"))))
    plain, kind = F.col("__plain"), F.col("document_kind")
    r = r.withColumn("__plain_low", F.lower("__plain"))
    found = {"__r": _revenue(plain, kind), "__c": _cost(plain, F.col("__plain_low"), kind), "__code": by_itself(currency_in(F.col("text"), F.col("__lower")))}
    r = r.withColumns({n: once(c) for n, c in found.items()})
    r = r.withColumn("__m", once(money_struct(F.round("__r", 2), F.round("__c", 2), F.col("__code"))))
    return r.select(*docs.columns, "__m.*")


def money_struct(r: Column, c: Column, code: Column) -> Column:
    sort = F.when(r.isNotNull() & c.isNotNull(), "mixed").when(r.isNotNull(), "revenue").when(c.isNotNull(), "cost").otherwise("")
    profit = F.round(r - c, 2)
    return F.struct(sort.alias("financial_type"), code.alias("currency"), r.alias("revenue_amount"), c.alias("cost_amount"), profit.alias("gross_profit"), F.when(r > 0, F.round(profit / r * 100, 2)).alias("gross_margin_pct"))
