"""Date and time expressions. Two orders exist on purpose: documents are read month first,
what a user types is read day first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import filled, let, strip

#: Shapes of a date in running text, in the order in which they are looked for (fixed values).
DATE_SHAPES = (r"\b(\d{4}-\d{2}-\d{2})\b", r"\b(\d{1,2}/\d{1,2}/\d{2,4})\b", r"\b([A-Za-z]{3,9}\s+\d{1,2},\s*\d{4})\b", r"\b(\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4})\b")
#: Labelled dates, in their order (fixed values).
LABELLED_DATES = (
    r"^\s*report\s*date\s*[:\-]\s*(\d{4}-\d{2}-\d{2})",
    r"^\s*date\s*[:\-]\s*(\d{4}-\d{2}-\d{2})",
    r"^\s*date\s*[:\-]\s*(\d{1,2}/\d{1,2}/\d{2,4})",
    r"^\s*report\s*date\s*[:\-]\s*([A-Za-z]{3,9}\s+\d{1,2},\s*\d{4})",
    r"^\s*date\s*[:\-]\s*([A-Za-z]{3,9}\s+\d{1,2},\s*\d{4})",
    r"^\s*report\s*date\s*[:\-]\s*(\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4})",
    r"^\s*date\s*[:\-]\s*(\d{1,2}\s+[A-Za-z]{3,9}\s+\d{4})",
)
_MONTHS = "january february march april may june july august september october november december".split()
_SLASHED = r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})$"
_NAMED = r"^([A-Za-z]+)\s+(\d{1,2}),\s+(\d{4})$|^(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})$"


def _day(year: Column, month: Column, day: Column) -> Column:
    """ISO text of a day that there is, else null. No parser that throws is asked."""
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    most = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    ok = (year >= 1) & month.between(1, 12) & (day >= 1) & (day <= most)
    return F.when(ok, F.format_string("%04d-%02d-%02d", year, month, day))


def normal_date(c: Column) -> Column:
    """ISO text of a date; text in ISO shape is passed through unchecked, nonsense gives null.

    Slashed dates are month first where that makes a day, else day first; two-digit years from 69 on
    belong to the last century; months are named in full or by three letters.
    """
    return let(strip(c), lambda x: F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), x).when(x.rlike("^\\d{1,2}/"), _slashed(x)).when(x.rlike("[A-Za-z]"), _named(x)))


def _number(c: Column) -> Column:
    return F.nullif(c, F.lit("")).cast("int")


def _slashed(x: Column) -> Column:
    def day(n: Column) -> Column:
        year = F.when(n[3] == 4, n[2]).when(n[2] >= 69, n[2] + 1900).otherwise(n[2] + 2000)
        return F.coalesce(_day(year, n[0], n[1]), _day(year, n[1], n[0]))

    parts = [F.regexp_extract(x, _SLASHED, k) for k in (1, 2, 3)]
    return let(F.array(*map(_number, parts), F.length(parts[2])), day)


def _named(x: Column) -> Column:
    def day(p: Column) -> Column:
        word = F.lower(F.concat(p[0], p[4]))
        month = reduce(lambda w, m: w.when(word.isin(m[1], m[1][:3]), m[0] + 1), enumerate(_MONTHS), F.when(F.lit(False), 0))
        return let(F.array(_number(F.concat(p[2], p[5])), month, _number(F.concat(p[1], p[3]))), lambda n: _day(n[0], n[1], n[2]))

    return let(F.array(*[F.regexp_extract(x, _NAMED, k) for k in range(1, 7)]), day)


def all_dates(text: Column) -> Column:
    """Normalised dates in the order of the shapes, each once."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit("(?imd)" + p), F.lit(1)) for p in DATE_SHAPES])
    return F.array_distinct(F.filter(F.transform(found, normal_date), lambda d: d.isNotNull()))


def date_candidates(text: Column, most: int = 10) -> Column:
    return F.slice(all_dates(text), 1, most)


def labelled_date(text: Column, low: Column | None = None) -> Column:
    """What stands behind the first label that has a date in its shape; ``low``: the text in lower case."""
    found = F.coalesce(*[filled(F.regexp_extract(text, "(?imd)" + p, 1)) for p in LABELLED_DATES])
    return found if low is None else F.when(F.contains(low, F.lit("date")), found)


def report_date(text: Column, labelled: Column | None = None) -> Column:
    """The date behind the first label that has one in its shape; if that is no day, the first date of the text."""
    return F.coalesce(normal_date(labelled_date(text) if labelled is None else labelled), F.try_element_at(all_dates(text), F.lit(1)))


def typed_date(c: Column) -> Column:
    """A date as a user types it: ISO, day/month/year, month/day/year."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(F.trim(c), F.lit(p))) for p in ("yyyy-MM-dd", "d/M/yyyy", "M/d/yyyy")])


def moment(c: Column) -> Column:
    """A timestamp from ISO text with or without time, or one of the typed dates."""
    forms = ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "d/M/yyyy", "M/d/yyyy")
    x = F.regexp_replace(F.trim(c), "Z$", "")
    return reduce(F.coalesce, [F.try_to_timestamp(x, F.lit(p)) for p in forms])


def infer_report_date(events: Column, path_stem: Column, parent: Column, kind: Column) -> Column:
    """First ISO event date; a date in the file's or folder's name; for reports the year's first day."""
    iso = F.try_element_at(F.filter(events, lambda d: d.rlike(r"^\d{4}-\d{2}-\d{2}$")), F.lit(1))
    joined = F.concat_ws(" ", path_stem, parent)
    named = F.nullif(F.regexp_extract(joined, r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    year = F.nullif(F.regexp_extract(joined, r"(?:^|[_\- ])(20\d{2}|19\d{2})(?:[_\- ]|$)", 1), F.lit(""))
    return F.coalesce(iso, named, F.when(kind == "report", F.concat(year, F.lit("-01-01"))))
