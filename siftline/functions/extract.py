"""Dates, amounts, names and the kind of a document, from its text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.dates import parse_date
from siftline.functions.text import BLANK, WORD_CHAR, strip

__all__ = ["document_type", "extract_amounts", "extract_dates", "extract_names", "sample_lines"]

_START, _END = rf"(?<!{WORD_CHAR})", rf"(?!{WORD_CHAR})"

# The shapes of dates, amounts and names in running text.
ISO_DATE = rf"{_START}(\d{{4}}-\d{{2}}-\d{{2}}){_END}"
SHORT_DATE = rf"{_START}(\d{{1,2}}[/.-]\d{{1,2}}[/.-]\d{{2,4}}){_END}"
AMOUNT = rf"(?:[$€£₹]{BLANK}*)?(\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|\d+\.\d{{2}}{_END}|{_START}\d{{4,}}{_END})"
NAME = rf"{_START}([A-Z][a-z]+(?:{BLANK}+[A-Z][a-z]+)+){_END}"
MONEY_MENTION = rf"[$€£₹¥]{BLANK}*[\d,]+\.?\d*|{_START}\d{{1,3}}(?:,\d{{3}})+\.\d{{2}}{_END}"
DATE_MENTION = rf"{_START}\d{{4}}-\d{{2}}-\d{{2}}{_END}|{_START}\d{{1,2}}[/.-]\d{{1,2}}[/.-]\d{{2,4}}{_END}"

# Capitalized phrases that are not names.
NOT_NAMES = [
    "total amount", "invoice date", "due date", "payment method",
    "grand total", "sub total", "bank transfer", "credit card",
]


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(1))


def _first(values: Column, n: int | None) -> Column:
    return values if n is None else F.slice(values, 1, n)


def extract_dates(c: Column) -> Column:
    """ARRAY of ISO dates (the raw text where it does not parse), ISO shapes first, distinct."""
    raw = F.concat(_all(c, ISO_DATE), _all(c, SHORT_DATE))
    return F.array_distinct(F.transform(raw, lambda d: F.coalesce(parse_date(d), d)))


def extract_amounts(c: Column, most: int | None = None) -> Column:
    """ARRAY of distinct amounts in text order; bare years are not amounts."""
    raw = F.transform(_all(c, AMOUNT), lambda a: F.translate(a, ",", ""))
    kept = F.filter(raw, lambda a: ~((F.length(a) <= 4) & a.try_cast("double").between(1900, 2100) & ~a.contains(".")))
    return _first(F.array_distinct(F.transform(kept, lambda a: a.try_cast("double"))), most)


def extract_names(c: Column, most: int | None = None) -> Column:
    """ARRAY of runs of capitalized words, distinct ignoring case, in text order and first spelling."""
    names = F.filter(
        _all(c, NAME), lambda n: (F.length(n) >= 4) & ~F.lower(n).isin(NOT_NAMES)
    )
    lower = F.transform(names, lambda n: F.lower(n))
    return F.transform(
        _first(F.array_distinct(lower), most),
        lambda low: F.get(names, (F.array_position(lower, low) - 1).cast("int")),
    )


def document_type(c: Column, sample: int | None = None) -> Column:
    """Kind of a document from amounts, dates and the shape of its lines.

    The whole text is read; ``sample`` limits it to that many leading characters.
    """
    text = F.lower(c if sample is None else F.left(c, F.lit(sample)))
    lines = F.filter(F.split(text, "\n"), lambda line: strip(line) != "")
    total = F.greatest(F.size(lines), F.lit(1))

    def share(sign: str) -> Column:
        rich = F.filter(lines, lambda line: F.length(line) - F.length(F.translate(line, sign, "")) >= 2)
        return F.size(rich) / total

    amounts = F.regexp_count(text, F.lit(MONEY_MENTION))
    dates = F.regexp_count(text, F.lit(DATE_MENTION))
    letters = F.aggregate(lines, F.lit(0), lambda acc, line: acc + F.length(line))
    return (
        F.when(F.coalesce(strip(text), F.lit("")) == "", F.lit("unknown"))
        .when((share(",") > 0.5) | (share("\t") > 0.5), F.lit("tabular_data"))
        .when(amounts >= 3, F.lit("financial_document"))
        .when((dates >= 2) & (F.size(lines) >= 5), F.lit("structured_document"))
        .when((letters / total > 80) & (amounts <= 1), F.lit("narrative_document"))
        .otherwise(F.lit("generic_document"))
    )


def sample_lines(c: Column, most: int = 10_000) -> Column:
    """The trimmed text if it fits, else head, middle and tail lines, cut to ``most`` characters."""
    text = strip(c)
    lines = F.split(text, "\n")
    n = F.size(lines)
    picked = F.concat(
        F.slice(lines, 1, 20), F.slice(lines, F.floor(n / 2).cast("int") + 1, F.lit(10)), F.slice(lines, n - 9, F.lit(10))
    )
    # Short texts never reach the slices, which need more than fifty lines.
    shown = F.when((F.length(text) <= most) | (n <= 50), text).otherwise(F.array_join(picked, "\n"))
    return F.left(shown, F.lit(most))
