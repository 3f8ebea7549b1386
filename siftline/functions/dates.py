"""Date reading of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.text import BLANK, WORD_CHAR, strip

__all__ = ["looks_like_date", "parse_date"]

_MONTHS = (
    "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
    "|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
)
_MONTH_STARTS = "janfebmaraprmayjunjulaugsepoctnovdec"

# Fixed value: the years that a date may have, 1900 to 2100.
_YEAR = r"(?:19\d\d|20\d\d|2100)"
# Rewrites of the accepted formats into year-month-day text, whose month may still be a name.
_DAY_FIRST = (rf"^(\d{{1,2}})-(\d{{1,2}})-({_YEAR})$", "$3-$2-$1")
_YEAR_FIRST = (rf"^({_YEAR})/(\d{{1,2}})/(\d{{1,2}})$", "$1-$2-$3")
_DAY_MONTH_NAME = (rf"(?i)^(\d{{1,2}}){BLANK}+({_MONTHS}){BLANK}+({_YEAR})$", "$3-$2-$1")
_MONTH_NAME_DAY = (rf"(?i)^({_MONTHS}){BLANK}+(\d{{1,2}}),{BLANK}+({_YEAR})$", "$3-$1-$2")
_SLASHED = rf"^(\d{{1,2}})/(\d{{1,2}})/({_YEAR})$"
_ISO_DATE = rf"^{_YEAR}-\d{{1,2}}-\d{{1,2}}$"
_ISO_LIKE = r"^\d{4}-\d{1,2}-\d{1,2}$"

# Shapes that count as a date when a column is profiled.
_DATE_SHAPES = [
    r"\d{4}-\d{2}-\d{2}",
    r"\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}",
    rf"\d{{1,2}}{BLANK}+{WORD_CHAR}+{BLANK}+\d{{4}}",
    rf"{WORD_CHAR}+{BLANK}+\d{{1,2}},?{BLANK}+\d{{4}}",
]


def _month_number(c: Column) -> Column:
    """``2024-Mar-5`` to ``2024-3-5``."""
    name = F.lower(F.substr(c, F.lit(6), F.lit(3)))
    number = ((F.instr(F.lit(_MONTH_STARTS), name) + 2) / 3).cast("int").cast("string")
    return F.regexp_replace(c, F.lit("-[A-Za-z]+-"), F.concat(F.lit("-"), number, F.lit("-")))


def _ends_in_digit(c: Column) -> Column:
    return F.right(c, F.lit(1)).between("0", "9")


def parse_date(c: Column, trimmed: bool = False) -> Column:
    """ISO text of the date, NULL when none of the nine formats fits or the year is not 1900..2100.

    The pattern of a format also checks the year, and a cell is rewritten and cast by its own format only. Slashed dates
    are read month first, then day first. ``trimmed`` says that the text has no blanks at its ends.
    """
    s = c if trimmed else strip(c)
    cast = lambda t: t.try_cast("date").cast("string")
    found = F.when(s.rlike(_ISO_DATE), cast(s)).when(s.rlike(_SLASHED), F.coalesce(
        cast(F.regexp_replace(s, _SLASHED, "$3-$1-$2")), cast(F.regexp_replace(s, _SLASHED, "$3-$2-$1"))
    ))
    for pattern, order in (_DAY_FIRST, _YEAR_FIRST):
        found = found.when(s.rlike(pattern), cast(F.regexp_replace(s, pattern, order)))
    for pattern, order in (_DAY_MONTH_NAME, _MONTH_NAME_DAY):
        found = found.when(s.rlike(pattern), cast(_month_number(F.regexp_replace(s, pattern, order))))
    # The last character turns most other text away.
    found = F.when(_ends_in_digit(s), found)
    # Dates that are in order already are not trimmed first.
    return found if trimmed else F.when(c.rlike(_ISO_DATE.replace("$", r"\z")), cast(c)).otherwise(found)


def looks_like_date(c: Column, trimmed: bool = False) -> Column:
    """A date shape of 4 to 40 characters that is not all digits, or anything that parses."""
    s = c if trimmed else strip(c)
    shape = s.rlike("^(?:" + "|".join(_DATE_SHAPES) + ")$")
    # Of the formats that parse, only these are not among the shapes.
    rare = F.regexp_extract(F.translate(s, "/", "-"), _ISO_LIKE, 0).try_cast("date").cast("string")
    mixed = s.rlike("^[0-9]{4}(?:-[0-9]+-|/[0-9]+/)[0-9]+$")
    return _ends_in_digit(s) & F.length(s).between(4, 40) & (
        shape | (mixed & F.coalesce(rare.between("1900", "2101"), F.lit(False)))
    )
