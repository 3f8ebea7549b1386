"""Number, currency and boolean readings of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.text import BLANK, BLANK_CHARS, clean_noise, is_noisy, strip, strip_column

__all__ = [
    "CURRENCY_SIGNS", "coerce_bool", "coerce_number", "detect_currency", "is_bare_small_int",
    "is_numeric_like", "is_salary", "is_whole", "looks_like_currency", "parse_number",
]

# Currency signs and their ISO codes, in order of detection.
CURRENCY_SIGNS = {"$": "USD", "€": "EUR", "£": "GBP", "₹": "INR", "¥": "JPY", "₩": "KRW", "₽": "RUB"}

# Digits may be grouped by single underscores; words such as nan and inf are not numbers here.
_DIGITS = r"\d+(?:_\d+)*"
_NUMBER = rf"^[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?$"

# Words that count as true and as false.
TRUE_WORDS = ["true", "t", "yes", "y", "1"]
FALSE_WORDS = ["false", "f", "no", "n", "0"]


# Every character that a number may hold, and the plainest numbers, which need no rewriting.
_NUMBER_CHARS = rf"^[0-9$,€£₹¥₩₽_.eE+{BLANK[1:-1]}-]++\z"
_PLAIN_NUMBER = r"^[+-]?[0-9]{1,300}(?:\.[0-9]{0,300})?\z"


def parse_number(c: Column) -> Column:
    """DOUBLE after dropping ``$``, commas and leading currency signs; NULL when not a finite number.

    Plain numbers are cast as they are. One pattern turns other text away, and one that a sign follows a digit, as in dates.
    """
    return F.when(c.rlike(_PLAIN_NUMBER), c.try_cast("double")).when(
        c.rlike(_NUMBER_CHARS) & ~c.rlike("[0-9][+-]"), _written_number(c)
    )


def _written_number(c: Column) -> Column:
    bare = F.replace(F.replace(c, F.lit("$"), F.lit("")), F.lit(","), F.lit(""))
    bare = F.ltrim(F.rtrim(bare, F.lit(BLANK_CHARS)), F.lit(BLANK_CHARS + "€£₹¥₩₽"))
    number = F.replace(F.regexp_extract(bare, _NUMBER, 0), F.lit("_"), F.lit("")).try_cast("double")
    return F.when(F.abs(number) < float("inf"), number)


def coerce_number(c: Column) -> Column:
    """``parse_number``, then once more after noise removal (``7[2]`` is 7); e-mails are not numbers."""
    # Without any digit neither reading can succeed, and without noise the second one cannot. Nor can it where a
    # letter comes first, as only letters in brackets are noise, or where a sign follows a digit and no bracket comes after.
    # Both readings drop the blanks at the ends.
    lost = rf"^{BLANK}*\p{{L}}|[0-9][+-][^\[\]()]*+\z"
    return F.when(
        c.rlike("[0-9]") & ~c.contains("@"),
        F.coalesce(parse_number(c), F.when(is_noisy(c) & ~c.rlike(lost), parse_number(clean_noise(c)))),
    )


def coerce_bool(c: Column, trimmed: bool = False) -> Column:
    word = F.lower(c if trimmed else strip(c))
    return F.when(word.isin(TRUE_WORDS), F.lit(True)).when(word.isin(FALSE_WORDS), F.lit(False))


def is_whole(x: Column) -> Column:
    """True for a DOUBLE without fraction below 10^12 (shown as an integer)."""
    return (x == F.floor(x)) & (F.abs(x) < 1e12)


def looks_like_currency(c: Column, trimmed: bool = False) -> Column:
    """A currency sign before a number, or a comma-grouped number."""
    s = c if trimmed else strip(c)
    signed = rf"^[$€£₹¥₩₽]+{BLANK}*[\d,]+\.?\d*$"
    grouped = rf"^[$€£₹¥₩₽{BLANK[1:-1]}]*\d{{1,3}}(?:,\d{{3}})+\.?\d*$"
    return _no_letter_first(c) & (s.rlike(signed) | (c.contains(",") & s.rlike(grouped)))


def _no_letter_first(c: Column) -> Column:
    """False where the first character is an ASCII letter or a mark above the digits, which one comparison tells."""
    return (c < "A") | (c >= "\x7f")


def is_numeric_like(c: Column) -> Column:
    """Text made of digits, separators, currency and percent signs only, with a digit at its head.

    Blanks may stand anywhere, so those at the ends need not be trimmed first.
    """
    blanks = BLANK[1:-1]
    return _no_letter_first(c) & c.rlike(rf"^[$€£₹{blanks}-]*+[0-9][0-9,.$€£₹%{blanks}-]*+\z")


def is_bare_small_int(c: Column) -> Column:
    return c.rlike(rf"^{BLANK}*+[0-9]{{1,3}}{BLANK}*+\z")


def is_salary(x: Column) -> Column:
    """A number in the plausible pay range (never NULL)."""
    return F.coalesce(x.between(0.0, 100_000_000.0), F.lit(False))


def detect_currency(c: Column) -> Column:
    """ISO code of the first known sign, a three-letter code in capitals, else the text in capitals."""
    s = F.upper(strip_column(c))
    found = F.when(F.coalesce(s, F.lit("")) == "", F.lit(""))
    for sign, code in CURRENCY_SIGNS.items():
        found = found.when(s.contains(sign), F.lit(code))
    return found.otherwise(s)
