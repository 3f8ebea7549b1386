"""Names, labels, cities, statuses and payment methods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.text import BLANK, WORD_CHAR, clean_name, strip, strip_column, title_case

__all__ = [
    "field_name", "is_payment_method", "normalize_city", "normalize_field_name", "normalize_label",
    "normalize_payment", "normalize_status",
]

# Other spellings of the same city.
CITY_ALIASES = {
    "bengaluru": "Bangalore",
    "bangalore": "Bangalore",
    "gurgaon": "Gurugram",
    "gurugram": "Gurugram",
    "bombay": "Mumbai",
    "calcutta": "Kolkata",
}

# Vocabulary of payment channels, as whole words.
PAYMENT_WORDS = [
    r"(?:credit|debit)\s*card",
    r"(?:visa|mastercard|amex|discover)",
    r"master\s*card",
    r"american\s*express",
    r"(?:paypal|pay\s*pal)",
    r"(?:stripe|razorpay|square)",
    r"(?:apple|google|samsung)\s*pay",
    r"(?:venmo|zelle|cashapp)",
    r"upi",
    r"(?:cash|cheque|check)",
    r"(?:bank|wire)\s*transfer",
    r"(?:net\s*banking|e-?wallet)",
]


def normalize_field_name(c: Column) -> Column:
    """Trimmed lower case with runs of blanks, ``_`` and ``-`` as one ``_``; none at the ends."""
    low = F.translate(F.lower(strip(c)), "\ufeff", "")
    joined = F.regexp_replace(low, f"(?:{BLANK}|[_-])+", "_")
    return F.btrim(joined, F.lit("_"))


def field_name(name: str) -> str:
    """``normalize_field_name`` for a column name held by the driver."""
    low = name.strip().lower().replace("\ufeff", "")
    return "_".join(part for part in low.replace("-", " ").replace("_", " ").split() if part)


def normalize_city(c: Column) -> Column:
    """Known aliases, else title case."""
    name = clean_name(c)
    aliases = F.create_map(*[F.lit(word) for pair in CITY_ALIASES.items() for word in pair])
    return F.coalesce(F.try_element_at(aliases, F.lower(name)), title_case(name))


def normalize_status(c: Column) -> Column:
    """``in_progress`` becomes ``In Progress``."""
    words = F.filter(F.split(clean_name(c), f"(?:{BLANK}|[_-])+"), lambda w: w != "")
    shown = F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))),
        " ",
    )
    return F.nullif(shown, F.lit(""))


def normalize_payment(c: Column) -> Column:
    return F.coalesce(title_case(strip(c)), F.lit(""))


def normalize_label(c: Column) -> Column:
    """``Invoice Total`` becomes ``invoice_total``."""
    joined = F.regexp_replace(F.lower(strip_column(c)), "[^a-z0-9]+", "_")
    return F.coalesce(F.btrim(joined, F.lit("_")), F.lit(""))


def is_payment_method(c: Column) -> Column:
    """At most 40 characters holding one of the payment channel words."""
    s = F.lower(strip_column(c))
    vocabulary = "|".join(word.replace(r"\s", BLANK) for word in PAYMENT_WORDS)
    found = s.rlike(rf"(?<!{WORD_CHAR})(?:{vocabulary})(?!{WORD_CHAR})")
    return F.coalesce(F.length(s).between(1, 40) & found, F.lit(False))
