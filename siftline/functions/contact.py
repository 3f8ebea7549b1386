"""E-mail addresses and phone numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.functions.text import collapse_blanks, nonblank, strip

__all__ = [
    "is_valid_email", "looks_like_email", "looks_like_phone", "normalize_email", "normalize_phone",
    "phone_digits", "phone_fingerprint",
]

# Fixed value: the address shape that counts as valid.
# The shape of an address.
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"


# 10 to 15 digits among anything else, read once from left to right.
_PHONE = r"^[^0-9]*+(?:[0-9][^0-9]*+){10,15}+\z"


def looks_like_email(c: Column, trimmed: bool = False) -> Column:
    """``trimmed`` says that the text has no blanks at its ends, so they are not looked for again."""
    return c.contains("@") & (c if trimmed else strip(c)).rlike(EMAIL)


def normalize_email(c: Column) -> Column:
    """Trimmed, lower-cased; NULL when blank."""
    return F.lower(nonblank(c))


def is_valid_email(c: Column) -> Column:
    """Never NULL: missing addresses are not valid."""
    return F.coalesce(c.contains("@") & normalize_email(c).rlike(EMAIL), F.lit(False))


def normalize_phone(c: Column) -> Column:
    """Display form: blanks collapsed; NULL when blank."""
    return F.nullif(collapse_blanks(c), F.lit(""))


def phone_digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D+", "")


def looks_like_phone(c: Column) -> Column:
    """10 to 15 digits in the display form, which has the digits of the text."""
    return (F.octet_length(c) >= 10) & c.rlike(_PHONE)


def phone_fingerprint(c: Column) -> Column:
    """The last ten digits, or all of them when there are fewer."""
    return F.coalesce(F.right(phone_digits(c), F.lit(10)), F.lit(""))
