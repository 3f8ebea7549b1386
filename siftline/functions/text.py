"""Whitespace, noise removal and casing of text values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "BLANK", "BLANK_CHARS", "BLANK_IN_LINE", "WORD_CHAR", "clean_cell", "clean_name", "clean_noise",
    "clean_text", "collapse_blanks", "flatten_newlines", "is_noisy", "nonblank", "preprocess_markdown_links",
    "present", "strip", "strip_column", "strip_unicode_noise", "text_quality_score", "title_case", "word_count",
]

# Unicode blanks as the value rules understand them. Java's \s is ASCII only and (?U) is slow, so the
# class is spelled out; BLANK_CHARS is the same set for btrim.
_BLANK_BODY = r"\t\x0b\f\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK = r"[\n" + _BLANK_BODY + "]"
BLANK_IN_LINE = "[" + _BLANK_BODY + "]"
BLANK_CHARS = (
    "\n\t\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WORD_CHAR = r"[\p{L}\p{N}_]"

# Zero-width, bidirectional, BOM and soft-hyphen characters that are dropped.
INVISIBLE_CHARS = (
    "\u200b\u200c\u200d\u200e\u200f"
    "\u202a\u202b\u202c\u202d\u202e"
    "\u2060\u2061\u2062\u2063\u2064"
    "\ufeff\u00ad"
)

# Runs that count as garbage and become one space.
GARBAGE = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\ufffd]|([_*=-])\1{2,}|\.{4,}"

# Boilerplate phrases removed from text, in order of removal.
BOILERPLATE = [
    r"this page intentionally left blank",
    r"confidential and proprietary",
    r"all rights reserved",
    r"printed on",
    r"generated by",
    r"powered by",
    r"watermark",
    r"draft copy",
    r"do not distribute",
    r"page \d+ of \d+",
]


def strip(c: Column) -> Column:
    """Trim every kind of blank from both ends."""
    return F.btrim(c, F.lit(BLANK_CHARS))


def strip_column(c: Column) -> Column:
    """``strip`` of a column as it stands: trimming goes through a text character by character, and is left out where the
    first and the last are visible ASCII. ``c`` is written out several times, so it should not be a rule of its own."""
    # The first character is told by comparing, without taking it out.
    visible = (c >= "!") & (c < "\x7f") & F.substring(c, -1, 1).between("!", "~")
    return F.when(visible, c).otherwise(strip(c))


def _unseen(blanks: str) -> str:
    """A class of blanks that turns visible ASCII away first: the ranges of a class are looked through one by one."""
    return f"[[^!-~]&&{blanks}]"


def collapse_blanks(c: Column) -> Column:
    """Trim, and turn inner runs of blanks into one space."""
    return F.regexp_replace(strip(c), _unseen(BLANK) + "+", " ")


def present(c: Column) -> Column:
    """True for text that is neither NULL nor blank (never NULL itself).

    A first character from ``!`` to ``~`` is seen by comparing; only other text is trimmed.
    """
    return F.coalesce(((c >= "!") & (c < "\x7f")) | (strip(c) != ""), F.lit(False))


def nonblank(c: Column) -> Column:
    """The trimmed text, NULL when blank."""
    return F.nullif(strip(c), F.lit(""))


def bound(c: Column, f) -> Column:
    """``f(c)`` with ``c`` computed once, however often ``f`` uses it.

    Spark writes an expression out again at every use; rules that look at their input several times and feed one another
    would grow by their product, beyond what can be compiled.
    """
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _where_not_ascii(c: Column, changed: Column) -> Column:
    """Character tables are only consulted for text with more bytes than characters."""
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(changed)


def strip_unicode_noise(c: Column) -> Column:
    """Drop invisible characters; a no-break space becomes a space."""
    return _where_not_ascii(c, F.translate(c, "\u00a0" + INVISIBLE_CHARS, " "))


def _plain_quotes(c: Column) -> Column:
    """Smart quotes and dashes to ASCII."""
    plain = F.translate(c, "\u2019\u201c\u201d\u2013", "'\"\"-")
    return _where_not_ascii(c, F.replace(plain, F.lit("\u2014"), F.lit("--")))


def _drop_boilerplate(c: Column) -> Column:
    """Remove the phrases one after the other, only where any of them occurs."""

    def drop(t: Column) -> Column:
        dropped = t
        for phrase in BOILERPLATE:
            dropped = F.regexp_replace(dropped, "(?i)" + phrase, "")
        return F.when(_boilerplate(t), dropped).otherwise(t)

    return bound(c, drop)


def _boilerplate(c: Column) -> Column:
    """Whether a phrase occurs; but for the one with numbers they are looked for as they are, in lower case."""
    plain, numbered = [p for p in BOILERPLATE if "\\" not in p], [p for p in BOILERPLATE if "\\" in p]

    def occurs(low: Column) -> Column:
        found = low.rlike("|".join(numbered))
        for phrase in plain:
            found = low.contains(phrase) | found
        return found

    return bound(F.lower(c), occurs)


# Short ASCII cells may hold no phrase.
_SHORTEST = 9


# What may be garbage, and for cells that are long enough a part of every phrase, each told from other text by one character.
_ODD = r"[^ -~]|[_*=-]{3}|\.{4}"
_ODD_OR_PHRASE = _ODD + "|[pPrR](?i:age |ropri|owered |ights |inted |ated |mark|aft |ibute)"


def _easy(c: Column) -> Column:
    """Printable ASCII that holds no garbage and no phrase: the cleaning only joins spaces. Some other cells are sent the
    long way, too, which is right for all."""
    return ~F.when(F.octet_length(c) < _SHORTEST, c.rlike(_ODD)).otherwise(c.rlike(_ODD_OR_PHRASE))


def _squeezed(c: Column) -> Column:
    """The trimmed cell with single spaces, NULL when blank; for cells whose blanks are spaces."""
    single = F.when(c.contains("  "), F.regexp_replace(c, " {2,}", " ")).otherwise(c)
    return F.when(F.trim(c) != "", F.trim(single))


# ASCII words with one mark or space between them: nothing that the cleaning rules look for, but for phrases.
PLAIN = r"^[A-Za-z0-9@$+/'#&%]++(?:[ ._,:;-][A-Za-z0-9@$+/'#&%]++)*+\z"


def clean_cell(c: Column) -> Column:
    """Heavy cleaning of one table cell; blank results become NULL.

    Most cells only need their spaces joined; the steps of the others are computed once each.
    """
    t = bound(bound(strip(c), strip_unicode_noise), _plain_quotes)
    t = F.replace(t, F.lit("\x00"), F.lit(""))
    t = _drop_boilerplate(F.regexp_replace(t, GARBAGE, " "))
    cleaned = bound(strip(F.regexp_replace(t, _unseen(BLANK_IN_LINE) + "+", " ")), lambda v: F.when(v != "", v))
    return F.when(c.isNotNull(), F.when(_easy(c), _squeezed(c)).otherwise(cleaned))


def flatten_newlines(c: Column) -> Column:
    """CRLF and lone CR to LF."""
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def _clean_universal(c: Column) -> Column:
    t = _drop_boilerplate(F.regexp_replace(c, GARBAGE, " "))
    t = F.regexp_replace(flatten_newlines(t), r"\n{3,}", "\n\n")
    # After collapsing, a line has at most one blank at either end.
    t = F.regexp_replace(t, BLANK_IN_LINE + "+", " ")
    t = F.replace(F.replace(t, F.lit("\n "), F.lit("\n")), F.lit(" \n"), F.lit("\n"))
    return strip(t)


def _before_txt(c: Column) -> Column:
    t = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\x00"), F.lit(""))
    return _plain_quotes(t)


def _before_pdf(c: Column) -> Column:
    t = F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2")
    # The place of the mark is seen before the character in front of it is judged.
    t = F.regexp_replace(t, f"(?s)(?=.-\n)({WORD_CHAR})-\n({WORD_CHAR})", "$1$2")
    t = F.regexp_replace(t, "\n([a-z])", " $1")
    t = F.regexp_replace(t, BLANK_IN_LINE + "+", " ")
    t = F.regexp_replace(t, rf"(?md)^{BLANK}*\d+{BLANK}*$", "")
    return F.regexp_replace(t, rf"(?md)^{BLANK}*(Page|PAGE){BLANK}+\d+.*$", "")


def _before_csv(c: Column) -> Column:
    word = rf"(?<!{WORD_CHAR})(?:(?i:nan)|None|NaT)(?!{WORD_CHAR})"
    return F.regexp_replace(c, word, "")


_BEFORE = {"txt": _before_txt, "pdf": _before_pdf, "csv": _before_csv}


def clean_text(c: Column, kind: str = "txt") -> Column:
    """Clean a whole document that came from a ``txt``, ``pdf`` or ``csv`` file."""
    return _clean_universal(_BEFORE[kind](c))


def is_noisy(c: Column) -> Column:
    """Whether ``clean_noise`` can change more than blanks."""
    return c.rlike(r"[\[(†‡*^|¦}{~`]|[!?.,;:]{3}")


def clean_noise(c: Column) -> Column:
    """Drop ``[..]``, ``(..)``, citation marks and OCR runs; cut repeated punctuation; collapse blanks."""
    t = F.regexp_replace(c, r"(?d)\[.*?\]", "")
    t = F.regexp_replace(t, r"(?d)\(.*?\)", "")
    t = F.regexp_replace(t, r"[†‡*^]+", "")
    t = F.regexp_replace(t, r"([!?.,;:]){3,}", "$1")
    t = F.regexp_replace(t, r"[|¦}{~`]{2,}", "")
    return F.when(c.rlike(PLAIN), c).otherwise(collapse_blanks(F.when(is_noisy(c), t).otherwise(c)))


def clean_name(c: Column) -> Column:
    """Trimmed, collapsed; NULL when blank."""
    return F.nullif(collapse_blanks(c), F.lit(""))


def title_case(c: Column) -> Column:
    """Capitalize every run of letters (``o'neil 3rd`` gives ``O'Neil 3Rd``)."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    exact = F.array_join(F.transform(runs, lambda run: F.initcap(run)), "")
    # initcap restarts after blanks only, which is enough for plain words; other ASCII words get a blank, with a mark to
    # find it again, before each letter that begins a run.
    parted = F.regexp_replace(c, "(?<=[^A-Za-z \\x00])(?=[A-Za-z])", "\x00 ")
    ascii_only = (F.octet_length(c) == F.length(c)) & ~c.contains("\x00")
    return (
        F.when(c.rlike(r"^[\p{L} ]*$"), F.initcap(c))
        .when(ascii_only, F.replace(F.initcap(parted), F.lit("\x00 "), F.lit("")))
        .otherwise(exact)
    )


def preprocess_markdown_links(c: Column) -> Column:
    """``[label](mailto:a@b.c)`` becomes the address (or the label); LF newlines; trimmed."""
    link = rf"(?i)\[([^\]]*)\]\({BLANK}*mailto:([^)]+)\)"
    blank_address = rf"(?i)\[{BLANK}*([^\]]*?){BLANK}*\]\({BLANK}*mailto:{BLANK}+\)"
    t = F.regexp_replace(flatten_newlines(c), blank_address, "$1")
    padded = rf"(?i)\[([^\]]*)\]\({BLANK}*mailto:{BLANK}*([^)]*?){BLANK}*\)"
    return strip(F.when(t.rlike(link), F.regexp_replace(t, padded, "$2")).otherwise(t))


def word_count(c: Column) -> Column:
    """Number of blank-separated words."""
    trimmed = strip(c)
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, BLANK + "+")))


def text_quality_score(c: Column) -> Column:
    """1.0 minus penalties for control characters, shouted words and repeated characters."""
    size = F.length(c).cast("double")
    control = F.regexp_count(c, F.lit(r"[\x00-\x1f\x7f-\x9f]"))
    repeats = F.regexp_count(c, F.lit(r"(?d)(.)\1{4,}"))
    not_in_word = rf"(?<!{WORD_CHAR})%s(?!{WORD_CHAR})"
    caps = F.regexp_count(c, F.lit(not_in_word % "[A-Z]{4,}"))
    words = F.regexp_count(c, F.lit(not_in_word % "[a-zA-Z]{2,}"))
    score = (
        F.lit(1.0)
        - F.least(control / size * 10, F.lit(0.3))
        - F.least(caps / F.greatest(words, F.lit(1)) * 0.2, F.lit(0.2))
        - F.least(repeats / size * 5, F.lit(0.2))
    )
    return F.when(F.coalesce(size, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(
        F.bround(F.greatest(score, F.lit(0.0)), 2)
    )
