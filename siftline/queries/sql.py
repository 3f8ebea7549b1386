"""SQL fragments that state the value rules once more, for the SQL twins only."""

from __future__ import annotations

BLANKS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
IN_LINE = r"[ \t\r\f\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# The shape of an address.
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
# The date formats, in order of trial.
FORMATS = (
    "['%Y-%m-%d','%d-%m-%Y','%m/%d/%Y','%d/%m/%Y','%Y/%m/%d','%d %B %Y','%B %d, %Y','%d %b %Y','%b %d, %Y']"
)


def sub(x: str, pattern: str, new: str, flags: str = "g") -> str:
    return f"regexp_replace({x}, '{pattern}', '{new}', '{flags}')"


def strip(x: str) -> str:
    return sub(x, rf"^{BLANKS}+|{BLANKS}+$", "")


def collapse(x: str) -> str:
    return sub(strip(x), BLANKS + "+", " ")


def nonblank(x: str) -> str:
    return f"nullif({strip(x)}, '')"


def present(x: str) -> str:
    return f"coalesce({strip(x)} <> '', false)"


def noise(x: str) -> str:
    t = sub(x, r"\[.*?\]", "")
    t = sub(t, r"\(.*?\)", "")
    t = sub(t, r"[†‡*^]+", "")
    t = sub(t, r"([!?.,;:]){3,}", r"\1")
    t = sub(t, r"[|¦}{~`]{2,}", "")
    return collapse(t)


def number(x: str) -> str:
    bare = sub(strip(f"replace(replace({x}, '$', ''), ',', '')"), rf"^(?:{BLANKS}|[€£₹¥₩₽])+", "")
    return (
        f"case when regexp_full_match({bare}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?')"
        f" then try_cast({bare} as double) end"
    )


def coerced(x: str) -> str:
    return f"case when contains({x}, '@') then null else coalesce({number(strip(x))}, {number(noise(strip(x)))}) end"


def boolean(x: str) -> str:
    return (
        f"case when lower({strip(x)}) in ('true','t','yes','y','1') then true"
        f" when lower({strip(x)}) in ('false','f','no','n','0') then false end"
    )


def date(x: str) -> str:
    parsed = f"try_strptime({strip(x)}, {FORMATS})"
    return f"case when year({parsed}) between 1900 and 2100 then strftime({parsed}, '%Y-%m-%d') end"


def date_like(x: str) -> str:
    s = strip(x)
    shapes = (
        r"^\d{4}-\d{2}-\d{2}$|^\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}$|^\d{1,2}\s+[\p{L}\p{N}_]+\s+\d{4}$"
        r"|^[\p{L}\p{N}_]+\s+\d{1,2},?\s+\d{4}$"
    )
    return (
        f"coalesce(length({s}) between 4 and 40 and not regexp_matches({s}, '^\\d+$')"
        f" and (regexp_matches({s}, '{shapes}') or {date(x)} is not null), false)"
    )


def email_like(x: str) -> str:
    return f"coalesce(regexp_matches({strip(x)}, '{EMAIL}'), false)"


def phone(x: str) -> str:
    return f"nullif({collapse(x)}, '')"


def digits(x: str) -> str:
    return sub(x, r"\D+", "")


def phone_like(x: str) -> str:
    return f"coalesce(length({digits(phone(x))}) between 10 and 15, false)"


def currency_like(x: str) -> str:
    s = strip(x)
    return (
        f"coalesce(regexp_matches({s}, '^[$€£₹¥₩₽]+\\s*[\\d,]+\\.?\\d*$')"
        f" or regexp_matches({s}, '^[\\s$€£₹¥₩₽]*\\d{{1,3}}(,\\d{{3}})+\\.?\\d*$'), false)"
    )


def numeric_like(x: str) -> str:
    return f"coalesce(regexp_full_match({strip(x)}, '[\\s$€£₹-]*\\d[\\d,.\\s$€£₹%-]*'), false)"


def title(x: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({x}, '\\p{{L}}+|\\P{{L}}+'),"
        " lambda w: upper(w[1]) || lower(w[2:])), '')"
    )


def field(x: str) -> str:
    return sub(sub(f"lower({strip(x)})", rf"(?:{BLANKS}|[_-])+", "_"), "^_+|_+$", "")


# Runs that count as garbage.
GARBAGE = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]|\x{fffd}|_{3,}|-{3,}|\*{3,}|={3,}|\.{4,}"
# Boilerplate phrases, in order of removal.
PHRASES = [
    "this page intentionally left blank", "confidential and proprietary", "all rights reserved", "printed on",
    "generated by", "powered by", "watermark", "draft copy", "do not distribute", r"page \d+ of \d+",
]


def plain_quotes(x: str) -> str:
    for old, new in (("’", "''"), ("“", '"'), ("”", '"'), ("–", "-"), ("—", "--")):
        x = f"replace({x}, '{old}', '{new}')"
    return x


def without_garbage(x: str) -> str:
    t = sub(x, GARBAGE, " ")
    for phrase in PHRASES:
        t = sub(t, phrase, "", "gi")
    return t


def unicode_noise(x: str) -> str:
    t = sub(x, r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{feff}\x{ad}]+", "")
    return sub(t, r"\x{a0}", " ")


def cell(x: str) -> str:
    t = without_garbage(plain_quotes(unicode_noise(strip(x))))
    return nonblank(sub(t, IN_LINE + "+", " "))


def universal(x: str) -> str:
    t = without_garbage(x)
    t = f"replace(replace({t}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    t = sub(t, "\\n{3,}", "\n\n")
    line = strip(sub("l", IN_LINE + "+", " "))
    return strip(f"array_to_string(list_transform(string_split({t}, chr(10)), lambda l: {line}), chr(10))")


def smart(x: str) -> str:
    s = strip(x)
    return (
        f"case when {email_like(x)} then lower({s}) when {phone_like(x)} then {phone(x)}"
        f" when length({s}) >= 6 and {date_like(x)} and {date(x)} is not null then {date(x)}"
        f" else nullif({s}, '') end"
    )
