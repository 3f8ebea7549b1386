"""Document cleaning, typing and extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline import functions as X
from siftline.operators.extract import extract_records
from siftline.queries import inputs as I
from siftline.queries import sql as Q
from siftline.streaming.intake import records_of

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _text(name: str, outs: dict) -> None:
    QUERIES[name] = lambda s, d: I.messy_documents(s, d).select("_row_id", *[e().alias(o) for o, (e, _) in outs.items()])
    SQL[name] = f"WITH {I.DOCUMENTS_CTE} SELECT _row_id, " + ", ".join(f"{q} AS {o}" for o, (_, q) in outs.items()) + " FROM messy"


CLEAN_TXT = Q.universal(Q.plain_quotes("replace(text, chr(13) || chr(10), chr(10))"))
_text("clean_text_txt", {"clean": (lambda: X.clean_text(F.col("text"), "txt"), CLEAN_TXT)})
_PDF = Q.sub("text", "([a-z])([A-Z])", r"\1 \2")
_PDF = Q.sub(_PDF, r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", r"\1\2")
_PDF = Q.sub(_PDF, r"\n([a-z])", r" \1")
_PDF = Q.sub(_PDF, Q.IN_LINE + "+", " ")
_PDF = Q.sub(_PDF, rf"(?m)^{Q.BLANKS}*\d+{Q.BLANKS}*$", "")
_PDF = Q.sub(_PDF, rf"(?m)^{Q.BLANKS}*(Page|PAGE){Q.BLANKS}+\d+.*$", "")
_text("clean_text_pdf", {"clean": (lambda: X.clean_text(F.col("text"), "pdf"), Q.universal(_PDF))})
# Letters beyond ASCII become word characters that RE2 knows, and are put back as one kind of mark.
_ASCII = Q.sub("text", r"[\x{c0}-\x{24f}]", "_")
_CSV = Q.sub(Q.sub(Q.sub(_ASCII, r"\bnan\b", "", "gi"), r"\bNone\b", ""), r"\bNaT\b", "")
QUERIES["clean_text_csv"] = lambda s, d: I.messy_documents(s, d).select(
    "_row_id", X.clean_text(F.regexp_replace(F.col("text"), r"[\x{c0}-\x{24f}_]+", "é"), "csv").alias("clean")
)
SQL["clean_text_csv"] = f"WITH {I.DOCUMENTS_CTE} SELECT _row_id, {Q.universal(Q.sub(_CSV, '_+', 'é'))} AS clean FROM messy"
WORDS = (
    f"cast(case when {Q.strip('text')} = '' then 0 else"
    f" length(regexp_extract_all(text, '[^\\s\\x{{a0}}]+')) end as integer)"
)
_text("word_count", {"words": (lambda: X.word_count(F.col("text")), WORDS)})
_text("sample_lines", {"sample": (lambda: X.sample_lines(F.col("text"), 1500), f"""left(case when length({Q.strip('text')}) <= 1500
 or length(string_split({Q.strip('text')}, chr(10))) <= 50 then {Q.strip('text')} else array_to_string(list_concat(list_concat(
 string_split({Q.strip('text')}, chr(10))[1:20],
 string_split({Q.strip('text')}, chr(10))[length(string_split({Q.strip('text')}, chr(10))) // 2 + 1 : length(string_split({Q.strip('text')}, chr(10))) // 2 + 10]),
 string_split({Q.strip('text')}, chr(10))[-10:]), chr(10)) end, 1500)""")})
# The shapes of amounts and dates in running text.
_MONEY = r"[$€£₹¥]\s*[\d,]+\.?\d*|\b\d{1,3}(?:,\d{3})+\.\d{2}\b"
_DATES = r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b"
QUERIES["document_type"] = lambda s, d: I.messy_documents(s, d).select("_row_id", X.document_type(F.col("text")).alias("document_type"))
SQL["document_type"] = f"""WITH {I.DOCUMENTS_CTE}, m AS (SELECT _row_id, lower({_ASCII}) AS low FROM messy),
f AS (SELECT _row_id, low, list_filter(string_split(low, chr(10)), lambda l: {Q.strip('l')} <> '') AS lines,
 length(regexp_extract_all(low, '{_MONEY}')) AS amounts, length(regexp_extract_all(low, '{_DATES}')) AS dates FROM m),
g AS (SELECT *, greatest(length(lines), 1) AS n, length(list_filter(lines, lambda l: length(string_split(l, ',')) > 2)) AS commas,
 length(list_filter(lines, lambda l: length(string_split(l, chr(9))) > 2)) AS tabs FROM f)
SELECT _row_id, case when {Q.strip('low')} = '' then 'unknown' when commas / n > 0.5 or tabs / n > 0.5 then 'tabular_data'
 when amounts >= 3 then 'financial_document' when dates >= 2 and length(lines) >= 5 then 'structured_document'
 when coalesce(list_sum(list_transform(lines, lambda l: length(l))), 0) / n > 80 and amounts <= 1 then 'narrative_document'
 else 'generic_document' end AS document_type FROM g"""

QUERIES["text_quality_score"] = lambda s, d: I.messy_documents(s, d).select(
    "_row_id", X.text_quality_score(F.col("text")).alias("quality")
)

# ---- extraction ----------------------------------------------------------------------------------

_ISO = Q.date("x")
_DATE_LIST = (
    f"list_transform(list_concat(regexp_extract_all({_ASCII}, '\\b(\\d{{4}}-\\d{{2}}-\\d{{2}})\\b', 1),"
    f" regexp_extract_all({_ASCII}, '\\b(\\d{{1,2}}[/.-]\\d{{1,2}}[/.-]\\d{{2,4}})\\b', 1)), lambda x: coalesce({_ISO}, x))"
)
_AMOUNT_LIST = (
    f"list_transform(list_filter(list_transform(regexp_extract_all({_ASCII},"
    " '(?:[$€£₹]\\s*)?(\\d{1,3}(?:,\\d{3})+(?:\\.\\d+)?|\\d+\\.\\d{2}\\b|\\b\\d{4,}\\b)', 1), lambda x: replace(x, ',', '')),"
    " lambda x: not (length(x) <= 4 and x::double = floor(x::double) and x::double between 1900 and 2100)), lambda x: x::double)"
)
# Capitalized phrases that are not names.
_NAME_LIST = (
    f"list_filter(regexp_extract_all({_ASCII}, '\\b([A-Z][a-z]+(?:[\\s\\x{{a0}}]+[A-Z][a-z]+)+)\\b', 1), lambda x: length(x) >= 4 and"
    " lower(x) not in ('total amount', 'invoice date', 'due date', 'payment method', 'grand total', 'sub total',"
    " 'bank transfer', 'credit card'))"
)


def _distinct(values: str, key: str = "x") -> str:
    """Distinct in order of first appearance."""
    keys = f"list_transform({values}, lambda x: {key})"
    return f"list_filter({values}, lambda x, i: list_position({keys}, {key}) = i)"


_LISTS = f"""{I.DOCUMENTS_CTE}, raw AS (SELECT _row_id, {_DATE_LIST} AS d0, {_AMOUNT_LIST} AS a0, {_NAME_LIST} AS n0 FROM messy),
found AS (SELECT _row_id, {_distinct('d0')} AS dates, {_distinct('a0')} AS amounts, {_distinct('n0', 'lower(x)')} AS names FROM raw)"""
QUERIES["extract_dates"] = lambda s, d: I.messy_documents(s, d).select("_row_id", F.array_join(X.extract_dates(F.col("text")), "; ").alias("dates"))
SQL["extract_dates"] = f"WITH {_LISTS} SELECT _row_id, array_to_string(dates, '; ') AS dates FROM found"
QUERIES["extract_amounts"] = lambda s, d: I.messy_documents(s, d).select(
    "_row_id", F.posexplode(X.extract_amounts(F.col("text"))).alias("place", "amount")
)
SQL["extract_amounts"] = f"""WITH {_LISTS} SELECT _row_id, unnest(amounts) AS amount,
 cast(generate_subscripts(amounts, 1) - 1 as integer) AS place FROM found"""
QUERIES["extract_names"] = lambda s, d: I.messy_documents(s, d).select("_row_id", F.array_join(X.extract_names(F.col("text")), "; ").alias("names"))
SQL["extract_names"] = f"WITH {_LISTS} SELECT _row_id, array_to_string(names, '; ') AS names FROM found"
QUERIES["extract_records"] = lambda s, d: extract_records(I.messy_documents(s, d))
_PICK = lambda l: f"coalesce({l}[i + 1], {l}[1])"
SQL["extract_records"] = f"""WITH {_LISTS}, sized AS (SELECT *, greatest(length(dates), length(amounts), length(names)) AS longest FROM found),
places AS (SELECT *, unnest(range(greatest(longest, 1))) AS i FROM sized),
picked AS (SELECT _row_id, i, longest, {_PICK('names')} AS pn, {_PICK('amounts')} AS pa, {_PICK('dates')} AS x FROM places)
SELECT _row_id, cast(i as integer) AS place, pn AS detected_name, pa AS detected_amount, x AS detected_date,
 case when longest = 0 then 0.4::double else 0.5::double end AS confidence, false AS is_anomaly, true AS is_valid_email,
 x is null or ({_ISO}) is not null AS is_valid_date, true AS is_valid_numeric FROM picked"""
QUERIES["conversation_records"] = lambda s, d: extract_records(
    I.table(s, d, "conversations").select("conv_id", "turn", "text")
).select("conv_id", "turn", "place", "detected_name", "detected_amount", "detected_date", "confidence")
QUERIES["typed_document_records"] = lambda s, d: records_of(I.messy_documents(s, d).withColumnRenamed("_row_id", "doc_id"))
