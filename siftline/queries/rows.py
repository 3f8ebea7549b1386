"""Flags, anomalies, confidence, imputation, deduplication and the whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import cells, columns as C, dedupe as D, mapping as M, profile as P, quality as Qy
from siftline.plans.final_clean import CleaningConfig, final_clean
from siftline.plans.process import process_documents, process_table
from siftline.queries import inputs as I
from siftline.queries import sql as Q
from siftline.queries.columns import NORMALIZED
from siftline.queries.texts import CLEAN_TXT, SQL as TEXT_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}
_CONTENT = [c for c in I.MESSY_ORDERS if c != "_row_id"]


def _there(c: str) -> str:
    return f"({c} is not null)" if c in ("quantity", "balance") else Q.present(c)


# ---- flags and counts ----------------------------------------------------------------------------

QUERIES["missing_ratio"] = lambda s, d: (
    lambda df: df.select("_row_id", F.round(Qy.missing_ratio(df), 6).alias("missing_ratio"))
)(I.messy_orders(s, d))
SQL["missing_ratio"] = f"""WITH {I.ORDERS_CTE} SELECT _row_id, round(({' + '.join(f'(not {_there(c)})::int' for c in _CONTENT)})
 / {len(_CONTENT)}.0::double, 6) AS missing_ratio FROM messy"""

QUERIES["refresh_flags"] = lambda s, d: Qy.refresh_flags(
    I.messy_orders(s, d, "email", "remark", "order_date", "paid"), ["email", "remark"], ["order_date"]
)
SQL["refresh_flags"] = f"""WITH {I.ORDERS_CTE} SELECT _row_id, email, remark, order_date, paid,
 not ({Q.present('email')} or {Q.present('remark')}) or {Q.email_like('email')} or {Q.email_like('remark')} AS is_valid_email,
 not ({Q.present('order_date')} and ({Q.date('order_date')}) is null) AS is_valid_date, true AS is_valid_numeric FROM messy"""


def _validation(s, d):
    df = I.messy_orders(s, d)
    return Qy.validation_summary(df, P.collect_profile(df)[1])


QUERIES["validation_summary"] = _validation
SQL["validation_summary"] = f"""WITH {I.ORDERS_CTE} SELECT count(*) FILTER ({Q.email_like('email')}) AS valid_email_count,
 count(*) FILTER ({Q.phone_like('phone')}) AS valid_phone_count,
 count(*) FILTER (coalesce({Q.numeric_like('total_price')} and ({Q.number('total_price')}) between 0 and 1e8, false))
  + count(*) FILTER (quantity between 0 and 1e8) AS valid_salary_count,
 count(*) FILTER (not {Q.present('order_date')} or ({Q.date('order_date')}) is not null) AS valid_date_count,
 count(*) FILTER ({Q.numeric_like('total_price')}) + count(quantity) AS valid_numeric_count FROM messy"""

QUERIES["filter_rows"] = lambda s, d: Qy.filter_rows(
    I.messy_orders(s, d, "email", "phone", "priority"), ["email"], "entity", "remove_row"
)
SQL["filter_rows"] = f"""WITH {I.ORDERS_CTE} SELECT _row_id, email, phone, priority FROM messy WHERE
 ({Q.present('email')} or {Q.present('phone')} or {Q.present('priority')}) and {Q.email_like('email')}"""


# ---- roles and rows ------------------------------------------------------------------------------

_MAP = {"email": ["remark", "email"], "amount_monetary": ["remark", "total_price"], "date": ["order_date"], "place": ["city", "status"]}
QUERIES["apply_field_map"] = lambda s, d: M.apply_field_map(I.messy_orders(s, d), _MAP)
_FIRST = {
    "email": f"case when {Q.present('remark')} then remark when {Q.present('email')} then email end",
    "amount_monetary": f"case when ({Q.number('remark')}) is not null then remark when ({Q.number('total_price')}) is not null then total_price end",
    "date": f"case when {Q.present('order_date')} then order_date end",
    "place": f"case when {Q.present('city')} then city when {Q.present('status')} then status end",
}
SQL["apply_field_map"] = f"WITH {I.ORDERS_CTE} SELECT _row_id, {', '.join(f'{e} AS {r}' for r, e in _FIRST.items())} FROM messy"

QUERIES["map_row_normalized"] = lambda s, d: M.map_row_normalized(
    I.messy_orders(s, d).withColumnRenamed("order_date", "Order Date").withColumnRenamed("phone", " PHONE"),
    {"when": ["order-date"], "call": ["Mobile", "phone", "order_id"], "none": ["missing"]},
)
SQL["map_row_normalized"] = f"""WITH {I.ORDERS_CTE} SELECT _row_id, nullif(order_date, '') AS "when",
 coalesce(nullif(phone, ''), nullif(order_id, '')) AS call FROM messy"""

_ROLE_MAP = {"email": ["email"], "date": ["order_date"], "amount_monetary": ["total_price"]}
_REST = ["order_id", "phone", "status", "paid", "priority", "city", "remark"]
_EMAIL_OK = lambda cs: "not (" + " or ".join(Q.email_like(c) for c in cs) + ") or " + " or ".join(Q.email_like(c) for c in cs)
_DATE_OK = lambda cs, n=0: "not (" + " or ".join(
    f"({Q.date_like(c)} and length({Q.strip(c)}) >= {n} and ({Q.date(c)}) is null)" for c in cs) + ")"
QUERIES["semantic_rows"] = lambda s, d: M.semantic_rows(I.messy_orders(s, d), _ROLE_MAP)
SQL["semantic_rows"] = f"""WITH {I.ORDERS_CTE}, r AS (SELECT *, case when {Q.present('email')} then email end AS e,
 case when {Q.present('order_date')} then order_date end AS t, {_FIRST['amount_monetary'].replace('remark', 'null::varchar')} AS a FROM messy)
SELECT _row_id, e AS email, t AS date, a AS amount_monetary, {_EMAIL_OK(['e', 't', 'a'])} AS is_valid_email,
 {_DATE_OK(['e', 't', 'a'])} AS is_valid_date, true AS is_valid_numeric, 1.0::double AS confidence, false AS is_anomaly,
 quantity::double AS quantity, {', '.join(f'{Q.smart(c)} AS {c}' for c in _REST)} FROM r"""

_COERCED = ["order_id", "email", "phone", "order_date", "city", "remark"]
QUERIES["coerce_rows"] = lambda s, d: M.coerce_rows(
    I.messy_orders(s, d, *_COERCED, "quantity").selectExpr(
        "*", "cast(_row_id % 15 as double) / 10 AS confidence", "_row_id % 9 = 0 AS is_outlier", "city AS organization"
    )
)
SQL["coerce_rows"] = f"""WITH {I.ORDERS_CTE}, c AS (SELECT _row_id, quantity::double AS quantity,
 {', '.join(f'{Q.smart(c)} AS {c}' for c in _COERCED)} FROM messy)
SELECT *, {_EMAIL_OK(_COERCED)} AS is_valid_email, {_DATE_OK(_COERCED, 6)} AS is_valid_date, true AS is_valid_numeric,
 least((_row_id % 15)::double / 10, 1.0) AS confidence, _row_id % 9 = 0 AS is_anomaly FROM c"""


# ---- anomalies, confidence, imputation -----------------------------------------------------------

_CRITICAL = ["city", "total_price"]


def _flagged(s, d):
    df = I.messy_orders(s, d, "email", "order_date", "city", "total_price", "quantity").selectExpr(
        "*", "cast(_row_id * _row_id % 1000 as double) AS load", "_row_id % 50 <> 0 AS is_valid_numeric",
        "_row_id % 60 = 1 AS is_anomaly",
    )
    return Qy.detect_anomalies(df, _CRITICAL, ["email"], ["order_date"])


_ANOMALY_CTES = f"""{I.ORDERS_CTE}, x AS (SELECT *, (_row_id * _row_id % 1000)::double AS load, _row_id % 50 <> 0 AS is_valid_numeric,
 _row_id % 60 = 1 AS prior FROM messy),
m AS (SELECT avg(quantity) AS mq, avg(load) AS ml FROM x),
flagged AS (SELECT _row_id, email, order_date, city, total_price, quantity, load, is_valid_numeric, prior, case
  when not is_valid_numeric then 'invalid_numeric'
  when {Q.present('email')} and not {Q.email_like('email')} then 'invalid_email'
  when {Q.present('order_date')} and ({Q.date('order_date')}) is null then 'invalid_date'
  when not {Q.present('city')} or not {Q.present('total_price')} then 'missing_critical'
  when (mq > 0 and quantity > 3 * mq) or (ml > 0 and load > 3 * ml) then 'outlier' end AS anomaly_reason FROM x, m)"""
QUERIES["detect_anomalies"] = lambda s, d: _flagged(s, d).select("_row_id", "is_anomaly", "anomaly_reason")
SQL["detect_anomalies"] = (
    f"WITH {_ANOMALY_CTES} SELECT _row_id, prior or anomaly_reason is not null AS is_anomaly, anomaly_reason FROM flagged"
)


def _confidence(s, d):
    df = _flagged(s, d).selectExpr("*", "_row_id % 8 <> 0 AS is_valid_email")
    return df.select("_row_id", F.round(Qy.adaptive_confidence(df, _CRITICAL, F.col("_row_id") % 2 == 0), 6).alias("confidence"))


QUERIES["adaptive_confidence"] = _confidence
SQL["adaptive_confidence"] = f"""WITH {_ANOMALY_CTES} SELECT _row_id, round(greatest(0.5, 1.0
 - case when _row_id % 8 = 0 then 0.1 else 0 end - case when not is_valid_numeric then 0.1 else 0 end
 - case when not {Q.present('city')} or not {Q.present('total_price')} then 0.2 else 0 end
 - case when prior or anomaly_reason is not null then 0.15 else 0 end
 - case when _row_id % 2 = 0 then 0.05 else 0 end)::double, 6) AS confidence FROM flagged"""


def _imputed(s, d, mode="safe"):
    df = I.messy_orders(s, d, "order_id", "total_price", "quantity", "paid")
    profile, rows = P.collect_profile(df)
    work = cells.normalize_by_type(df, rows, "transactional")
    out = Qy.impute_median(work, rows, "transactional", mode)
    return out.select("_row_id", "quantity", "total_price", F.try_element_at(C.IMPUTED, F.lit("quantity")).alias("quantity_method"),
                      F.coalesce(F.size(C.IMPUTED), F.lit(0)).alias("imputed_cells"))


QUERIES["impute_median"] = _imputed
# Quantities repeat, so they may be imputed; prices are nearly unique, so they may not.
SQL["impute_median"] = f"""WITH {I.ORDERS_CTE}, m AS (SELECT median(quantity) AS md FROM messy)
SELECT _row_id, coalesce(quantity, case when md = floor(md) then md::bigint end) AS quantity, {Q.coerced('total_price')} AS total_price,
 case when quantity is null then 'median' end AS quantity_method, (quantity is null)::int AS imputed_cells FROM messy, m"""

QUERIES["fill_placeholders"] = lambda s, d: Qy.fill_placeholders(
    I.messy_orders(s, d, "email", "city", "order_id"), ["email", "city"], "unknown", "text_placeholder"
).select("_row_id", "email", "city", "order_id", F.array_join(F.map_keys(C.IMPUTED), "; ").alias("placed"))
SQL["fill_placeholders"] = f"""WITH {I.ORDERS_CTE} SELECT _row_id, case when {Q.present('email')} then email else 'unknown' end AS email,
 case when {Q.present('city')} then city else 'unknown' end AS city, order_id,
 case when not {Q.present('email')} and not {Q.present('city')} then 'email; city' when not {Q.present('email')} then 'email'
 when not {Q.present('city')} then 'city' end AS placed FROM messy"""

QUERIES["fill_safe_defaults"] = lambda s, d: Qy.fill_safe_defaults(
    I.messy_orders(s, d, "city", "quantity").selectExpr("*", "case when _row_id % 3 = 0 then null else _row_id % 2 = 0 end AS gift"),
    ["gift"], "entity",
)
SQL["fill_safe_defaults"] = f"""WITH {I.ORDERS_CTE} SELECT _row_id, city, quantity,
 coalesce(case when _row_id % 3 = 0 then null else _row_id % 2 = 0 end, false) AS gift FROM messy"""

QUERIES["quality_score"] = lambda s, d: (
    Qy.null_rate(I.messy_orders(s, d, "city", "email")).join(
        cells.normalization_counts(*_profiled(I.messy_orders(s, d, "city", "email")))
    ).join(I.messy_orders(s, d, "city").agg(F.count("*").alias("n"))).select(
        Qy.quality_score(F.col("null_rate"), F.col("n"), F.col("n") * 0.9, F.col("changed_cells"), F.lit(2)).alias("quality_score")
    )
)


def _profiled(df):
    profile, rows = P.collect_profile(df)
    return df, rows, P.dataset_type(profile).first()[0]


_CHANGED = " + ".join(
    f"(case when {Q.present(c)} and ({NORMALIZED[c]}) is distinct from {c} then 1 else 0 end)" for c in ("city", "email")
)
SQL["quality_score"] = f"""WITH {I.ORDERS_CTE}, t AS (SELECT count(*) AS n, sum({_CHANGED}) AS changed,
 round_even(sum((not {Q.present('city')})::int + (not {Q.present('email')})::int) / (count(*) * 2), 6) AS miss FROM messy)
SELECT round_even(1.0 - least(miss * 0.5, 0.25) - least(0.1::double * 0.3, 0.15) - least(changed / (n * 2) * 0.5, 0.2), 4)::double AS quality_score FROM t"""


# ---- deduplication -------------------------------------------------------------------------------


def _copies(s, d):
    """Customers and an altered copy of every second one, all under the first hundred names."""
    a = I.messy_customers(s, d, "customer_name", "contact_email", "segment", "confidence")
    b = a.selectExpr(
        "_row_id + 10000000 AS _row_id", "lower(customer_name) AS customer_name", "contact_email",
        "case when _row_id % 2 = 0 then ' ' || segment else segment || 'x' end AS segment", "1.0 - confidence AS confidence",
    )
    c = a.selectExpr("_row_id + 20000000 AS _row_id", "customer_name", "contact_email", "segment", "confidence")
    return a.unionByName(b).unionByName(c)


_COPIES_CTE = f"""{I.CUSTOMERS_CTE}, copies AS (SELECT _row_id, customer_name, contact_email, segment, confidence FROM messy
 UNION ALL SELECT _row_id + 10000000, lower(customer_name), contact_email,
  case when _row_id % 2 = 0 then ' ' || segment else segment || 'x' end, 1.0 - confidence FROM messy
 UNION ALL SELECT _row_id + 20000000, customer_name, contact_email, segment, confidence FROM messy)"""
QUERIES["dedupe_content"] = lambda s, d: D.dedupe_content(_copies(s, d))
SQL["dedupe_content"] = f"""WITH {_COPIES_CTE} SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY
 lower(trim(customer_name)), coalesce(lower(trim(contact_email)), ''), lower(trim(segment)) ORDER BY _row_id) AS k FROM copies) WHERE k = 1"""
QUERIES["dedupe_exact"] = lambda s, d: D.dedupe_exact(_copies(s, d))
SQL["dedupe_exact"] = f"""WITH {_COPIES_CTE} SELECT min(_row_id) AS _row_id, customer_name, contact_email, segment, confidence
 FROM copies GROUP BY 2, 3, 4, 5"""
QUERIES["dedupe_by_keys"] = lambda s, d: D.dedupe_by_keys(_copies(s, d), ["contact_email", "segment"])
SQL["dedupe_by_keys"] = f"""WITH {_COPIES_CTE} SELECT place AS _row_id, customer_name, contact_email, segment, confidence FROM (SELECT *,
 row_number() OVER (PARTITION BY a, b ORDER BY confidence DESC, _row_id) AS k, min(_row_id) OVER (PARTITION BY a, b) AS place
 FROM (SELECT *, coalesce(lower(trim(contact_email)), 'none') AS a, lower(trim(segment)) AS b FROM copies)) WHERE k = 1"""


def _keys(s, d):
    rows = P.collect_profile(I.messy_orders(s, d))[1]
    lineitem = I.table(s, d, "lineitem").select("l_returnflag", "l_linestatus", "l_shipdate")
    return s.createDataFrame(
        [("orders", "; ".join(P.dedup_keys(rows))), ("lineitem", "; ".join(P.dedup_keys(P.collect_profile(lineitem)[1])))],
        "source string, dedup_keys string",
    )


QUERIES["dedup_keys"] = _keys

# ---- whole jobs ----------------------------------------------------------------------------------


def _final(s, d):
    return final_clean(I.messy_orders(s, d)).rows


QUERIES["final_clean"] = lambda s, d: _final(s, d).withColumn(
    C.IMPUTED, F.array_join(F.transform(F.map_entries(C.IMPUTED), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
)
# Transactional; keyed by order_id, which is unique, by the price and the date; quantities are imputed.
SQL["final_clean"] = f"""WITH {I.ORDERS_CTE}, m AS (SELECT median(quantity)::bigint AS md FROM messy)
SELECT _row_id, {', '.join(f'{e} AS {c}' for c, e in NORMALIZED.items() if c != 'quantity')}, coalesce(quantity, md) AS quantity,
 case when quantity is null then 'quantity=median' end AS __imputed__ FROM messy, m"""


def _final_stats(s, d):
    stats = final_clean(I.messy_orders(s, d), CleaningConfig(mode="strict", text_placeholder="unknown")).stats
    return stats.select(
        "rows_in", "rows_out", "clean_mode", "email_invalid_strategy", "dataset_type", "invalid_values_replaced",
        "missing_values_filled", "low_quality_removed", "duplicate_rows_removed",
        F.array_join("critical_fields_detected", "; ").alias("critical"), F.array_join("dedup_keys", "; ").alias("keys"),
        F.array_join("field_types.numeric", "; ").alias("numeric"), F.array_join("field_types.text", "; ").alias("text"),
        "cleaning_summary.*",
    )


QUERIES["final_clean_stats"] = _final_stats
_NULLED = " + ".join(
    f"(case when {Q.present(c)} and ({e}) is null then 1 else 0 end)" for c, e in NORMALIZED.items() if c != "quantity"
)
_ALL_CHANGED = " + ".join(
    f"(case when {Q.present(c)} then 1 else 0 end)" if c in ("total_price", "paid")
    else f"(case when {Q.present(c)} and ({e}) is distinct from {c} then 1 else 0 end)"
    for c, e in NORMALIZED.items() if c != "quantity"
)
_MISSING_AFTER = " + ".join(
    f"(case when nullif({f'({e})' if c not in ('total_price', 'paid') else f'cast(({e}) as varchar)'}, '') is null then 1 else 0 end)"
    for c, e in NORMALIZED.items() if c != "quantity"
)
SQL["final_clean_stats"] = f"""WITH {I.ORDERS_CTE}, t AS (SELECT count(*) AS n, sum({_ALL_CHANGED}) AS changed, sum({_NULLED}) AS nulled,
 sum({' + '.join(f'(not {_there(c)})::int' for c in _CONTENT)}) AS before_, sum({_MISSING_AFTER}) AS after_,
 count(*) FILTER (quantity is null) AS filled FROM messy),
u AS (SELECT *, round_even(before_ / (n * 11), 6) AS rb, round_even(after_ / (n * 11), 6) AS ra FROM t)
SELECT n AS rows_in, n AS rows_out, 'strict' AS clean_mode, 'none' AS email_invalid_strategy, 'transactional' AS dataset_type,
 nulled > 0 AS invalid_values_replaced, true AS missing_values_filled, 0::bigint AS low_quality_removed, 0::bigint AS duplicate_rows_removed,
 'city; email; order_date; order_id; paid; phone; priority; quantity; remark; status; total_price' AS critical,
 'order_date; order_id; total_price' AS keys, 'quantity; total_price' AS numeric, 'city; priority; remark; status' AS text,
 0::bigint AS rows_removed, filled AS values_filled, changed::bigint AS invalid_values_fixed, rb AS null_rate_before, ra AS null_rate_after,
 11::int AS schema_field_count, round_even(1.0 - least(ra * 0.5, 0.25) - least(changed / (n * 11) * 0.5, 0.2), 4)::double AS quality_score FROM u"""


def _raw_orders(s, d):
    """All cells as text, as a delimited file would give them."""
    df = I.messy_orders(s, d)
    return df.select("_row_id", *[F.col(c).cast("string") for c in _CONTENT])


QUERIES["process_table_validated"] = lambda s, d: process_table(_raw_orders(s, d)).validated.select(
    "_row_id", "email", "date", "amount_monetary", "city", "confidence", "is_anomaly"
)
QUERIES["process_table_cleaned"] = lambda s, d: process_table(_raw_orders(s, d)).cleaned.rows.drop(C.IMPUTED)
QUERIES["process_table_analytics"] = lambda s, d: process_table(_raw_orders(s, d)).analytics.drop("position")
QUERIES["process_table_validation"] = lambda s, d: process_table(_raw_orders(s, d)).validation
QUERIES["process_documents"] = lambda s, d: process_documents(I.messy_documents(s, d)).cleaned.rows.drop(C.IMPUTED)
QUERIES["process_documents_rows"] = lambda s, d: process_documents(I.messy_documents(s, d)).validated.select(
    "_document", "detected_name", "detected_amount", F.col("detected_date").cast("string").alias("detected_date"), "is_valid_numeric"
)
# A document keeps its different rows. Dates count as numbers that do not parse.
_CLEANED = f"{I.DOCUMENTS_CTE.replace('messy', 'dirty', 1)}, messy AS (SELECT _row_id, {CLEAN_TXT} AS text FROM dirty)"
SQL["process_documents_rows"] = f"""WITH found AS ({TEXT_SQL['extract_records'].replace(I.DOCUMENTS_CTE, _CLEANED, 1)}),
first AS (SELECT *, row_number() OVER (PARTITION BY _row_id, lower(detected_name), detected_amount, detected_date ORDER BY place) AS k FROM found)
SELECT _row_id AS _document, detected_name, detected_amount, detected_date,
 not coalesce({Q.numeric_like('detected_date')} and {Q.number('detected_date')} is null, false) AS is_valid_numeric FROM first WHERE k = 1"""
