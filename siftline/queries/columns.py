"""Schema-level operators and whole-table cell cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline import functions as X
from siftline.operators import cells, columns as C, ranks
from siftline.operators.profile import collect_profile, dataset_type
from siftline.queries import inputs as I
from siftline.queries import sql as Q
from siftline.sources.delimited import route_files

QUERIES: dict = {}
SQL: dict[str, str] = {}

_PATH = (
    "'/in/' || cast(page_id as string) || case page_id % 6 when 0 then '.csv' when 1 then '.TXT' when 2 then '.pdf'"
    " when 3 then '.tar.gz' when 4 then '.CSV ' else '' end"
)
QUERIES["route_files"] = lambda s, d: route_files(I.table(s, d, "pages").selectExpr(f"{_PATH} AS path"))
SQL["route_files"] = f"""
WITH p AS (SELECT {_PATH} AS path FROM pages),
e AS (SELECT path, lower(coalesce(regexp_extract(trim(path), '[^./]\\.([^./]+)$', 1), '')) AS extension FROM p)
SELECT path, extension, case extension when 'csv' then 'structured' when 'txt' then 'unstructured'
  when 'pdf' then 'unstructured' else 'unknown' end AS kind FROM e
"""


def _normalize_headers(s, d):
    raw = I.messy_orders(s, d, "order_id", "city", "paid")
    named = raw.select(
        "_row_id", F.col("order_id").alias(" Order  ID "), F.col("city").alias("Ship-City_"),
        F.col("paid").alias("order_id"), F.col("paid").alias("__"),
    )
    return C.normalize_headers(named)


QUERIES["normalize_headers"] = _normalize_headers
SQL["normalize_headers"] = f"WITH {I.ORDERS_CTE} SELECT _row_id, paid AS order_id, city AS ship_city FROM messy"

QUERIES["drop_blank_rows"] = lambda s, d: C.drop_blank_rows(I.messy_orders(s, d, "phone", "priority"))
SQL["drop_blank_rows"] = (
    f"WITH {I.ORDERS_CTE} SELECT _row_id, phone, priority FROM messy WHERE {Q.present('phone')} OR {Q.present('priority')}"
)

QUERIES["cap_rows"] = lambda s, d: ranks.cap_rows(I.messy_orders(s, d, "order_id", "city"), 1000)
SQL["cap_rows"] = f"WITH {I.ORDERS_CTE} SELECT _row_id, order_id, city FROM messy ORDER BY _row_id LIMIT 1000"

_TEXTS = ["order_id", "email", "phone", "order_date", "total_price", "status", "paid", "priority", "city", "remark"]
QUERIES["clean_cells"] = lambda s, d: cells.clean_cells(I.messy_orders(s, d))
SQL["clean_cells"] = (
    f"WITH {I.ORDERS_CTE} SELECT _row_id, quantity, " + ", ".join(f"{Q.cell(c)} AS {c}" for c in _TEXTS) + " FROM messy"
)

QUERIES["smart_clean_cells"] = lambda s, d: cells.smart_clean_cells(I.messy_orders(s, d))
SQL["smart_clean_cells"] = (
    f"WITH {I.ORDERS_CTE} SELECT _row_id, cast(quantity as double) AS quantity, "
    + ", ".join(f"{Q.smart(c)} AS {c}" for c in _TEXTS) + " FROM messy"
)
_KINDS = {"email": "email", "phone": "phone", "order_date": "date", "total_price": "monetary", "order_id": "identifier"}
QUERIES["smart_clean_cells_typed"] = lambda s, d: cells.smart_clean_cells(I.messy_orders(s, d, *_KINDS), _KINDS)
SQL["smart_clean_cells_typed"] = f"""
WITH {I.ORDERS_CTE} SELECT _row_id, lower({Q.nonblank('email')}) AS email, {Q.phone('phone')} AS phone,
 coalesce({Q.date('order_date')}, {Q.nonblank('order_date')}) AS order_date,
 {Q.number('total_price')} AS total_price, {Q.nonblank('order_id')} AS order_id FROM messy
"""


def _coerce_sql(erase: bool) -> str:
    picked = ["order_date", "total_price", "paid", "city"]
    outs, changed = [], []
    for c in picked:
        small = "" if c == "total_price" else f" and not regexp_full_match({Q.strip(c)}, '\\d{{1,3}}')"
        wanted = f"({Q.numeric_like(c)}{small})"
        number = f"case when {wanted} then {Q.number(c)} end"
        gone = wanted if erase else f"({number}) is not null"
        outs += [f"case when {Q.present(c)} and not ({gone}) then {c} end AS {c}", f"{number} AS {c}_number"]
        changed.append(f"not {Q.present(c)} or ({gone})")
    return f"WITH {I.ORDERS_CTE} SELECT _row_id, {', '.join(outs)}, {' or '.join(changed)} AS had_norm FROM messy"


QUERIES["prune_and_coerce"] = lambda s, d: cells.prune_and_coerce(
    I.messy_orders(s, d, "order_date", "total_price", "paid", "city")
)
SQL["prune_and_coerce"] = _coerce_sql(False)
QUERIES["prune_and_coerce_erasing"] = lambda s, d: cells.prune_and_coerce(
    I.messy_orders(s, d, "order_date", "total_price", "paid", "city"), erase_unparsed=True
)
SQL["prune_and_coerce_erasing"] = _coerce_sql(True)

_VALID = ["order_date", "total_price", "phone", "remark"]
QUERIES["row_numeric_valid"] = lambda s, d: (
    lambda df: df.select("_row_id", cells.row_numeric_valid(df).alias("numeric_valid"))
)(I.messy_orders(s, d, *_VALID))
SQL["row_numeric_valid"] = (
    f"WITH {I.ORDERS_CTE} SELECT _row_id, "
    + " and ".join(f"not ({Q.numeric_like(c)} and ({Q.number(c)}) is null)" for c in _VALID)
    + " AS numeric_valid FROM messy"
)


def _normalize_by_type(s, d):
    df = I.messy_orders(s, d)
    profile, rows = collect_profile(df)
    return cells.normalize_by_type(df, rows, dataset_type(profile).first()[0])


# The types the profile finds for the messy orders, checked by the classification query.
def _text(x: str) -> str:
    return (
        f"case when {Q.present(x)} then case when contains({Q.noise(x)}, '@') or contains({Q.noise(x)}, '://') then"
        f" {Q.noise(x)} else {Q.title(Q.noise(x))} end end"
    )


NORMALIZED = {
    "order_id": f"case when {Q.present('order_id')} then {Q.noise('order_id')} end",
    "email": f"case when {Q.email_like('email')} then lower({Q.strip('email')}) end",
    "phone": f"case when length({Q.digits('phone')}) between 10 and 15 then {Q.digits('phone')} end",
    "order_date": Q.date("order_date"),
    "total_price": Q.coerced("total_price"),
    "quantity": "quantity",
    "status": _text("status"),
    "paid": Q.boolean("paid"),
    "priority": _text("priority"),
    "city": _text("city"),
    "remark": _text("remark"),
}
QUERIES["normalize_by_type"] = _normalize_by_type
SQL["normalize_by_type"] = (
    f"WITH {I.ORDERS_CTE} SELECT _row_id, " + ", ".join(f"{e} AS {c}" for c, e in NORMALIZED.items()) + " FROM messy"
)


def _normalization_counts(s, d):
    df = I.messy_orders(s, d)
    profile, rows = collect_profile(df)
    return cells.normalization_counts(df, rows, dataset_type(profile).first()[0])


def _differs(c: str) -> str:
    there = "quantity is not null" if c == "quantity" else Q.present(c)
    if c == "quantity":
        return "0"
    if c in ("total_price", "paid"):
        return f"case when {there} then 1 else 0 end"
    return f"case when {there} and ({NORMALIZED[c]}) is distinct from {c} then 1 else 0 end"


QUERIES["normalization_counts"] = _normalization_counts
SQL["normalization_counts"] = (
    f"WITH {I.ORDERS_CTE} SELECT cast(sum({' + '.join(_differs(c) for c in NORMALIZED)}) as bigint) AS changed_cells,"
    " cast(sum(" + " + ".join(
        f"case when {Q.present(c)} and ({e}) is null then 1 else 0 end" for c, e in NORMALIZED.items() if c != "quantity"
    ) + ") as bigint) AS nulled_cells FROM messy"
)


def _enforce_schema(s, d):
    a = I.messy_orders(s, d, "order_id", "city")
    b = I.messy_customers(s, d, "customer_name", "balance")
    return C.enforce_schema([a, b])


QUERIES["enforce_schema"] = _enforce_schema
SQL["enforce_schema"] = f"""
WITH {I.ORDERS_CTE}, c AS ({I.select_sql('customer', I.MESSY_CUSTOMERS)})
SELECT _row_id, order_id, city, cast(null as varchar) AS customer_name, cast(null as double) AS balance FROM messy
UNION ALL SELECT _row_id, null, null, customer_name, balance FROM c
"""


def _order_columns(s, d):
    df = I.messy_customers(s, d, "segment", "balance", "confidence").withColumn("is_anomaly", F.lit(False))
    ordered = C.order_columns(df.withColumn("__note", F.lit("x")))
    return ordered.withColumn("column_order", F.lit("; ".join(ordered.columns)))


QUERIES["order_columns"] = _order_columns
SQL["order_columns"] = f"""
WITH {I.CUSTOMERS_CTE} SELECT _row_id, balance, segment, confidence, false AS is_anomaly, 'x' AS __note,
'_row_id; balance; segment; confidence; is_anomaly; __note' AS column_order FROM messy
"""

QUERIES["strip_artifacts"] = lambda s, d: C.strip_artifacts(
    I.messy_customers(s, d, "segment", "confidence").withColumns({"is_outlier": F.lit(True), "__note": F.lit("x")})
)
SQL["strip_artifacts"] = f"WITH {I.CUSTOMERS_CTE} SELECT _row_id, segment FROM messy"

QUERIES["normalize_field_names"] = lambda s, d: (
    I.table(s, d, "part").select("p_partkey", X.normalize_field_name(F.col("p_name")).alias("name"),
                                 X.normalize_field_name(F.col("p_type")).alias("type"))
)
SQL["normalize_field_names"] = f"SELECT p_partkey, {Q.field('p_name')} AS name, {Q.field('p_type')} AS type FROM part"
