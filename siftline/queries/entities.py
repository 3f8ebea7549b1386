"""Entity tables: extraction, cleaning, merging, ids and relationships."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import entities as E
from siftline.operators.fuzzy import fuzzy_dedupe
from siftline.plans.post_process import post_process
from siftline.queries import inputs as I
from siftline.queries import sql as Q

QUERIES: dict = {}
SQL: dict[str, str] = {}

# Entities of a customer (the document): its orders' dates and amounts, people and organizations.
_PARTS = {
    "dates": {"value": "order_date", "number": "cast(null as double)", "confidence": "0.72", "currency": "''", "label": "''"},
    "amounts": {
        "value": "total_price", "number": "case when _row_id % 12 = 0 then -1.0 * _row_id else 1.0 * _row_id end",
        "confidence": "0.82", "currency": "case _row_id % 4 when 0 then ' € 5' when 1 then 'usd' when 2 then null else 'rupees and more' end",
        "label": "case _row_id % 3 when 0 then ' Invoice Total!' else 'net  sum' end",
    },
    "person_names": {
        "value": "case _row_id % 4 when 0 then 'Anna Schmidt' when 1 then 'anna schmitt' when 2 then 'John ' || status else priority end",
        "number": "cast(null as double)", "confidence": "0.5 + (_row_id % 5) / 10.0", "currency": "''", "label": "''",
    },
    "organizations": {
        "value": "case _row_id % 5 when 0 then ' visa  card' when 1 then 'Acme Corp' when 2 then 'ACME Corp.' when 3 then 'PayPal inc' else city end",
        "number": "cast(null as double)", "confidence": "0.8", "currency": "''", "label": "''",
    },
}


def _sql() -> str:
    picks = [
        f"SELECT doc_id, '{t}' AS entity_type, _row_id AS pos, {c['value']} AS value, cast({c['number']} as double) AS number,"
        f" cast({c['confidence']} as double) AS confidence, {c['currency']} AS currency, {c['label']} AS label FROM docs"
        f" WHERE {c['value']} is not null"
        for t, c in _PARTS.items()
    ]
    return " UNION ALL ".join(picks)


def _entities(s, d):
    docs = I.orders_of_customers(s, d, "order_date", "total_price", "status", "priority", "city")
    # The entities of an order come from one row, so the orders are read and joined once for all types.
    parts = [
        f"named_struct('entity_type', '{t}', 'value', {c['value']}, 'number', cast({c['number']} as double),"
        f" 'confidence', cast({c['confidence']} as double), 'currency', {c['currency']}, 'label', {c['label']})"
        for t, c in _PARTS.items()
    ]
    out = docs.selectExpr("doc_id", "_row_id AS pos", f"inline(array({', '.join(parts)}))")
    return out.filter(F.col("value").isNotNull()).select(
        "doc_id", "entity_type", "pos", "value", "number", "confidence", "currency", "label"
    )


BASE = f"{I.ORDERS_CTE}, docs AS (SELECT m.*, o_custkey AS doc_id FROM messy m JOIN orders ON o_orderkey = _row_id), entities AS ({_sql()})"

_CELLS = ["order_id", "email", "phone", "order_date", "total_price", "quantity", "city"]
QUERIES["extract_row_entities"] = lambda s, d: E.extract_row_entities(I.messy_orders(s, d, *_CELLS)).drop("currency")


def _cell_sql(i: int, c: str) -> str:
    v = f"cast({c} as varchar)" if c == "quantity" else c
    number = "quantity::double" if c == "quantity" else Q.number(c)
    mail, call, dated = ("false", "false", "false") if c == "quantity" else (
        Q.email_like(c), Q.phone_like(c), f"(length({Q.strip(c)}) >= 6 and {Q.date_like(c)})")
    return (
        f"SELECT _row_id AS doc_id, {i} AS i, '{c}' AS c, {Q.nonblank(v)} AS v, {number} AS x, {mail} AS mail, {call} AS call, {dated} AS dated FROM messy"
    )


SQL["extract_row_entities"] = f"""WITH {I.ORDERS_CTE}, cells AS ({' UNION ALL '.join(_cell_sql(i, c) for i, c in enumerate(_CELLS))}),
k AS (SELECT *, case when mail or call then 'extra_fields' when dated then 'dates' when abs(x) >= 100 or x <> floor(x) then 'amounts'
 else 'extra_fields' end AS kind, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM cells WHERE v is not null)
SELECT doc_id, cast(pos as integer) AS pos, kind AS entity_type, case when mail then lower(v) else v end AS value,
 case when kind = 'amounts' then x end AS number, case kind when 'dates' then 0.72::double when 'amounts' then 0.82::double end AS confidence,
 case when kind <> 'dates' then c end AS label FROM k"""

_TYPES = ["amounts", "dates", "organizations", "person_names"]
_FLAGS = "false AS is_anomaly, true AS is_valid_email, true AS is_valid_date, true AS is_valid_numeric"


def _documents(s, d):
    return I.table(s, d, "customer").select(F.col("c_custkey").alias("doc_id"))


def _rows_sql(item: float, bare: float) -> str:
    """Rows by position; customers without any entity are documents without entities."""
    return f"""WITH {BASE}, known AS (SELECT doc_id FROM entities GROUP BY 1 HAVING bool_or(value <> ''))
SELECT doc_id, pos, {', '.join(f"max(value) FILTER (entity_type = '{t}') AS {t}" for t in _TYPES)},
 round(avg(coalesce(confidence, {item})), 6) AS confidence, {_FLAGS}
 FROM entities WHERE doc_id IN (SELECT doc_id FROM known) GROUP BY 1, 2
UNION ALL SELECT DISTINCT doc_id, 0, null, null, null, null, 0.5, false, true, true, true FROM entities WHERE doc_id NOT IN (SELECT doc_id FROM known)
UNION ALL SELECT c_custkey, 0, null, null, null, null, {bare}, false, true, true, true FROM customer WHERE c_custkey NOT IN (SELECT doc_id FROM entities)"""


def _rows(s, d, kind: str):
    return E.entities_to_rows(_entities(s, d), _TYPES, _documents(s, d), kind).withColumn("confidence", F.round("confidence", 6))


QUERIES["entities_to_rows"] = lambda s, d: _rows(s, d, "entities")
SQL["entities_to_rows"] = _rows_sql(0.85, 0.75)
QUERIES["generic_entities_to_rows"] = lambda s, d: _rows(s, d, "generic")
SQL["generic_entities_to_rows"] = _rows_sql(0.8, 0.5)
QUERIES["first_entities_to_rows"] = lambda s, d: E.first_entities_to_rows(_entities(s, d), _TYPES)
SQL["first_entities_to_rows"] = f"""WITH {BASE} SELECT doc_id, {', '.join(f"arg_min(value, pos) FILTER (entity_type = '{t}') AS {t}" for t in _TYPES)},
 0.75::double AS confidence, {_FLAGS} FROM entities GROUP BY 1"""

QUERIES["clean_entity_dates"] = lambda s, d: E.clean_entity_dates(_entities(s, d))
SQL["clean_entity_dates"] = f"""WITH {BASE}, p AS (SELECT *, {Q.date('value')} AS iso FROM entities)
SELECT * EXCLUDE (iso) REPLACE (case when entity_type = 'dates' then iso else value end AS value),
 case when entity_type = 'dates' and value <> iso then value end AS original FROM p WHERE entity_type <> 'dates' or iso is not null"""
QUERIES["clean_entity_amounts"] = lambda s, d: E.clean_entity_amounts(_entities(s, d))
SQL["clean_entity_amounts"] = f"""WITH {BASE} SELECT * REPLACE (
 case when entity_type <> 'amounts' then currency when coalesce(trim(currency), '') = '' then '' when contains(currency, '€') then 'EUR'
  else upper(trim(currency)) end AS currency,
 case when entity_type <> 'amounts' then label else {Q.sub(Q.sub('lower(label)', '[^a-z0-9]+', '_'), '^_|_$', '')} end AS label),
 case when entity_type = 'amounts' and number < 0 then 'negative_value' end AS flag FROM entities"""
QUERIES["split_payment_methods"] = lambda s, d: E.split_payment_methods(_entities(s, d))
_PAY = "entity_type = 'organizations' and length(trim(value)) <= 40 and regexp_matches(lower(value), '\\bvisa\\b|\\bpaypal\\b|\\bcash\\b|\\bupi\\b')"
SQL["split_payment_methods"] = f"""WITH {BASE} SELECT * REPLACE (case when {_PAY} then 'payment_methods' else entity_type end AS entity_type,
 case when {_PAY} then {Q.title(Q.strip('value'))} else value end AS value) FROM entities"""
QUERIES["assign_entity_ids"] = lambda s, d: E.assign_entity_ids(_entities(s, d)).select("doc_id", "entity_type", "pos", "id")
_IDS = """ids AS (SELECT *, case left(entity_type, 2) when 'pe' then 'p' when 'or' then 'o' when 'da' then 'd' when 'am' then 'a' end
 || row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY pos) AS id FROM entities)"""
SQL["assign_entity_ids"] = f"WITH {BASE}, {_IDS} SELECT doc_id, entity_type, pos, id FROM ids"


_FROM = "case o_orderkey % 4 when 0 then 'Anna Schmidt' when 1 then 'ANNA SCHMITT' when 2 then 'Acme Corp' else 'nobody' end"
_TO = "case o_orderkey % 3 when 0 then 'acme corp.' when 1 then 'John  open ' else 'PAYPAL INC' end"


def _relationships(s, d):
    return I.table(s, d, "orders").selectExpr(
        "o_custkey AS doc_id", "o_orderkey AS rel_id", "case when o_orderkey % 6 = 0 then null else 'pays' end AS type",
        f"{_FROM} AS `from`", f"{_TO} AS `to`", "case when o_orderkey % 5 = 0 then null else 0.5D end AS confidence",
    )


QUERIES["map_relationships"] = lambda s, d: E.map_relationships(_relationships(s, d), E.assign_entity_ids(_entities(s, d)))
SQL["map_relationships"] = f"""WITH {BASE}, {_IDS}, placed AS (SELECT *, case entity_type when 'person_names' then 1 when 'organizations' then 2
 when 'dates' then 3 else 4 end AS t FROM ids),
names AS (SELECT doc_id, value AS k, id, t, pos FROM placed UNION ALL SELECT doc_id, lower(value), id, t, pos FROM placed),
last AS (SELECT doc_id, k, arg_max(id, t * 1000000000000 + pos) AS id FROM names GROUP BY 1, 2),
r AS (SELECT o_custkey AS doc_id, o_orderkey AS rel_id, case when o_orderkey % 6 = 0 then 'unknown' else 'pays' end AS type,
 {_FROM} AS f, {_TO} AS g, case when o_orderkey % 5 = 0 then 0.0::double else 0.5::double end AS confidence FROM orders)
SELECT r.doc_id, rel_id, type, coalesce(a.id, b.id, f) AS "from", coalesce(c.id, e.id, g) AS "to", confidence FROM r
 LEFT JOIN last a ON a.doc_id = r.doc_id and a.k = f LEFT JOIN last b ON b.doc_id = r.doc_id and b.k = lower(f)
 LEFT JOIN last c ON c.doc_id = r.doc_id and c.k = g LEFT JOIN last e ON e.doc_id = r.doc_id and e.k = lower(g)"""
QUERIES["document_confidence"] = lambda s, d: E.document_confidence(
    I.table(s, d, "customer").select(F.col("c_custkey").alias("doc_id")), _entities(s, d).filter("entity_type <> 'person_names'")
)
SQL["document_confidence"] = f"""WITH {BASE} SELECT c_custkey AS doc_id, coalesce(round_even(round(avg(confidence), 9), 2), 0) AS confidence_overall
 FROM customer LEFT JOIN entities ON doc_id = c_custkey and entity_type <> 'person_names' GROUP BY 1"""
QUERIES["fuzzy_dedupe"] = lambda s, d: fuzzy_dedupe(_entities(s, d), only=["person_names", "organizations"])
QUERIES["fuzzy_dedupe_copies"] = lambda s, d: fuzzy_dedupe(
    _entities(s, d).filter("entity_type = 'organizations' and value like '%Corp%'")
).select("doc_id", "entity_type", "pos", "value", "confidence")
# Both spellings of the firm are alike and equally confident, so the first of them stays.
SQL["fuzzy_dedupe_copies"] = f"""WITH {BASE} SELECT doc_id, entity_type, min(pos) AS pos, arg_min(value, pos) AS value, 0.8::double AS confidence
 FROM entities WHERE entity_type = 'organizations' and value like '%Corp%' GROUP BY 1, 2"""
QUERIES["post_process_entities"] = lambda s, d: post_process(_entities(s, d)).entities
QUERIES["post_process_relationships"] = lambda s, d: post_process(_entities(s, d), _relationships(s, d)).relationships
QUERIES["post_process_confidence"] = lambda s, d: post_process(_entities(s, d)).confidence
