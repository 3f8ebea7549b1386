"""Profiling, classification, order statistics and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.operators import mapping as M
from siftline.operators import profile as P
from siftline.operators import quality
from siftline.operators import ranks as R
from siftline.operators import summary as S
from siftline.queries import inputs as I
from siftline.queries import sql as Q

QUERIES: dict = {}
SQL: dict[str, str] = {}

# ---- the profile in SQL --------------------------------------------------------------------------

MONEY = "|".join(P.MONETARY_WORDS)
ANALYSIS = "|".join(P.ANALYTICAL_WORDS)


def _cells(source: str, kinds: dict[str, str], rename: dict[str, str] | None = None) -> str:
    """Long cells ``(column_name, position, v, x, kind)`` of a table."""
    rename = rename or {}
    parts = []
    for i, (c, kind) in enumerate(kinds.items()):
        v = Q.nonblank(c) if kind == "text" else f"cast({c} as varchar)"
        x = "null" if kind in ("text", "date") else f"cast({c} as double)"
        parts.append(
            f"SELECT '{rename.get(c, c)}' AS column_name, {i + 1} AS position, lower({v}) AS v,"
            f" cast({x} as double) AS given, '{kind}' AS kind FROM {source}"
        )
    return " UNION ALL ".join(parts)


def _profile_ctes(source: str, kinds: dict[str, str], rename: dict[str, str] | None = None) -> str:
    text = lambda e: f"(kind = 'text' and coalesce({e}, false))"
    return f"""
cells AS ({_cells(source, kinds, rename)}),
judged AS (SELECT *,
  case kind when 'text' then {Q.coerced('v')} else given end AS x,
  {text(Q.email_like('v'))} AS email,
  {text(Q.phone_like('v'))} or (kind = 'whole' and length(cast(abs(cast(given as hugeint)) as varchar)) between 10 and 15) AS phone,
  {text(Q.date_like('v'))} or (kind = 'date' and v is not null) AS dated,
  {text(f'({Q.boolean("v")}) is not null')} or (given in (0, 1)) AS booled,
  {text(Q.currency_like('v'))} AS currency,
  {text(f'length({Q.digits("v")}) >= 3')} AS digits
  FROM cells),
hits AS (SELECT column_name, position, count(*) AS total, count(v) AS filled, count(distinct v) AS distincts,
  count(*) FILTER (email) AS email_hits, count(*) FILTER (phone) AS phone_hits, count(*) FILTER (dated) AS date_hits,
  count(*) FILTER (booled) AS bool_hits, count(*) FILTER (currency) AS currency_hits,
  count(*) FILTER (digits) AS digits_hits, count(x) AS num_hits,
  count(*) FILTER (x = floor(x)) AS whole_hits, count(*) FILTER (x = floor(x) and x between 1 and 100) AS small_hits,
  min(x) FILTER (x = floor(x)) AS min_whole, max(x) FILTER (x = floor(x)) AS max_whole,
  count(distinct x) FILTER (x = floor(x)) AS whole_values,
  min(x) AS low, max(x) AS high, avg(x) AS mean, case when count(x) = 1 then 0 else stddev_samp(x) end AS spread,
  median(x) AS middle, count(distinct round_even(x, 6)) AS numbers
  FROM judged GROUP BY column_name, position),
ranked AS (SELECT *, coalesce(filled >= 2 and whole_hits / num_hits >= 0.8 and small_hits / num_hits >= 0.8 and min_whole <= 10
  and max_whole - min_whole <= 30 and whole_values >= 2, false) AS rank_like,
  regexp_matches('_' || column_name || '_', '_({MONEY})_') AS money_name,
  regexp_matches('_' || column_name || '_', '_({ANALYSIS})_') AS analysis_name,
  filled / total AS fill_rate, case when filled = 0 then 0 else distincts / filled end AS distinct_ratio FROM hits),
ruled AS (SELECT *, case
  when filled = 0 then 'empty'
  when email_hits / filled >= 0.35 then 'email'
  when phone_hits / filled >= 0.5 then 'phone'
  when filled >= 2 and bool_hits / filled >= 0.8 then 'boolean'
  when filled >= 2 and date_hits / filled >= 0.6 and num_hits / filled < 0.5 then 'date'
  when num_hits >= 2 and num_hits / filled >= 0.55 and not money_name and rank_like then 'rank'
  when num_hits / filled >= 0.55 and (money_name or currency_hits / filled >= 0.6) then 'monetary'
  when num_hits / filled >= 0.55 then 'numeric'
  when filled >= 5 and distinct_ratio < 0.5 then 'categorical'
  when filled >= 5 and distinct_ratio >= 0.9 then 'identifier'
  when filled >= 3 and distinct_ratio >= 0.9 and digits_hits / filled >= 0.3 then 'identifier'
  else 'text' end AS rule FROM ranked),
prof AS (SELECT *, case rule when 'empty' then 'text' when 'rank' then 'identifier' else rule end AS inferred_type,
  rule <> 'rank' AS semantic_confidence_high,
  rule = 'identifier' or (rule in ('numeric','monetary') and num_hits >= 5 and numbers / num_hits >= 0.9) AS is_candidate_key,
  rule in ('boolean','categorical') or (rule in ('numeric','monetary') and num_hits >= 3
    and not (num_hits >= 5 and numbers / num_hits >= 0.9)
    and not (num_hits <= 24 and numbers / num_hits >= (num_hits - 1) / num_hits)
    and not (mean <> 0 and spread / abs(mean) > 1.5)) AS allows_imputation FROM ruled)
"""


_MESSY_KINDS = {c: ("whole" if c == "quantity" else "text") for c in I.MESSY_ORDERS if c != "_row_id"}
_LINE_KINDS = {
    "l_partkey": "whole", "l_suppkey": "whole", "l_linenumber": "whole", "l_quantity": "real",
    "l_extendedprice": "real", "l_discount": "real", "l_tax": "real", "l_returnflag": "text",
    "l_linestatus": "text", "l_shipdate": "date",
}
MESSY = f"WITH {I.ORDERS_CTE}, " + _profile_ctes("messy", _MESSY_KINDS)
LINES = "WITH " + _profile_ctes("lineitem", _LINE_KINDS)
_ORDER_KINDS = {
    "o_orderkey": "whole", "o_custkey": "whole", "o_orderstatus": "text", "o_totalprice": "real",
    "o_orderdate": "date", "o_orderpriority": "text",
}
_TOTAL = {"o_totalprice": "total_price"}
ORDERS = "WITH " + _profile_ctes("orders", _ORDER_KINDS, _TOTAL)


def _lines(s, d):
    return I.table(s, d, "lineitem").select(*_LINE_KINDS)


def _orders(s, d):
    named = I.table(s, d, "orders").withColumnRenamed("o_totalprice", "total_price")
    return named


_HITS = ["email_hits", "phone_hits", "date_hits", "bool_hits", "currency_hits", "digits_hits", "num_hits", "whole_hits", "small_hits"]
_HITS_SQL = (
    f"SELECT column_name AS \"column\", total, filled, distincts AS \"distinct\", {', '.join(_HITS)},"
    " numbers AS distinct_numbers FROM hits"
)


def _hits(df):
    return P.profile_hits(df).select("column", "total", "filled", "distinct", *_HITS, "distinct_numbers")


QUERIES["profile_hits"] = lambda s, d: _hits(I.messy_orders(s, d))
SQL["profile_hits"] = f"{MESSY} {_HITS_SQL}"
QUERIES["profile_hits_lineitem"] = lambda s, d: _hits(_lines(s, d))
SQL["profile_hits_lineitem"] = f"{LINES} {_HITS_SQL}"

_PROFILE_SQL = (
    'SELECT column_name AS "column", inferred_type, total, filled, round(fill_rate, 6) AS fill_rate,'
    " round(distinct_ratio, 6) AS distinct_ratio, is_candidate_key, allows_imputation, semantic_confidence_high FROM prof"
)


def _profile(df):
    return P.classify_columns(df).select(
        "column", "inferred_type", "total", "filled", F.round("fill_rate", 6).alias("fill_rate"),
        F.round("distinct_ratio", 6).alias("distinct_ratio"), "is_candidate_key", "allows_imputation",
        "semantic_confidence_high",
    )


QUERIES["classify_columns"] = lambda s, d: _profile(I.messy_orders(s, d))
SQL["classify_columns"] = f"{MESSY} {_PROFILE_SQL}"
QUERIES["classify_columns_lineitem"] = lambda s, d: _profile(_lines(s, d))
SQL["classify_columns_lineitem"] = f"{LINES} {_PROFILE_SQL}"

QUERIES["rank_columns"] = lambda s, d: P.rank_columns(_lines(s, d))
SQL["rank_columns"] = f'{LINES} SELECT column_name AS "column", rank_like FROM ranked'

QUERIES["numeric_stats"] = lambda s, d: P.numeric_stats(_lines(s, d)).select(
    "column", "count", *[F.round(c, 4).alias(c) for c in ("mean", "median", "min", "max", "stdev")]
)
_STATS = (
    'SELECT column_name AS "column", num_hits AS count, round(mean, 4) AS mean, round(middle, 4) AS median,'
    " round(low, 4) AS min, round(high, 4) AS max, round(spread, 4) AS stdev FROM hits WHERE num_hits > 0"
)
SQL["numeric_stats"] = f"{LINES} {_STATS}"
QUERIES["numeric_stats_messy"] = lambda s, d: P.numeric_stats(I.messy_orders(s, d)).select(
    "column", "count", *[F.round(c, 4).alias(c) for c in ("mean", "median", "min", "max", "stdev")]
)
SQL["numeric_stats_messy"] = f"{MESSY} {_STATS}"

QUERIES["imputation_policy"] = lambda s, d: P.imputation_policy(I.messy_orders(s, d))
SQL["imputation_policy"] = (
    f'{MESSY} SELECT column_name AS "column", inferred_type, is_candidate_key, allows_imputation FROM prof'
)


def _hints(s, d):
    from siftline.sources.memory import columns_of

    tables = {t: I.table(s, d, t) for t in ("orders", "lineitem", "customer", "part", "documents", "labels")}
    named = columns_of(tables, s).select(F.expr("column || case table when 'orders' then '_net-Price' when 'part' then ' Score' else '' end").alias("column"))
    return P.name_hints(named)


def _column_list(tables: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", column_name AS \"column\" FROM (DESCRIBE {t})" for t in tables
    )


QUERIES["name_hints"] = _hints
SQL["name_hints"] = f"""
WITH c AS ({_column_list(['orders', 'lineitem', 'customer', 'part', 'documents', 'labels'])}),
n AS (SELECT "column" || case "table" when 'orders' then '_net-Price' when 'part' then ' Score' else '' end AS name FROM c)
SELECT name AS "column", regexp_matches('_' || {Q.field('name')} || '_', '_({MONEY})_') AS monetary,
 regexp_matches('_' || {Q.field('name')} || '_', '_({ANALYSIS})_') AS analytical FROM n
"""

_CRITICAL = (
    'SELECT column_name AS "column" FROM prof WHERE is_candidate_key or (fill_rate >= 0.75 and'
    " floor(fill_rate * total) >= greatest(3, total // 2)) or (floor(fill_rate * total) >= 5 and distinct_ratio >= 0.9)"
    " or (inferred_type in ('numeric','monetary') and num_hits > 0) ORDER BY 1 LIMIT 16"
)
QUERIES["critical_columns"] = lambda s, d: P.critical_columns(P.classify_columns(I.messy_orders(s, d)))
SQL["critical_columns"] = f"{MESSY} {_CRITICAL}"
QUERIES["infer_critical_fields"] = lambda s, d: P.infer_critical_fields(I.messy_orders(s, d))
SQL["infer_critical_fields"] = f"""{MESSY} SELECT column_name AS "column" FROM hits WHERE
 (filled >= greatest(3, total // 2) and distincts / filled >= 0.9) or (filled / total >= 0.75 and filled >= greatest(3, total // 2))
 or (column_name = 'quantity' and filled > 0) ORDER BY 1 LIMIT 16"""

_KIND = """SELECT case when analysis >= 2 then 'analytical'
 when numbers / total >= 0.6 and identifiers <= 1 and texts <= 2 then 'analytical'
 when money >= 1 and (dates >= 1 or identifiers >= 1 or keys >= 1) then 'transactional'
 when texts / total >= 0.4 and contacts >= 1 then 'entity' when texts / total >= 0.5 then 'entity'
 when numbers / total >= 0.5 then 'analytical' else 'entity' end AS dataset_type
FROM (SELECT count(*) AS total, count(*) FILTER (analysis_name) AS analysis,
 count(*) FILTER (inferred_type in ('numeric','monetary')) AS numbers, count(*) FILTER (inferred_type in ('text','categorical')) AS texts,
 count(*) FILTER (inferred_type = 'identifier') AS identifiers, count(*) FILTER (inferred_type = 'date') AS dates,
 count(*) FILTER (inferred_type = 'monetary') AS money, count(*) FILTER (is_candidate_key) AS keys,
 count(*) FILTER (inferred_type in ('email','phone','identifier')) AS contacts FROM prof)"""
QUERIES["dataset_type"] = lambda s, d: P.dataset_type(P.classify_columns(I.messy_orders(s, d)))
SQL["dataset_type"] = f"{MESSY} {_KIND}"
QUERIES["dataset_type_lineitem"] = lambda s, d: P.dataset_type(P.classify_columns(_lines(s, d)))
SQL["dataset_type_lineitem"] = f"{LINES} {_KIND}"

QUERIES["field_types"] = lambda s, d: P.field_types(P.classify_columns(I.messy_orders(s, d))).select(
    "inferred_type", F.array_join("columns", "; ").alias("columns")
)
SQL["field_types"] = f"""{MESSY}, t AS (SELECT inferred_type, column_name FROM prof UNION ALL
 SELECT 'text', column_name FROM prof WHERE inferred_type = 'categorical')
SELECT inferred_type, string_agg(column_name, '; ' ORDER BY column_name) AS columns FROM t GROUP BY 1"""

QUERIES["sample_values"] = lambda s, d: P.sample_values(I.messy_orders(s, d))
SQL["sample_values"] = f"""WITH {I.ORDERS_CTE}, c AS ({" UNION ALL ".join(
    f"SELECT _row_id, '{c}' AS column_name, {Q.nonblank(c) if k == 'text' else f'cast({c} as varchar)'} AS v FROM messy"
    for c, k in _MESSY_KINDS.items())}),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY _row_id) AS place FROM c WHERE v is not null)
SELECT column_name AS "column", cast(place as integer) AS place, v AS value FROM r WHERE place <= 5"""

# ---- order statistics ----------------------------------------------------------------------------

QUERIES["numeric_outliers"] = lambda s, d: R.numeric_outliers(
    I.table(s, d, "events").select("event_id", "value"), "value"
)
SQL["numeric_outliers"] = """
WITH r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, count(value) OVER () AS n FROM events WHERE value is not null),
q AS (SELECT max(value) FILTER (k = n // 4) AS q1, max(value) FILTER (k = (3 * n) // 4) AS q3 FROM r),
f AS (SELECT q1, q3, case when q3 - q1 > 0 then q3 - q1 when q3 <> 0 then abs(q3) else 1 end AS w FROM q)
SELECT event_id, value FROM events, f WHERE value < q1 - 1.5 * w OR value > q3 + 1.5 * w
"""
QUERIES["median_of"] = lambda s, d: R.median_of(I.table(s, d, "lineitem"), "l_extendedprice")
SQL["median_of"] = "SELECT median(l_extendedprice) AS median FROM lineitem"
QUERIES["mode_of"] = lambda s, d: R.mode_of(
    I.messy_orders(s, d, "order_date"), "order_date"
)
SQL["mode_of"] = f"""WITH {I.ORDERS_CTE} SELECT order_date AS mode, count(*) AS n FROM messy WHERE order_date is not null
GROUP BY 1 ORDER BY n DESC, min(_row_id) LIMIT 1"""

# ---- roles ---------------------------------------------------------------------------------------

QUERIES["classify_fields"] = lambda s, d: M.classify_fields(I.messy_orders(s, d))
SQL["classify_fields"] = f"""{MESSY} SELECT case inferred_type when 'monetary' then 'amount_monetary' else inferred_type end AS role,
 column_name AS "column", position FROM prof WHERE semantic_confidence_high and inferred_type in ('email','phone','date','monetary')"""

_OVERLAY = {
    "role": "case when position % 2 = 0 then 'text' else 'date' end",
    "column": "' ' || \"column\" || case when position % 5 = 0 then ' ' when position % 7 = 0 then '_confidence' else '' end",
}


def _merge(s, d):
    # One row per column of the table, computed once for its three uses.
    rows = I.messy_orders(s, d)
    profile, _ = P.collect_profile(rows)
    base = M.classify_fields(rows, profile)
    overlay = profile.selectExpr(*[f"{e} AS {c}" for c, e in ((c, e.replace('"', '`')) for c, e in _OVERLAY.items())])
    return M.merge_field_maps(base, overlay, profile.select("column"))


QUERIES["merge_field_maps"] = _merge
SQL["merge_field_maps"] = f"""{MESSY}, whole AS (SELECT column_name AS "column", position FROM prof),
overlay AS (SELECT {_OVERLAY['role']} AS role, trim({_OVERLAY['column']}) AS "column" FROM whole)
SELECT case inferred_type when 'monetary' then 'amount_monetary' else inferred_type end AS role, column_name AS "column"
 FROM prof WHERE semantic_confidence_high and inferred_type in ('email','phone','date','monetary')
UNION SELECT role, "column" FROM overlay WHERE not contains("column", 'confidence')
 and "column" in (SELECT "column" FROM whole)"""


def _sources(s, d):
    from siftline.sources.memory import columns_of

    named = columns_of({t: I.table(s, d, t) for t in ("orders", "labels", "events")}, s).select(
        F.expr("case when column like '%date' then 'is_valid_' || column when column like '%price' then 'Confidence ' || column"
               " when column like '%ts' then '__' || column when column = 'toxic' then 'meta-data imputed' else column end").alias("column")
    )
    return M.valid_source_columns(named)


QUERIES["valid_source_columns"] = _sources
SQL["valid_source_columns"] = f"""
WITH c AS ({_column_list(['orders', 'labels', 'events'])}), n AS (SELECT case when "column" like '%date' then 'is_valid_' || "column"
 when "column" like '%price' then 'Confidence ' || "column" when "column" like '%ts' then '__' || "column"
 when "column" = 'toxic' then 'meta-data imputed' else "column" end AS "column" FROM c)
SELECT "column" FROM n WHERE {Q.field('"column"')} <> ''
 and not regexp_matches({Q.field('"column"')}, 'is_valid_|is_anomaly|confidence|__|imputed|metadata')
"""
QUERIES["needs_more_roles"] = lambda s, d: M.needs_more_roles(M.classify_fields(I.messy_orders(s, d)))
SQL["needs_more_roles"] = f"""{MESSY} SELECT count(distinct inferred_type) AS roles, count(distinct inferred_type) < 2 AS needs_more
 FROM prof WHERE semantic_confidence_high and inferred_type in ('email','phone','date','monetary')"""

# ---- summaries -----------------------------------------------------------------------------------

_SUMMARY = (
    'column_name AS "column", round_even(mean, 4) AS avg, low AS min, high AS max, num_hits AS count'
)
_SKIP = "not coalesce(num_hits >= 2 and whole_hits / num_hits >= 0.8 and small_hits / num_hits >= 0.8 and whole_values >= 2, false)"


def numeric_summary_orders(s, d):
    """Profile, classify, then summarize: the confirmed money columns, else every column that is no rank."""
    df = I.table(s, d, "orders")
    profile, _ = P.collect_profile(df)
    money = [r[0] for r in P.confirmed_monetary(profile).collect()]
    return S.numeric_summary(df, money or None).drop("position")


QUERIES["numeric_summary"] = numeric_summary_orders
SQL["numeric_summary"] = "WITH " + _profile_ctes("orders", _ORDER_KINDS) + f" SELECT {_SUMMARY} FROM hits WHERE num_hits > 0 and {_SKIP}"


def _summary_named(s, d):
    df = _orders(s, d)
    money = [r[0] for r in P.confirmed_monetary(P.classify_columns(df)).collect()]
    return S.numeric_summary(df, money or None).drop("position")


QUERIES["numeric_summary_confirmed"] = _summary_named
SQL["numeric_summary_confirmed"] = f"{ORDERS} SELECT {_SUMMARY} FROM prof WHERE inferred_type = 'monetary' and semantic_confidence_high"
QUERIES["numeric_summary_lineitem"] = lambda s, d: S.numeric_summary(_lines(s, d)).drop("position")
SQL["numeric_summary_lineitem"] = f"{LINES} SELECT {_SUMMARY} FROM hits WHERE num_hits > 0 and {_SKIP}"
QUERIES["confirmed_monetary"] = lambda s, d: P.confirmed_monetary(P.classify_columns(_orders(s, d)))
SQL["confirmed_monetary"] = f"{ORDERS} SELECT column_name AS \"column\" FROM prof WHERE inferred_type = 'monetary' and semantic_confidence_high"
QUERIES["rank_like_columns"] = lambda s, d: S.rank_like_columns(_lines(s, d))
SQL["rank_like_columns"] = f'{LINES} SELECT column_name AS "column", not ({_SKIP}) AS rank_like FROM hits WHERE num_hits > 0'

QUERIES["location_distribution"] = lambda s, d: S.location_distribution(
    I.messy_orders(s, d, "city", "status").withColumnRenamed("status", "location")
)
SQL["location_distribution"] = f"""WITH {I.ORDERS_CTE}, p AS (SELECT _row_id, coalesce({Q.nonblank('city')}, {Q.nonblank('status')}) AS place FROM messy)
SELECT place, count(*) AS n FROM p WHERE place is not null GROUP BY 1 ORDER BY n DESC, min(_row_id) LIMIT 100"""


def _board_input(s, d):
    return I.table(s, d, "customer").select(
        F.col("c_custkey").alias("_row_id"), "c_nationkey", "c_acctbal", F.col("c_mktsegment").alias("city"),
        F.expr("case when c_custkey % 4 = 0 then null else c_acctbal * 2 end").alias("twice"),
    )


_BOARD = ("board AS (SELECT c_custkey AS _row_id, c_nationkey, c_acctbal, c_mktsegment AS city,"
          " case when c_custkey % 4 = 0 then null else c_acctbal * 2 end AS twice FROM customer)")
QUERIES["dashboard_summary"] = lambda s, d: S.dashboard(_board_input(s, d))["summary"]
SQL["dashboard_summary"] = f"""WITH {_BOARD}, c AS (SELECT 'c_acctbal' AS name, count(c_acctbal) AS n, 1 AS p FROM board
 UNION ALL SELECT 'twice', count(twice), 2 FROM board)
SELECT (SELECT count(*) FROM board) AS total_records, (SELECT count(*) FROM c) AS numeric_field_count,
 (SELECT string_agg(name, '; ' ORDER BY n DESC, p) FROM c) AS top_numeric_fields,
 (SELECT count(distinct city) FROM board) AS unique_cities"""
QUERIES["dashboard_series"] = lambda s, d: S.dashboard(_board_input(s, d))["numeric_series"]
SQL["dashboard_series"] = f"""WITH {_BOARD} SELECT 'c_acctbal' AS "column", round_even(avg(c_acctbal), 4) AS avg, min(c_acctbal) AS min,
 max(c_acctbal) AS max, count(c_acctbal) AS count FROM board UNION ALL
 SELECT 'twice', round_even(avg(twice), 4), min(twice), max(twice), count(twice) FROM board"""
QUERIES["dashboard_records"] = lambda s, d: S.dashboard(_board_input(s, d))["records"]
SQL["dashboard_records"] = f"WITH {_BOARD} SELECT * FROM board ORDER BY _row_id LIMIT 10"


def _cleaning_stats(s, d):
    from siftline.operators.cells import clean_cells

    before = I.messy_orders(s, d)
    return S.cleaning_stats(before, clean_cells(before))


_TEXTS = [c for c in _MESSY_KINDS if c != "quantity"]
QUERIES["cleaning_stats"] = _cleaning_stats
SQL["cleaning_stats"] = f"""WITH {I.ORDERS_CTE} SELECT count(*) AS rows_processed, count(*) FILTER (
 {" or ".join(f"({Q.cell(c)}) is distinct from {c}" for c in _TEXTS)}) AS rows_modified FROM messy"""

QUERIES["null_rate"] = lambda s, d: quality.null_rate(I.messy_orders(s, d))
SQL["null_rate"] = f"""{MESSY} SELECT round_even((sum(total) - sum(filled)) / sum(total), 6) AS null_rate FROM hits"""
