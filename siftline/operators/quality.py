"""Validity flags, anomalies, confidence, imputation and quality scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline import functions as X
from siftline.operators.cells import number_lanes
from siftline.operators.columns import (
    FLAGS, IMPUTED, ROW_ID, all_of, any_of, col, content_columns, filled, integral_columns, numeric_columns,
    string_columns, total_of,
)
from siftline.operators.ranks import medians


def _valid_date(df: DataFrame, name: str) -> Column:
    if name in string_columns(df):
        return X.parse_date(col(name)).isNotNull()
    return col(name).isNotNull()


def missing_cells(df: DataFrame) -> Column:
    return total_of([(~filled(df, c)).cast("int") for c in content_columns(df)])


def missing_ratio(df: DataFrame) -> Column:
    """Share of the row's content cells that are missing."""
    n = len(content_columns(df))
    return missing_cells(df) / F.lit(float(n)) if n else F.lit(0.0)


def null_rate(df: DataFrame) -> DataFrame:
    """One row: the share of missing cells, six digits."""
    n = len(content_columns(df))
    rate = F.try_divide(F.sum(missing_cells(df)), F.count("*") * n)
    return df.agg(F.coalesce(F.bround(rate, 6), F.lit(0.0)).alias("null_rate"))


def refresh_flags(df: DataFrame, email_cols: list[str], date_cols: list[str]) -> DataFrame:
    """Recompute the flags: any valid address of those present, no invalid date among those present."""
    flags = {}
    if email_cols:
        there = any_of([filled(df, c) for c in email_cols])
        flags["is_valid_email"] = ~there | any_of([X.is_valid_email(col(c)) for c in email_cols])
    invalid = [filled(df, c) & ~_valid_date(df, c) for c in date_cols]
    flags["is_valid_date"] = ~any_of(invalid)
    flags["is_valid_numeric"] = F.lit(True)
    out = df.withColumns(flags)
    return out if email_cols else out.drop("is_valid_email")


def validation_summary(df: DataFrame, profile_rows: list) -> DataFrame:
    """One row of counts: valid addresses, phones, pay cells, dated rows and numeric cells."""
    def of(*types: str) -> list[str]:
        return [r["column"] for r in profile_rows if r["inferred_type"] in types and r["column"] in df.columns]

    def numeric(c: str) -> tuple[Column, Column]:
        if c in numeric_columns(df):
            return col(c).isNotNull(), X.is_salary(col(c).cast("double"))
        like = F.coalesce(X.is_numeric_like(col(c)), F.lit(False))
        return like, like & X.is_salary(X.parse_number(col(c)))

    numbers = [numeric(c) for c in of("numeric", "monetary") if c in numeric_columns(df) + string_columns(df)]
    dated = all_of([~filled(df, c) | _valid_date(df, c) for c in of("date")])
    mailed = any_of([X.is_valid_email(col(c)) for c in of("email")])
    phoned = any_of([F.coalesce(X.looks_like_phone(col(c).cast("string")), F.lit(False)) for c in of("phone")])
    return df.agg(
        F.count_if(mailed).alias("valid_email_count"),
        F.count_if(phoned).alias("valid_phone_count"),
        F.coalesce(F.sum(total_of([s.cast("int") for _, s in numbers])), F.lit(0)).alias("valid_salary_count"),
        F.count_if(dated).alias("valid_date_count"),
        F.coalesce(F.sum(total_of([n.cast("int") for n, _ in numbers])), F.lit(0)).alias("valid_numeric_count"),
    )


def filter_rows(df: DataFrame, email_cols: list[str], dataset_type: str, email_strategy: str = "none") -> DataFrame:
    """Drop all-empty rows and, on request, rows without a valid address; analytical data stays whole."""
    if dataset_type == "analytical":
        return df
    keep = any_of([filled(df, c) for c in content_columns(df)])
    if email_strategy == "remove_row":
        keep &= all_of([X.is_valid_email(col(c)) for c in email_cols])
    return df.filter(keep)


# ---- anomalies and confidence --------------------------------------------------------------------


def detect_anomalies(
    df: DataFrame, critical: list[str], email_cols: list[str] | None = None, date_cols: list[str] | None = None
) -> DataFrame:
    """Set ``is_anomaly`` (an earlier mark stays) and ``anomaly_reason``.

    The column means come from one aggregate whose single row becomes literals.
    """
    lanes = {c: lane for c, lane in number_lanes(df).items() if not c.startswith("_")}
    numbers = {lane: F.nanvl(col(lane).cast("double"), F.lit(None)) for lane in lanes.values()}
    means = df.agg(*[F.avg(x).alias(c) for c, x in numbers.items()]).first() if numbers else {}
    reasons = []
    if "is_valid_numeric" in df.columns:
        reasons.append(("invalid_numeric", ~F.coalesce(col("is_valid_numeric"), F.lit(False))))
    if email_cols:
        reasons.append(("invalid_email", _some_cell(df, email_cols, lambda v: ~X.is_valid_email(v))))
    elif "is_valid_email" in df.columns:
        reasons.append(("invalid_email", ~F.coalesce(col("is_valid_email"), F.lit(True))))
    if date_cols:
        dated = [c for c in date_cols if c in string_columns(df)]
        reasons.append(("invalid_date", _some_cell(df, dated, lambda v: X.parse_date(v).isNull())))
    elif "is_valid_date" in df.columns:
        reasons.append(("invalid_date", ~F.coalesce(col("is_valid_date"), F.lit(True))))
    if critical:
        gone = [~filled(df, c) if c in df.columns else F.lit(True) for c in critical]
        reasons.append(("missing_critical", any_of(gone)))
    outliers = [x > 3.0 * means[c] for c, x in numbers.items() if means[c] is not None and means[c] > 0]
    if outliers:
        reasons.append(("outlier", any_of([F.coalesce(o, F.lit(False)) for o in outliers])))
    reason = F.lit(None).cast("string")
    for name, condition in reversed(reasons):
        reason = F.when(condition, F.lit(name)).otherwise(reason)
    before = F.coalesce(col("is_anomaly"), F.lit(False)) if "is_anomaly" in df.columns else F.lit(False)
    # Two steps, so that the conditions are generated once.
    return df.withColumn("anomaly_reason", reason).withColumn("is_anomaly", before | col("anomaly_reason").isNotNull())


def _some_cell(df: DataFrame, names: list[str], bad) -> Column:
    """Whether ``bad`` holds for a filled cell of these columns: one rule over an array, not a copy of it per column."""
    cells = F.array(*[F.when(filled(df, c), col(c).cast("string")) for c in names])
    return F.exists(F.array_compact(cells.cast("array<string>")), bad)


def adaptive_confidence(df: DataFrame, critical: list[str], had_norm: Column) -> Column:
    """1.0 minus penalties for flags, missing critical cells, anomalies and changes, within 0.5..1."""
    def minus(condition: Column, penalty: float) -> Column:
        return F.when(condition, F.lit(penalty)).otherwise(F.lit(0.0))

    c = F.lit(1.0)
    for flag in ("is_valid_email", "is_valid_date"):
        if flag in df.columns:
            c -= minus(~F.coalesce(col(flag), F.lit(True)), 0.1)
    if "is_valid_numeric" in df.columns:
        c -= minus(~F.coalesce(col("is_valid_numeric"), F.lit(False)), 0.1)
    if critical:
        gone = [~filled(df, n) if n in df.columns else F.lit(True) for n in critical]
        c -= minus(any_of(gone), 0.2)
    if "is_anomaly" in df.columns:
        c -= minus(F.coalesce(col("is_anomaly"), F.lit(False)), 0.15)
    c -= minus(had_norm, 0.05)
    return F.greatest(F.lit(0.5), F.least(F.lit(1.0), c))


# ---- imputation ----------------------------------------------------------------------------------


def tag_cells(df: DataFrame, filled_now: dict[str, Column], method: str, track: bool = True) -> Column:
    """The imputation record extended by the cells for which ``filled_now`` holds."""
    before = col(IMPUTED) if IMPUTED in df.columns else F.lit(None).cast("map<string,string>")
    if not track or not filled_now:
        return before
    entries = F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(c).alias("key"), F.lit(method).alias("value")))
        for c, cond in filled_now.items()
    ]))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.when(F.size(entries) == 0, before).otherwise(
        F.map_concat(F.coalesce(before, empty), F.map_from_entries(entries))
    )


def imputation_medians(df: DataFrame, profile_rows: list, dataset_type: str, mode: str = "safe",
                       min_values: int = 3) -> dict[str, float]:
    """The medians that may fill a column: permitted numeric columns with enough values."""
    if dataset_type == "analytical":
        return {}
    names = [
        r["column"] for r in profile_rows
        if r["inferred_type"] in ("numeric", "monetary") and r["allows_imputation"]
        and r["column"] in numeric_columns(df)
    ]
    if not names:
        return {}
    counts = df.agg(F.count("*").alias("rows"), *[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(names)]).first()
    sizes = {c: counts[f"n{i}"] for i, c in enumerate(names)}
    chosen = [c for c in names if sizes[c] >= max(2, min_values)]
    if mode == "strict":
        chosen = [c for c in chosen if (counts["rows"] - sizes[c]) / counts["rows"] < 0.20]
    chosen = [c for c in chosen if sizes[c] < counts["rows"]]
    return {c: m for c, m in medians(df, chosen, sizes).items() if m is not None}


def fill_medians(df: DataFrame, fills: dict[str, float], track: bool = True) -> DataFrame:
    """Fill NULL numbers; a whole-number column stays one when its median is whole."""
    if not fills:
        return df
    new = {}
    for c, m in fills.items():
        whole = c in integral_columns(df) and m == int(m)
        x = col(c) if whole or c not in integral_columns(df) else col(c).cast("double")
        new[c] = F.coalesce(x, F.lit(int(m) if whole else float(m)))
    tags = tag_cells(df, {c: col(c).isNull() for c in fills}, "median", track)
    return df.withColumns({**new, IMPUTED: tags} if track else new)


def impute_median(df: DataFrame, profile_rows: list, dataset_type: str, mode: str = "safe",
                  min_values: int = 3, track: bool = True) -> DataFrame:
    """Median imputation with a record of the filled cells."""
    return fill_medians(df, imputation_medians(df, profile_rows, dataset_type, mode, min_values), track)


def fill_placeholders(df: DataFrame, names: list[str], placeholder: str, method: str, track: bool = True) -> DataFrame:
    """Fill missing text cells of the named columns with an opted-in placeholder."""
    names = [c for c in names if c in string_columns(df)]
    if not names:
        return df
    new = {c: F.when(filled(df, c), col(c)).otherwise(F.lit(placeholder)) for c in names}
    tags = tag_cells(df, {c: ~filled(df, c) for c in names}, method, track)
    return df.withColumns({**new, IMPUTED: tags} if track else new)


def fill_safe_defaults(df: DataFrame, boolean_names: list[str], dataset_type: str) -> DataFrame:
    """Missing booleans become false, except in analytical data; no other type gets a default."""
    if dataset_type == "analytical" or not boolean_names:
        return df
    return df.withColumns({c: F.coalesce(col(c), F.lit(False)) for c in boolean_names})


def quality_score(null_rate_after: Column, rows_in: Column, rows_out: Column, fixed: Column, fields: Column) -> Column:
    """1.0 minus penalties for missing cells, removed rows and repaired cells, four digits."""
    rows = F.greatest(rows_in, F.lit(1))
    score = (
        F.lit(1.0)
        - F.least(null_rate_after * 0.5, F.lit(0.25))
        - F.least((rows_in - rows_out) / rows * 0.3, F.lit(0.15))
        - F.least(fixed / F.greatest(rows_in * fields, F.lit(1)) * 0.5, F.lit(0.20))
    )
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4)
