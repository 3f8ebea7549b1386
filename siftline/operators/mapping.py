"""Semantic roles of columns and rows rebuilt by role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline import functions as X
from siftline.operators.cells import smart_clean_cells
from siftline.operators.columns import (
    FLAGS, any_of, col, content_columns, drop_blank_rows, filled, normalize_headers, row_key, string_columns,
)
from siftline.operators.profile import collect_profile
from siftline.operators.ranks import head_rows

# Parts of a normalized name that disqualify a column as a source of a role.
INVALID_NAME_PARTS = ["is_valid_", "is_anomaly", "confidence", "__", "imputed", "metadata"]
# Types that fill a role, and the roles that must hold numbers.
ROLES = {"email": "email", "phone": "phone", "date": "date", "monetary": "amount_monetary"}
MONEY_ROLES = ("amount_monetary", "salary_comp")
# Old column names that rows lose on the way.
LEGACY_NAMES = ["person_name", "organization", "amount", "is_outlier"]

FieldMap = dict[str, list[str]]


def _valid_name(name: Column) -> Column:
    norm = X.normalize_field_name(name)
    return (norm != "") & ~any_of([norm.contains(part) for part in INVALID_NAME_PARTS])


def valid_source_columns(columns: DataFrame) -> DataFrame:
    """The rows of a ``(column)`` DataFrame that may serve as the source of a role."""
    return columns.filter(_valid_name(F.col("column")))


def sample_rows(df: DataFrame, sample: int = 8, within: int = 40) -> DataFrame:
    """The first ``sample`` filled rows among the first ``within`` rows, as a local DataFrame."""
    few = drop_blank_rows(head_rows(df, within)).orderBy(*row_key(df)).limit(sample)
    return df.sparkSession.createDataFrame(few.collect(), few.schema)


def classify_fields(rows: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """``(role, column, position)`` by the types that the profile of all rows finds.

    One scan and one shuffle of distinct values, or none where the ``profile`` of these rows is there already.
    ``sample_rows`` gives a few rows where a quick guess is enough. The profile is collected first: Spark would push the
    test of the names down to the cells and make it once per cell instead of once per column.
    """
    role = F.create_map(*[F.lit(w) for pair in ROLES.items() for w in pair])
    return (
        valid_source_columns(collect_profile(rows)[0] if profile is None else profile)
        .filter(F.col("semantic_confidence_high") & F.col("inferred_type").isin(list(ROLES)))
        .select(F.try_element_at(role, F.col("inferred_type")).alias("role"), "column", "position")
    )


def merge_field_maps(base: DataFrame, overlay: DataFrame, valid: DataFrame) -> DataFrame:
    """Union of two ``(role, column)`` maps; overlay columns must be valid names of ``valid(column)``."""
    known = (
        valid_source_columns(overlay.select("role", X.strip(F.col("column")).alias("column")))
        .join(valid.select("column").distinct(), "column", "left_semi")
    )
    return base.select("role", "column").union(known.select("role", "column")).distinct()


def needs_more_roles(field_map: DataFrame) -> DataFrame:
    """One row: the number of filled roles, and whether fewer than two are filled."""
    roles = field_map.agg(F.count_distinct("role").alias("roles"))
    return roles.select("roles", (F.col("roles") < 2).alias("needs_more"))


def field_map_of(rows: DataFrame) -> FieldMap:
    """A ``(role, column[, position])`` DataFrame as a dictionary: one entry per column of one table."""
    order = ["position", "column"] if "position" in rows.columns else ["column"]
    out: FieldMap = {}
    for r in rows.orderBy(*order).collect():
        out.setdefault(r["role"], []).append(r["column"])
    return out


def _role_values(df: DataFrame, field_map: FieldMap) -> dict[str, Column]:
    out = {}
    given = df.sparkSession.createDataFrame([(c,) for c in df.columns], "column string")
    usable = {r["column"] for r in valid_source_columns(given).collect()}
    for role, names in field_map.items():
        picks = []
        for c in names:
            if c not in usable:
                continue
            text = col(c).cast("string")
            ok = filled(df, c)
            if role in MONEY_ROLES:
                ok &= X.parse_number(text).isNotNull()
            picks.append(F.when(ok, text))
        if picks:
            out[role] = F.coalesce(*picks)
    return out


def apply_field_map(df: DataFrame, field_map: FieldMap) -> DataFrame:
    """Per role the first filled cell; roles of money need a number."""
    roles = _role_values(df, field_map)
    return df.select(*row_key(df), *[v.alias(r) for r, v in roles.items()])


def map_row_normalized(df: DataFrame, field_map: FieldMap) -> DataFrame:
    """Per role the first non-empty cell; columns are matched by normalized name."""
    by_norm = normalize_headers(df)
    outs = []
    for role, names in field_map.items():
        cells = [
            F.nullif(col(n).cast("string"), F.lit(""))
            for n in dict.fromkeys(X.field_name(c) for c in names) if n and n in by_norm.columns
        ]
        if cells:
            outs.append(F.coalesce(*cells).alias(role))
    return by_norm.select(*row_key(by_norm), *outs)


def _cells_of(values: list[Column]) -> Column:
    return F.array_compact(F.array(*values)) if values else F.array().cast("array<string>")


def _pattern_flags(cells: Column, shortest: int = 0, trimmed: bool = False) -> tuple[Column, Column]:
    """E-mail and date flags from the cells that look like one: any valid address, no broken date.

    One lambda over the cells, so the plan does not grow with the width of the table. ``cells`` is a column of
    ``_cells_of``, laid out in a projection of its own.
    """
    mails = F.exists(cells, lambda v: X.looks_like_email(v, trimmed))
    valid = F.exists(cells, lambda v: X.is_valid_email(v))
    broken = F.exists(
        cells, lambda v: X.looks_like_date(v, trimmed) & (F.length(v) >= shortest) & X.parse_date(v, trimmed).isNull()
    )
    return ~mails | valid, ~broken


def semantic_rows(df: DataFrame, field_map: FieldMap, keep_surplus: bool = False, clean: bool = True) -> DataFrame:
    """Rows by role, with flags, and the remaining columns under normalized names, cleaned.

    Mapped columns go, so two date columns collapse into one; ``keep_surplus=True`` keeps them. ``clean=False`` leaves the
    remaining columns as they are, for a following ``coerce_rows`` that cleans every cell anyway.
    """
    roles = _role_values(df, field_map)
    used = set() if keep_surplus else {X.field_name(c) for names in field_map.values() for c in names}
    last = {X.field_name(c): c for c in content_columns(df) if X.field_name(c)}
    rest = [n for n in last if n not in used and n not in roles and n not in FLAGS]
    picked = df.select(
        *row_key(df), *[v.alias("__role_" + r) for r, v in roles.items()], *[col(last[n]).alias(n) for n in rest]
    )
    picked = (smart_clean_cells(picked) if clean else picked).withColumn(
        "__cells", _cells_of([X.strip_column(col("__role_" + r)) for r in roles])
    )
    mail_ok, date_ok = _pattern_flags(col("__cells"), trimmed=True)
    return picked.select(
        *row_key(df),
        *[col("__role_" + r).alias(r) for r in roles],
        mail_ok.alias("is_valid_email"),
        date_ok.alias("is_valid_date"),
        F.lit(True).alias("is_valid_numeric"),
        F.lit(1.0).alias("confidence"),
        F.lit(False).alias("is_anomaly"),
        *[col(n) for n in rest],
    )


def coerce_rows(df: DataFrame) -> DataFrame:
    """Every cell cleaned by its pattern, flags from the patterns, confidence clamped to 0..1."""
    marks = [c for c in ("is_anomaly", "is_outlier") if c in df.columns]
    anomaly = F.coalesce(col(marks[0]).cast("boolean"), F.lit(False)) if marks else F.lit(False)
    given = col("confidence").cast("double") if "confidence" in df.columns else F.lit(0.75)
    names = [c for c in content_columns(df) if c not in LEGACY_NAMES]
    clean = smart_clean_cells(df.select(
        *row_key(df), *[col(c) for c in names], given.alias("__given"), anomaly.alias("__anomaly")
    ))
    clean = clean.withColumn("__cells", _cells_of([col(c) for c in string_columns(clean)]))
    mail_ok, date_ok = _pattern_flags(col("__cells"), shortest=6, trimmed=True)
    return clean.select(
        *row_key(df), *[col(c) for c in names],
        mail_ok.alias("is_valid_email"),
        date_ok.alias("is_valid_date"),
        F.lit(True).alias("is_valid_numeric"),
        F.least(F.greatest(F.coalesce(col("__given"), F.lit(0.75)), F.lit(0.0)), F.lit(1.0)).alias("confidence"),
        col("__anomaly").alias("is_anomaly"),
    )
