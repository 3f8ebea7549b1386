"""Whole-table cell cleaning, driven by values or by a column profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline import functions as X
from siftline.functions.text import BLANK
from siftline.operators.columns import (
    any_of, boolean_columns, col, content_columns, date_columns, filled,
    numeric_columns, string_columns, total_of,
)
from siftline.operators.profile import name_suggests_money

NUMBER_SUFFIX = "_number"


def _replaced(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else col(c) for c in df.columns])


def clean_cells(df: DataFrame) -> DataFrame:
    """Heavy cleaning of every text cell; column names are trimmed; other types stay."""
    cleaned = {}
    for c in string_columns(df):
        text = X.clean_cell(col(c))
        if "department" in c.lower():
            text = X.nonblank(F.regexp_replace(text, BLANK + "+", " "))
        cleaned[c] = text
    out = _replaced(df, cleaned)
    return out.withColumnsRenamed({c: c.strip() for c in df.columns if c != c.strip()})


def _smart(s: Column) -> Column:
    """Clean trimmed text by its own pattern: address, phone, date, else as it is."""
    iso = F.when((F.length(s) >= 6) & X.looks_like_date(s, trimmed=True), X.parse_date(s, trimmed=True))
    return (
        F.when(X.looks_like_email(s, trimmed=True), F.lower(s))
        .when(X.looks_like_phone(s), F.when(s.rlike("[^ -~]|  "), F.regexp_replace(s, BLANK + "+", " ")).otherwise(s))
        .otherwise(F.coalesce(iso, s))
    )


def _typed(s: Column, kind: str) -> Column:
    if kind == "email":
        return X.normalize_email(s)
    if kind == "phone":
        return X.normalize_phone(s)
    if kind == "date":
        return F.coalesce(X.parse_date(s, trimmed=True), s)
    if kind in ("numeric", "monetary"):
        return X.parse_number(s)
    if kind == "identifier":
        return s
    return _smart(s)


def smart_clean_cells(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Clean each cell by its column's semantic type where ``types`` names one, else by its own pattern.

    Numbers become DOUBLE.
    """
    types = types or {}
    # Trimmed in a projection of its own, which Spark does not inline into its many uses.
    df = _replaced(df, {c: F.nullif(X.strip_column(col(c)), F.lit("")) for c in string_columns(df)})
    new = {c: _typed(col(c), types.get(c, "")) for c in string_columns(df)}
    new |= {c: F.nanvl(col(c).cast("double"), F.lit(None)) for c in numeric_columns(df)}
    return _replaced(df, new)


# ---- schema cleanup of text that looks numeric ---------------------------------------------------


def _coercible(name: str) -> Column:
    """Numeric-looking text, but not a bare number of up to three digits unless the name speaks of money."""
    looks = X.is_numeric_like(col(name))
    return looks if name_suggests_money(name) else looks & ~X.is_bare_small_int(col(name))


def prune_and_coerce(df: DataFrame, erase_unparsed: bool = False) -> DataFrame:
    """Blank cells become NULL and numeric-looking text moves to a DOUBLE lane ``<name>_number``.

    A Spark column has one type, so text that stays text keeps its own column. ``had_norm`` tells
    whether the row was changed. Text that only looks numeric (``2024-01-12``) is kept;
    ``erase_unparsed=True`` erases it.
    """
    outs, changes = [], []
    texts, content = string_columns(df), content_columns(df)
    wanted = {c: F.coalesce(_coercible(c), F.lit(False)) for c in texts}
    # The numbers stand beside the cells in a projection of their own, so each is read off once for its three uses.
    beside = df.withColumns({f"__read{i}": F.when(wanted[c], X.parse_number(col(c))) for i, c in enumerate(texts)})
    for c in df.columns:
        if c not in texts:
            outs.append(col(c))
            if c in content:
                changes.append(col(c).isNull())
            continue
        number = col(f"__read{texts.index(c)}")
        gone = number.isNotNull() | (wanted[c] if erase_unparsed else F.lit(False))
        outs += [
            F.when(X.present(col(c)) & ~gone, col(c)).alias(c),
            number.alias(c + NUMBER_SUFFIX),
        ]
        changes += [~X.present(col(c)), gone]
    return beside.select(*outs, any_of(changes).alias("had_norm"))


def settle_lanes(df: DataFrame) -> DataFrame:
    """Join the two lanes of ``prune_and_coerce`` again, each column with one type.

    A column without text left becomes DOUBLE. A mixed column stays text, and its number lane is kept
    as ``__<name>_number``. One aggregate over the table decides.
    """
    pairs = [c for c in string_columns(df) if c + NUMBER_SUFFIX in df.columns]
    if not pairs:
        return df
    counted = df.agg(*[
        e for i, c in enumerate(pairs)
        for e in (F.count(col(c)).alias(f"t{i}"), F.count(col(c + NUMBER_SUFFIX)).alias(f"n{i}"))
    ]).first()
    outs = []
    for c in df.columns:
        if c.endswith(NUMBER_SUFFIX) and c[: -len(NUMBER_SUFFIX)] in pairs:
            continue
        if c not in pairs:
            outs.append(col(c))
            continue
        i, number = pairs.index(c), col(c + NUMBER_SUFFIX)
        if not counted[f"n{i}"]:
            outs.append(col(c))
        elif not counted[f"t{i}"]:
            outs.append(number.alias(c))
        else:
            shown = F.when(X.is_whole(number), number.cast("bigint").cast("string")).otherwise(number.cast("string"))
            outs += [F.coalesce(col(c), shown).alias(c), number.alias("__" + c + NUMBER_SUFFIX)]
    return df.select(*outs)


def number_lanes(df: DataFrame) -> dict[str, str]:
    """Column name to the physical column that holds its numbers."""
    lanes = {c: c for c in numeric_columns(df)}
    for c in df.columns:
        if c.startswith("__") and c.endswith(NUMBER_SUFFIX):
            lanes[c[2: -len(NUMBER_SUFFIX)]] = c
    return lanes


def row_numeric_valid(df: DataFrame) -> Column:
    """False if any numeric-looking text of the row does not parse."""
    cells = F.array_compact(F.array(*[col(c) for c in string_columns(df)]).cast("array<string>"))
    return ~F.exists(cells, lambda v: X.is_numeric_like(v) & X.parse_number(v).isNull())


# ---- normalization by semantic type --------------------------------------------------------------


def _cleans_noise(df: DataFrame, name: str, row, dataset_type: str) -> bool:
    """Whether the cells of a column only lose their noise, and texts change their case."""
    if name not in string_columns(df):
        return False
    return dataset_type == "analytical" or row["inferred_type"] in ("identifier", "text", "categorical")


def _noise(i: int) -> Column:
    return col(f"__clean{i}")


def _noise_beside(df: DataFrame, profile_rows: list, dataset_type: str) -> DataFrame:
    """``df`` with the noise removed beside the cells that need it, and dates trimmed; this column is used many times below."""
    return df.withColumns({
        f"__clean{i}": X.clean_noise(col(r["column"])) if _cleans_noise(df, r["column"], r, dataset_type)
        else X.strip_column(col(r["column"]))
        for i, r in enumerate(profile_rows)
        if _cleans_noise(df, r["column"], r, dataset_type) or _reads_date(df, r["column"], r)
    })


def _reads_date(df: DataFrame, name: str, row) -> bool:
    return name in string_columns(df) and row["inferred_type"] == "date"


def _by_type(
    df: DataFrame, name: str, row, dataset_type: str, clean: Column, given: Column | None = None
) -> tuple[Column, Column]:
    """The normalized cell, and whether it differs from a filled original.

    ``clean`` is the cell without noise where ``_cleans_noise`` holds, and the trimmed one of a date; ``given`` is the
    normalized cell if it is there.
    """
    new, differs = _normal(df, name, row, dataset_type, clean)
    return new, differs(new if given is None else given)


def _normal(df: DataFrame, name: str, row, dataset_type: str, clean: Column):
    """The normalized cell, and a function of it that tells whether it differs from a filled original."""
    c, kind = col(name), row["inferred_type"]
    never = lambda new: F.lit(False)
    is_text, is_number = name in string_columns(df), name in numeric_columns(df)
    there = filled(df, name)
    if dataset_type == "analytical":
        if not is_text:
            return c, never
        return F.when(there, clean), lambda new: there & (new != c)
    if name in date_columns(df):
        return F.date_format(c, "yyyy-MM-dd"), never
    if kind == "phone":
        digits = X.phone_digits(c.cast("string"))
        new = F.when(F.length(digits).between(10, 15), digits)
        return new, lambda new: there & (F.lit(True) if is_number else ~new.eqNullSafe(c))
    if kind == "boolean" and name not in boolean_columns(df):
        value = X.coerce_bool(c) if is_text else F.when(c.isin(0, 1), c == 1)
        changed = lambda new: there & value.isNotNull() if is_text else F.lit(False)
        if row["bool_hits"] == row["filled"]:
            return value, changed
        # Some cells are not booleans: keep them, as text.
        word = F.initcap(value.cast("string"))
        return (F.coalesce(word, F.when(there, c)) if is_text else c), changed
    if not is_text:
        return c, never
    if kind in ("numeric", "monetary"):
        return F.when(there, X.coerce_number(c)), lambda new: there
    if kind == "email":
        new = F.when(X.is_valid_email(c), F.lower(X.strip(c)))
    elif kind == "date":
        new = X.parse_date(clean, trimmed=True)
    else:
        s = clean
        if kind in ("text", "categorical"):
            s = F.when(s.contains("@") | s.contains("://"), s).otherwise(X.title_case(s))
        new = F.when(there, s)
    return new, lambda new: there & ~new.eqNullSafe(c)


def normalize_by_type(df: DataFrame, profile_rows: list, dataset_type: str) -> DataFrame:
    """Normalize every profiled cell by its column's type; columns get the type's Spark type.

    Analytical data only loses textual noise. ``normalization_counts`` tells how many cells change.
    """
    new = {r["column"]: _by_type(df, r["column"], r, dataset_type, _noise(i))[0] for i, r in enumerate(profile_rows)}
    beside = _noise_beside(df, profile_rows, dataset_type)
    return beside.select(*[new[c].alias(c) if c in new else col(c) for c in df.columns])


def normalized_and_counted(df: DataFrame, profile_rows: list, dataset_type: str) -> DataFrame:
    """``normalize_by_type`` with ``__changed`` and ``__nulled``: the changed cells of a row, and the filled cells
    that become NULL.

    The normalized cells stand beside the old ones in a projection of their own, so each is computed once for its value
    and both counts.
    """
    names = [r["column"] for r in profile_rows]
    beside = _noise_beside(df, profile_rows, dataset_type)
    beside = beside.withColumns({
        f"__new{i}": _by_type(df, r["column"], r, dataset_type, _noise(i))[0] for i, r in enumerate(profile_rows)
    })
    changed, nulled = [], []
    for i, r in enumerate(profile_rows):
        differs = _by_type(df, r["column"], r, dataset_type, _noise(i), col(f"__new{i}"))[1]
        changed.append(F.coalesce(differs, F.lit(False)).cast("int"))
        nulled.append((filled(df, r["column"]) & col(f"__new{i}").isNull()).cast("int"))
    new = {c: col(f"__new{i}") for i, c in enumerate(names)}
    return beside.select(
        *[new[c].alias(c) if c in new else col(c) for c in df.columns],
        total_of(changed).alias("__changed"), total_of(nulled).alias("__nulled"),
    )


def normalization_counts(df: DataFrame, profile_rows: list, dataset_type: str) -> DataFrame:
    """One row: changed cells and cells that become NULL."""
    return normalized_and_counted(df, profile_rows, dataset_type).agg(
        F.coalesce(F.sum("__changed"), F.lit(0)).alias("changed_cells"),
        F.coalesce(F.sum("__nulled"), F.lit(0)).alias("nulled_cells"),
    )
