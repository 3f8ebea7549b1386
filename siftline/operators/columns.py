"""Column sets and schema-level operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions import field_name, present, strip, strip_column

ROW_ID = "_row_id"
# The document of a row; with it, ``_row_id`` is the place of the row in its document.
DOCUMENT = "_document"
# Cells beyond the header of their file.
OVERFLOW = "_overflow"
IMPUTED = "__imputed__"

# Column names with a meaning of their own; they are never profiled as content.
FLAGS = ["confidence", "is_anomaly", "is_valid_email", "is_valid_date", "is_valid_numeric"]
RESERVED = FLAGS + ["is_outlier"]
ARTIFACTS = RESERVED + ["imputed", IMPUTED]


def content_columns(df: DataFrame) -> list[str]:
    """Columns that hold data: no flags, no row key, no ``__`` names."""
    return [c for c in df.columns if c not in (*RESERVED, ROW_ID, DOCUMENT, OVERFLOW) and not c.startswith("__")]


def row_key(df: DataFrame) -> list[str]:
    """The columns that name a row: its document, if there are documents, and its number."""
    return [c for c in (DOCUMENT, ROW_ID) if c in df.columns]


def _of_type(df: DataFrame, *types: type) -> list[str]:
    wanted = set(content_columns(df))
    return [f.name for f in df.schema if f.name in wanted and isinstance(f.dataType, types)]


def string_columns(df: DataFrame) -> list[str]:
    return _of_type(df, T.StringType)


def numeric_columns(df: DataFrame) -> list[str]:
    return _of_type(df, T.NumericType)


def integral_columns(df: DataFrame) -> list[str]:
    return _of_type(df, T.IntegralType)


def boolean_columns(df: DataFrame) -> list[str]:
    return _of_type(df, T.BooleanType)


def date_columns(df: DataFrame) -> list[str]:
    return _of_type(df, T.DateType, T.TimestampType, T.TimestampNTZType)


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def filled(df: DataFrame, name: str) -> Column:
    """True where the cell is neither NULL nor blank (never NULL itself)."""
    return present(col(name)) if isinstance(df.schema[name].dataType, T.StringType) else col(name).isNotNull()


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def total_of(numbers: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, numbers, F.lit(0))


def fingerprint(df: DataFrame, name: str) -> Column:
    """Case- and blank-insensitive text of a cell, NULL kept."""
    if not isinstance(df.schema[name].dataType, T.StringType):
        return F.lower(strip(col(name).cast("string")))
    return F.lower(strip_column(col(name)))


def normalize_headers(df: DataFrame) -> DataFrame:
    """Snake-case names; unnamed columns go, and of equal names the last column stays in first place."""
    key = row_key(df)
    last = {field_name(c): c for c in df.columns if c not in key and field_name(c)}
    return df.select(*key, *[col(old).alias(new) for new, old in last.items()])


def enforce_schema(dfs: list[DataFrame]) -> DataFrame:
    """Union of all rows over the union of all columns; missing cells are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def column_order(names: list[str]) -> list[str]:
    """Content A-Z, then flags A-Z, then the imputation record."""
    flags = sorted(n for n in names if n in RESERVED)
    other = sorted(n for n in names if n.startswith("__") and n not in (IMPUTED,))
    content = sorted(n for n in names if n not in flags and n not in other and n not in (IMPUTED, ROW_ID, DOCUMENT))
    ends = [n for n in (IMPUTED,) if n in names]
    starts = [n for n in (DOCUMENT, ROW_ID) if n in names]
    return starts + content + flags + other + ends


def order_columns(df: DataFrame) -> DataFrame:
    return df.select(*[col(c) for c in column_order(df.columns)])


def strip_artifacts(df: DataFrame) -> DataFrame:
    """Drop flags and ``__`` columns."""
    gone = [c for c in df.columns if c in ARTIFACTS or c.startswith("__")]
    return df.drop(*gone)


def drop_blank_rows(df: DataFrame) -> DataFrame:
    """Rows with at least one cell that is neither NULL nor blank."""
    return df.filter(any_of([filled(df, c) for c in content_columns(df)]))
