"""Row deduplication.

Rows with a document are compared within their document only, and their key is the pair of document and place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.operators.columns import DOCUMENT, all_of, col, content_columns, fingerprint, row_key


def _digest(parts: list[Column]) -> Column:
    """A short exact-match key of many filled cells, so that the shuffle does not carry them twice. Each cell is written with
    its length before it, so that cells cannot run into one another."""
    return F.unhex(F.sha2(F.concat(*[t for p in parts for t in (F.length(p).cast("string"), F.lit(":"), p)]), 256))


def _winners(df: DataFrame, key: Column, order: Column | None = None) -> DataFrame:
    """The row of each key that comes first by ``order``, then by row key, under the key of the earliest row.

    The row is an aggregate, so a key that holds a third of all rows leaves one row per map task.
    """
    names = row_key(df)
    place = F.struct(*[col(c) for c in names])
    best = df.groupBy(key.alias("__key")).agg(
        F.min_by(F.struct(*[col(c) for c in df.columns if c not in names]), place if order is None else F.struct(order, place)).alias("__row"),
        F.min(place).alias("__place"),
    )
    return best.select(*[F.col("__place" if c in names else "__row")[c].alias(c) for c in df.columns])


def _document(df: DataFrame) -> list[Column]:
    """A further part of a key: the document, a null one apart from every text."""
    if DOCUMENT not in df.columns:
        return []
    return [F.coalesce(F.concat(F.lit("="), col(DOCUMENT).cast("string")), F.lit("")).alias("__document")]


def dedupe_content(df: DataFrame) -> DataFrame:
    """Rows equal in content, ignoring case and outer blanks: the first wins.

    Rows without any content are equal only if their flags are equal as well.
    """
    content = [F.coalesce(fingerprint(df, c), F.lit("")) for c in sorted(content_columns(df))]
    flags = [
        F.coalesce(col(c).cast("string"), F.lit(""))
        for c in sorted(set(df.columns) - set(content_columns(df)) - set(row_key(df)))
    ]
    blank = all_of([c == "" for c in content])
    return _winners(df, _digest(content + [F.when(blank, f).otherwise(F.lit("")) for f in flags] + _document(df)))


def dedupe_exact(df: DataFrame) -> DataFrame:
    """Wholly equal rows: the first wins."""
    names = row_key(df)
    cells = F.struct(*[col(c) for c in df.columns if c not in names], *_document(df))
    return _winners(df, F.unhex(F.sha2(F.to_json(cells), 256)))


def dedupe_by_keys(df: DataFrame, keys: list[str] | None) -> DataFrame:
    """Rows equal in the keys: the most confident wins, the earliest on ties, in the first one's place.

    ``None`` keeps all rows; no keys at all means exact deduplication. The winner is an aggregate, so
    every map task sends at most one row per key.
    """
    if keys is None:
        return df
    keys = [k for k in keys if k in df.columns]
    if not keys:
        return dedupe_exact(df)
    sure = F.coalesce(col("confidence").cast("double"), F.lit(0.0)) if "confidence" in df.columns else F.lit(0.0)
    parts = [F.coalesce(fingerprint(df, k), F.lit("none")) for k in keys] + _document(df)
    return _winners(df, _digest(parts), -sure)
