"""Rows from document text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline import functions as X


def extract_records(docs: DataFrame, text: str = "text", most: int | None = None, max_chars: int | None = None) -> DataFrame:
    """Rows of detected names, amounts and dates per document, at least one.

    The lists are aligned by place, and a list that is too short repeats its first item. Texts are
    read whole unless ``max_chars`` is given, and all finds become rows unless ``most`` is given.
    """
    body = F.col(text) if max_chars is None else F.left(F.col(text), F.lit(max_chars))
    keys = [c for c in docs.columns if c != text]
    found = docs.select(
        *keys,
        F.coalesce(X.strip(body) != "", F.lit(False)).alias("__filled"),
        X.extract_names(body, most).alias("__names"),
        X.extract_amounts(body, most).alias("__amounts"),
        X.extract_dates(body).alias("__dates"),
    )
    longest = F.greatest(*[F.coalesce(F.size(f"__{k}"), F.lit(0)) for k in ("names", "amounts", "dates")])
    rows = found.withColumn("__any", longest > 0).select(
        "*", F.explode(F.sequence(F.lit(0), F.greatest(longest if most is None else F.least(longest, F.lit(most)), F.lit(1)) - 1)).alias("__i")
    )

    def item(name: str) -> Column:
        return F.coalesce(F.get(F.col(name), F.col("__i")), F.get(F.col(name), F.lit(0)))

    date = item("__dates")
    return rows.select(
        *keys,
        F.col("__i").alias("place"),
        item("__names").alias("detected_name"),
        item("__amounts").alias("detected_amount"),
        date.alias("detected_date"),
        F.when(~F.col("__filled"), F.lit(0.35)).when(~F.col("__any"), F.lit(0.4)).otherwise(F.lit(0.5)).alias("confidence"),
        F.lit(False).alias("is_anomaly"),
        F.lit(True).alias("is_valid_email"),
        (date.isNull() | X.parse_date(date).isNotNull()).alias("is_valid_date"),
        F.lit(True).alias("is_valid_numeric"),
    )
