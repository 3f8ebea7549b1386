"""Numeric summaries, top lists, dashboards and cleaning statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline import functions as X
from siftline.operators.cells import number_lanes
from siftline.operators.columns import ROW_ID, col, content_columns, row_key
from siftline.operators.ranks import head_rows


def _value_rank_like(s: Column) -> Column:
    """Rank test of the summary: it looks at the values only, without limits on start and span."""
    return (
        (s["n"] >= 2)
        & (F.try_divide(s["wholes"], s["n"]) >= 0.80)
        & (F.try_divide(s["smalls"], s["n"]) >= 0.80)
        & (s["max_whole"] > s["min_whole"])
    )


def _column_facts(df: DataFrame) -> DataFrame:
    """One aggregate row over all numeric columns, turned into one row per column: no shuffle of cells."""
    facts = []
    for c, lane in number_lanes(df).items():
        if c.startswith("_"):
            continue
        x = F.nanvl(col(lane).cast("double"), F.lit(None))
        whole = x == F.floor(x)
        facts.append(F.struct(
            F.lit(c).alias("column"),
            F.lit(len(facts)).alias("position"),
            F.count(x).alias("n"),
            F.avg(x).alias("mean"),
            F.min(x).alias("low"),
            F.max(x).alias("high"),
            F.count_if(whole).alias("wholes"),
            F.count_if(whole & x.between(1, 100)).alias("smalls"),
            F.min(F.when(whole, x)).alias("min_whole"),
            F.max(F.when(whole, x)).alias("max_whole"),
        ))
    if not facts:
        empty = ("column string, position int, n bigint, mean double, low double, high double, "
                 "wholes bigint, smalls bigint, min_whole double, max_whole double")
        return df.sparkSession.createDataFrame([], empty)
    return df.agg(F.array(*facts).alias("facts")).select(F.inline("facts"))


def rank_like_columns(df: DataFrame) -> DataFrame:
    """Which numeric columns the summary takes for ranks."""
    facts = _column_facts(df)
    s = {c: F.col(c) for c in facts.columns}
    return facts.filter("n > 0").select("column", F.coalesce(_value_rank_like(s), F.lit(False)).alias("rank_like"))


def numeric_summary(df: DataFrame, confirmed: list[str] | None = None) -> DataFrame:
    """Average (four digits), bounds and count per numeric column.

    With ``confirmed`` only those columns count; without, rank-like columns are left out.
    """
    facts = _column_facts(df).filter("n > 0")
    if confirmed is not None:
        facts = facts.filter(F.col("column").isin(confirmed))
    else:
        s = {c: F.col(c) for c in facts.columns}
        facts = facts.filter(~F.coalesce(_value_rank_like(s), F.lit(False)))
    return facts.select(
        "column", F.bround("mean", 4).alias("avg"), F.col("low").alias("min"), F.col("high").alias("max"),
        F.col("n").alias("count"), "position",
    )


def location_distribution(df: DataFrame, most: int | None = None) -> DataFrame:
    """Cities (else locations) by frequency, first seen first on ties; only the ``most`` frequent if asked for."""
    named = [X.nonblank(col(c).cast("string")) for c in ("city", "location") if c in df.columns]
    if not named:
        return df.sparkSession.createDataFrame([], "place string, n bigint")
    places = (
        df.groupBy(F.coalesce(*named).alias("place"))
        .agg(F.count("*").alias("n"), F.min(ROW_ID).alias("seen"))
        .filter(F.col("place").isNotNull())
        .orderBy(F.desc("n"), "seen")
    )
    return (places if most is None else places.limit(most)).select("place", "n")


def dashboard(df: DataFrame, confirmed: list[str] | None = None, preview: int = 10) -> dict[str, DataFrame]:
    """Summary row, the five best-filled numeric columns, cities and the first rows."""
    numbers = numeric_summary(df, confirmed)
    cities = location_distribution(df)
    top = numbers.orderBy(F.desc("count"), "position").limit(5)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("by"), "position", "column")))
    summary = (
        df.agg(F.count("*").alias("total_records"))
        .join(numbers.agg(F.count("*").alias("numeric_field_count")))
        .join(top.agg(F.array_join(F.transform(ordered, lambda t: t["column"]), "; ").alias("top_numeric_fields")))
        .join(cities.agg(F.count("*").alias("unique_cities")))
    )
    return {
        "summary": summary,
        "numeric_series": top.drop("position"),
        "city_distribution": cities,
        "records": head_rows(df, preview),
    }


def cleaning_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows processed and rows changed, by row number; only digests of the rows are shuffled."""
    names = [c for c in content_columns(after) if c in before.columns]

    def digest(df: DataFrame) -> DataFrame:
        cells = F.struct(*[col(c) for c in names])
        return df.select(*row_key(df), F.unhex(F.sha2(F.to_json(cells), 256)).alias("digest"))

    pairs = digest(after).alias("a").join(digest(before).alias("b"), row_key(after), "left")
    changed = F.col("b.digest").isNotNull() & (F.col("a.digest") != F.col("b.digest"))
    return pairs.agg(F.count("*").alias("rows_processed"), F.count_if(changed).alias("rows_modified"))
