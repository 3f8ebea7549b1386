"""Exact order statistics without sorting or collecting a whole column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators.columns import ROW_ID, any_of, col

# At most this many numbers per job are gathered in one place; larger brackets are narrowed first.
GATHERED = 2_000_000
ACCURACY = 10_000


def values_at_ranks(df: DataFrame, wanted: dict[str, list[int]], sizes: dict[str, int]) -> dict[tuple[str, int], float]:
    """The elements at the given 0-based ranks of numeric columns, NULLs left out.

    ``sizes`` holds the number of non-NULL cells per column. Each round brackets every rank that is
    still open with ``percentile_approx`` and counts the cells around the bracket, so a column of any
    size shrinks by about a thousand times per pass. Only brackets below ``GATHERED`` are sorted.
    """
    found: dict[tuple[str, int], float] = {}
    still = [
        {"key": (c, r), "rank": r, "size": sizes[c], "low": None, "high": None}
        for c, ranks in wanted.items()
        for r in sorted(set(ranks))
        if 0 <= r < sizes[c]
    ]

    def inside(t):
        x = col(t["key"][0])
        bounded = x.isNotNull()
        if t["low"] is not None:
            bounded &= x > t["low"]
        if t["high"] is not None:
            bounded &= x < t["high"]
        return bounded

    while still:
        limit = GATHERED // len(still)
        big = [t for t in still if t["size"] > limit]
        small = [t for t in still if t["size"] <= limit]
        if small:
            picks = [
                F.get(
                    F.sort_array(F.collect_list(F.when(inside(t), col(t["key"][0])))), F.lit(t["rank"])
                ).alias(f"v{i}")
                for i, t in enumerate(small)
            ]
            row = df.agg(*picks).first()
            for i, t in enumerate(small):
                found[t["key"]] = row[i]
        still = big
        if not big:
            break
        guesses = []
        for i, t in enumerate(big):
            share = t["rank"] / t["size"]
            ends = [max(0.0, share - 2 / ACCURACY), min(1.0, share + 2 / ACCURACY)]
            x = F.when(inside(t), col(t["key"][0]))
            guesses.append(F.percentile_approx(x, ends, ACCURACY).alias(f"g{i}"))
        bounds = df.agg(*guesses).first()
        counts = []
        for i, t in enumerate(big):
            x, (a, b) = col(t["key"][0]), bounds[i]
            for name, part in (("lt", x < a), ("a", x == a), ("mid", (x > a) & (x < b)), ("b", (x == b) & (x > a))):
                counts.append(F.count_if(inside(t) & part).alias(f"{name}{i}"))
        row = df.agg(*counts).first()
        for i, t in enumerate(list(big)):
            a, b = bounds[i]
            rank = t["rank"]
            for part, size in (("lt", row[f"lt{i}"]), ("a", row[f"a{i}"]), ("mid", row[f"mid{i}"]), ("b", row[f"b{i}"])):
                if rank < size:
                    break
                rank -= size
            else:
                part, size = "gt", t["size"] - sum(row[f"{p}{i}"] for p in ("lt", "a", "mid", "b"))
            if part in ("a", "b"):
                found[t["key"]] = a if part == "a" else b
                still.remove(t)
                continue
            t["rank"], t["size"] = rank, size
            if part in ("mid", "gt"):
                t["low"] = a if part == "mid" else b
            if part in ("lt", "mid"):
                t["high"] = a if part == "lt" else b
    return found


def _sizes(df: DataFrame, names: list[str]) -> dict[str, int]:
    row = df.agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(names)]).first()
    return {c: row[i] for i, c in enumerate(names)}


def medians(df: DataFrame, names: list[str], sizes: dict[str, int] | None = None) -> dict[str, float | None]:
    """Exact median of each numeric column; NULL for columns without numbers."""
    if not names:
        return {}
    numbers = df.select(*[col(c).cast("double").alias(c) for c in names])
    sizes = sizes or _sizes(numbers, names)
    wanted = {c: [(sizes[c] - 1) // 2, sizes[c] // 2] for c in names if sizes[c]}
    at = values_at_ranks(numbers, wanted, sizes)
    return {c: (at[c, wanted[c][0]] + at[c, wanted[c][1]]) / 2 if c in wanted else None for c in names}


def median_of(df: DataFrame, name: str) -> DataFrame:
    """One row with the exact median."""
    value = medians(df, [name])[name]
    return df.sparkSession.range(1).select(F.lit(value).cast("double").alias("median"))


def mode_of(df: DataFrame, name: str) -> DataFrame:
    """One row with the most frequent value; of equally frequent ones the first seen."""
    seen = df.filter(col(name).isNotNull()).groupBy(col(name).alias("mode"))
    counted = seen.agg(F.count("*").alias("n"), F.min(ROW_ID).alias("first_seen"))
    return counted.orderBy(F.desc("n"), "first_seen").limit(1).select("mode", "n")


def outlier_bounds(df: DataFrame, name: str) -> tuple[float, float] | None:
    """The fence 1.5 times the distance between the elements at n//4 and 3n//4; NULL below four numbers."""
    numbers = df.select(col(name).cast("double").alias(name)).filter(~F.isnan(col(name)))
    n = numbers.count()
    if n < 4:
        return None
    at = values_at_ranks(numbers, {name: [n // 4, 3 * n // 4]}, {name: n})
    q1, q3 = at[name, n // 4], at[name, 3 * n // 4]
    spread = q3 - q1
    if spread <= 0:
        spread = abs(q3) or 1.0
    return q1 - 1.5 * spread, q3 + 1.5 * spread


def numeric_outliers(df: DataFrame, name: str) -> DataFrame:
    """Rows whose value lies outside the fence; the values stay as they are."""
    bounds = outlier_bounds(df, name)
    if bounds is None:
        return df.limit(0)
    x = col(name).cast("double")
    return df.filter(any_of([x < bounds[0], x > bounds[1]]) & ~F.isnan(x))


def cap_rows(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows by row number, as a filter on the n-th row number (no global sort)."""
    ids = df.select(ROW_ID)
    size = ids.count()
    if size <= n:
        return df
    last = values_at_ranks(ids, {ROW_ID: [n - 1]}, {ROW_ID: size})[ROW_ID, n - 1]
    return df.filter(col(ROW_ID) <= last)


def head_rows(df: DataFrame, n: int) -> DataFrame:
    """The first few rows by row number.

    Only row numbers are ranked; the rows themselves are then found by a filter that reaches the scan,
    so no column of the other rows is computed.
    """
    last = df.select(ROW_ID).orderBy(ROW_ID).limit(n).agg(F.max(ROW_ID)).first()[0]
    return df.filter(col(ROW_ID) <= F.lit(last)) if last is not None else df.limit(0)
