"""Whitening by a covariance that is exact until it is divided: variances of dimensions and of sums of two of them.

Entries become whole numbers. With ``d = n * x - S`` every squared centred value is a whole number too, and so are
their sums ``Q(i)`` over ``d_i`` and ``Q(i, j)`` over ``d_i + d_j``; polarisation gives each covariance as
``(Q(i, j) - Q(i) - Q(j)) / (2 n^3)`` with one rounding. Tasks add squares of ``y = x - m``, where ``m`` is the whole
part of the mean and ``r = S - n * m`` what is left, so that numbers stay small: ``Q / n = n * sum(y^2) - r^2``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.tables import stored

SCALE = 256
ROWS = 1024  # rows whose squares are added at once
LIMB = 60  # bits of the lower of two numbers that carry a sum of any size
EXACT = Decimal(10) ** 38  # decimals end here


def whole_numbers(vector: Column) -> Column:
    """``floor(256 * c)`` of every entry, as long; beyond a long its nearest end."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * F.lit(float(SCALE))).cast("bigint"))


def is_finite(vector: Column) -> Column:
    """True for a vector all of whose entries are there and finite."""
    wide = vector.cast("array<double>")
    good = F.forall(wide, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return F.coalesce(good, F.lit(False))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The rows of an array column whose lists have ``dims`` entries each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


@dataclass
class Centre:
    """Rows, whole centre and remainder of each dimension, and the farthest that an entry lies from its centre."""

    n: int
    whole: list[int]
    left: list[int]
    reach: int

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """``x - whole``; in Python numbers where it might not fit."""
        if self.reach < 1 << 62:
            return x - np.array(self.whole, np.int64)
        return x.astype(object) - np.array(self.whole, object)

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of ``(n * x - S) ** 2``, exact."""
        y = self.offsets(x)
        if len(self.whole) * (self.n * (self.reach + 1)) ** 2 >= 1 << 63:
            y = y.astype(object)
        left = np.array(self.left, y.dtype)
        d = y * self.n - left
        return (d * d).sum(axis=1).tolist()

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S / n`` in double precision."""
        return self.offsets(x).astype(float) - np.array([r / self.n for r in self.left])


def _limbs(value: int) -> tuple[Decimal, Decimal]:
    return Decimal(value >> LIMB), Decimal(value & ((1 << LIMB) - 1))


def _number(high: Decimal, low: Decimal) -> int:
    return (int(high) << LIMB) + int(low)


def find_centre(fit: DataFrame, dims: int) -> Centre:
    """Sums and extremes of each dimension of ``fit``, one row a dimension to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, low, high = 0, np.zeros(dims, object), np.full(dims, 1 << 62), np.full(dims, -(1 << 62))
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                x = matrix(batch.column(0).slice(s, ROWS), dims)
                # Halves of 32 bits, so that no sum of a block overflows.
                sums += (x >> 32).sum(axis=0).astype(object) * (1 << 32) + (x & 0xFFFFFFFF).sum(axis=0).astype(object)
                low = x.min(axis=0) if n == 0 else np.minimum(low, x.min(axis=0))
                high = x.max(axis=0) if n == 0 else np.maximum(high, x.max(axis=0))
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dims), pa.int32()), pa.array([n] * dims, pa.int64()),
                 pa.array([Decimal(v) for v in sums], pa.decimal128(38, 0)), pa.array(low), pa.array(high)],
                ["dim", "n", "total", "low", "high"],
            )

    parts = fit.mapInArrow(run, "dim int, n bigint, total decimal(38,0), low bigint, high bigint")
    rows = parts.groupBy("dim").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high")
    ).orderBy("dim").collect()
    n, whole, left, reach = int(rows[0]["n"]), [], [], 0
    for row in rows:
        m, r = divmod(int(row["total"]), n)
        whole.append(m)
        left.append(r)
        reach = max(reach, row["high"] - m, m - row["low"])
    return Centre(n, whole, left, reach)


def squared_sums(fit: DataFrame, dims: int, centre: Centre) -> dict[tuple[int, int], int]:
    """``Q / n`` for every dimension (as its pair with -1) and every pair: ``(dims + 1) * dims / 2 + dims`` numbers."""
    fits = 2 * centre.reach + 2 < 1 << 31 and ROWS * (2 * centre.reach + 2) ** 2 < 1 << 63

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone, pairs, seen = np.zeros(dims, object), [np.zeros(dims - i, object) for i in range(dims)], False
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                y = centre.offsets(matrix(batch.column(0).slice(s, ROWS), dims))
                y, seen = y if fits else y.astype(object), True
                alone += (y * y).sum(axis=0).astype(object)
                for i in range(dims):
                    both = y[:, i:i + 1] + y[:, i:]
                    pairs[i] += (both * both).sum(axis=0).astype(object)
        if seen:
            yield made([i for i in range(dims)], [-1] * dims, alone)
            for i in range(dims):
                yield made([i] * (dims - i), list(range(i, dims)), pairs[i])

    def made(i: list[int], j: list[int], values: np.ndarray) -> pa.RecordBatch:
        high, low = zip(*map(_limbs, values.tolist()))
        kind = pa.decimal128(38, 0)
        return pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(high, kind), pa.array(low, kind)], ["i", "j", "high", "low"]
        )

    parts = fit.mapInArrow(run, "i int, j int, high decimal(38,0), low decimal(38,0)")
    found = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).toArrow()
    out = {}
    for i, j, high, low in zip(*(found.column(c).to_pylist() for c in ("i", "j", "high", "low"))):
        rest = centre.left[i] + (centre.left[j] if j >= 0 else 0)
        out[i, j] = centre.n * _number(high, low) - rest * rest
    return out


def covariance(sums: dict[tuple[int, int], int], dims: int, n: int) -> np.ndarray:
    """The covariance matrix by polarisation; every entry is a quotient of whole numbers, rounded once."""
    out = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            out[i, j] = out[j, i] = (sums[i, j] - sums[i, -1] - sums[j, -1]) / (2 * n * n)
    return out


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4) -> DataFrame:
    """Every usable vector on the first ``components`` principal components of the distinct vectors, at unit variance.

    Columns: the id, ``component`` from 1, ``n`` (distinct vectors), ``deviation`` (sum of ``(n * x - S) ** 2`` over
    dimensions, exact; null if beyond 38 digits), ``whitened``, ``explained`` and ``identity_error`` (measured on the
    distinct vectors). Vectors that are null or hold a null or non-finite entry are left out. Shorter vectors than the
    longest are filled with zeros. Equal vectors count once, rows with equal or null ids stay. A component without
    variance has null ``whitened`` values, and ``identity_error`` is over the others (null if there are none). A table
    without usable vectors gives no rows. Other columns are ignored. Only numbers by pair of dimensions reach the
    driver.
    """
    kind = dict(vectors.dtypes)[id_col]
    schema = f"_id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    slim = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("_v")).filter(is_finite(F.col("_v")))
    rows = slim.select("_id", whole_numbers(F.col("_v")).alias("_x"))
    dims = rows.agg(F.max(F.size("_x"))).first()[0] or 0
    if not dims:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("_id", id_col)
    filled = F.concat("_x", F.array_repeat(F.lit(0).cast("bigint"), F.lit(dims) - F.size("_x")))
    rows = rows.select("_id", filled.alias("_x"))
    fit = stored(rows.select("_x").distinct(), "fit")
    centre = find_centre(fit, dims)
    v = covariance(squared_sums(fit, dims, centre), dims, centre.n)
    values, axes = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:min(components, dims)]
    values, axes = values[order], axes[:, order]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    trace = float(np.trace(v))
    open_ = values > dims * np.finfo(float).eps * max(trace, 0.0)
    scaled = axes[:, open_] / np.sqrt(values[open_])
    error = identity_error(fit, dims, centre, scaled)
    explained = [float(e) / trace if trace > 0 else None for e in values]
    size, at = len(order), np.flatnonzero(open_)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                few = batch.slice(s, ROWS)
                x = matrix(few.column(1), dims)
                white = np.full((len(x), size), np.nan)
                white[:, at] = centre.centred(x) @ scaled
                apart = [Decimal(d) if d < EXACT else None for d in centre.deviations(x)]
                each = np.repeat(np.arange(len(x)), size)
                yield pa.RecordBatch.from_arrays([
                    few.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), centre.n, np.int64)),
                    pa.array(apart, pa.decimal128(38, 0)).take(pa.array(each)),
                    pa.array(white.ravel(), from_pandas=True), pa.array(explained * len(x), pa.float64()),
                    pa.array([error] * len(each), pa.float64()),
                ], ["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, schema).withColumnRenamed("_id", id_col)


def identity_error(fit: DataFrame, dims: int, centre: Centre, scaled: np.ndarray) -> float | None:
    """The largest entry of the whitened vectors' covariance minus the identity, measured in a pass of its own."""
    size = scaled.shape[1]
    if not size:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, products, seen = np.zeros(size), np.zeros((size, size)), False
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                white = centre.centred(matrix(batch.column(0).slice(s, ROWS), dims)) @ scaled
                total, products, seen = total + white.sum(axis=0), products + white.T @ white, True
        if seen:
            values = np.append(total, products.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["k", "value"])

    sums = fit.mapInArrow(run, "k int, value double").groupBy("k").agg(F.sum("value").alias("value")).orderBy("k").collect()
    values = np.array([r["value"] for r in sums]) / centre.n
    mean, products = values[:size], values[size:].reshape(size, size)
    return float(np.abs(products - np.outer(mean, mean) - np.eye(size)).max())
