"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.tables import BLANK_CHARS, BLANKS, fresh

OTHER = "(other)"
MOST_CELLS = 200_000


def word_tokens(c: Column) -> Column:
    """Blank-separated words, the unit of weight when no tokenizer is wanted."""
    bare = F.btrim(F.coalesce(c.cast("string"), F.lit("")), F.lit(BLANK_CHARS))
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, BLANKS + "+"))).cast("bigint")


def shape_topic(c: Column) -> Column:
    """Topic by the shape of a text: ``table``, ``markup``, ``note`` or ``prose``."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))
    return (
        F.when(F.length(text) < 200, "note")
        .when((F.length(text) - F.length(F.replace(text, F.lit(" | "), F.lit("")))) / size > 0.1, "table")
        .when(F.regexp_count(text, F.lit("[#*$%&<>{}]")) / size > 0.05, "markup")
        .otherwise("prose")
    )


def _marginals(tokens: np.ndarray, targets: list[np.ndarray | None]) -> list[np.ndarray]:
    """The wanted share of every level of each axis: named targets, natural shares for the rest, nothing where no token is."""
    total = tokens.sum()
    share = tokens / total if total else tokens.astype(float)
    marginals = []
    for axis, target in enumerate(targets):
        rest = tuple(a for a in range(share.ndim) if a != axis)
        natural = share.sum(axis=rest)
        if target is None:
            marginals.append(natural)
            continue
        wanted = np.where(natural > 0, target, 0.0)
        free = np.isnan(wanted)
        open_share = natural[free].sum()
        named = np.nansum(wanted)
        wanted[free] = natural[free]
        if named > 0:
            wanted[~free] *= (1 - open_share) / named
        marginals.append(wanted / wanted.sum() if wanted.sum() else natural)
    return marginals


def fit(
    tokens: np.ndarray, targets: list[np.ndarray | None], rounds: int = 1_000, close: float = 1e-9, share: float | None = None,
) -> np.ndarray:
    """Weights of sum 1 near ``tokens`` whose marginals are ``targets`` (one per axis, NaN: natural share).

    Raking: the factors of each axis in turn are set so that its marginal is met. Cells without tokens stay without
    weight, and a target that no cell can carry is shared by the other levels. With ``share`` no weight passes what
    its cell can give to a sample of that share: a weight is the product of its factors or that bound, whichever
    is less, and the factors are solved with the bounds inside, so the open cells of a level take over what a held one
    leaves. A level that cannot give its target at all gives all it has, and the other levels share the rest. Ends when no
    weight moves by ``close``, or after ``rounds`` (targets that contradict each other through the bounds; the last axis is
    met then, and ``reached`` tells the shares).
    """
    marginals = _marginals(tokens, targets)
    total = tokens.sum()
    if not total:
        return tokens.astype(float)
    base = tokens / total
    bound = np.full(base.shape, np.inf) if share is None else base / min(max(share, 1e-9), 1.0)
    axes = range(base.ndim)
    flat = [(np.moveaxis(base, k, 0).reshape(base.shape[k], -1), np.moveaxis(bound, k, 0).reshape(base.shape[k], -1)) for k in axes]
    held = [np.where(cells > 0, most, 0.0).sum(axis=1) for cells, most in flat]
    marginals = [np.minimum(_factor(wanted, most, 1.0) * wanted, most) for wanted, most in zip(marginals, held)]
    factors, weight = [np.ones(n) for n in base.shape], base
    for _ in range(rounds):
        before = weight
        for k in axes:
            others = base
            for j in axes:
                if j != k:
                    others = others * factors[j].reshape([-1 if i == j else 1 for i in axes])
            cells = np.moveaxis(others, k, 0).reshape(base.shape[k], -1)
            factors[k] = np.array([_factor(c, m, goal) for c, m, goal in zip(cells, flat[k][1], marginals[k])])
        weight = np.minimum(others * factors[-1], bound)
        if np.abs(weight - before).max(initial=0.0) < close:
            break
    return weight


def _factor(cells: np.ndarray, bound: np.ndarray, goal: float) -> float:
    """The ``f`` for which ``minimum(f * cells, bound)`` sums to ``goal``, or just fills all bounds."""
    full = cells > 0
    if goal <= 0 or not full.any():
        return 0.0
    cells, bound = cells[full], bound[full]
    order = np.argsort(bound / cells)
    cells, bound = cells[order], bound[order]
    limit = bound / cells
    if not np.isfinite(limit[0]):
        return float(goal / cells.sum())
    rest = goal - np.concatenate([[0.0], np.cumsum(bound)[:-1]])
    f = rest / np.cumsum(cells[::-1])[::-1]
    fits = np.flatnonzero(f <= limit)
    return float(f[fits[0]] if len(fits) else limit[-1])


def probabilities(tokens: np.ndarray, weight: np.ndarray, share: float) -> np.ndarray:
    """Inclusion probability of each cell, so that ``share`` of all tokens is expected with the fitted weights.

    Weights fitted with the same ``share`` need at most all tokens of a cell. Cells without tokens are taken.
    """
    rate = np.divide(share * tokens.sum() * weight, tokens, out=np.ones_like(weight, dtype=float), where=tokens > 0)
    return np.minimum(rate, 1.0)


def reached(tokens: np.ndarray, targets: list[np.ndarray | None], share: float) -> list[list[tuple[float, float, float]]]:
    """Per axis and level the share wanted, the share fitted, and the share expected in the sample."""
    fitted = fit(tokens, targets, share=share)
    taken = probabilities(tokens, fitted, share) * tokens
    taken = taken / taken.sum() if taken.sum() else taken
    out = []
    for axis, wanted in enumerate(_marginals(tokens, targets)):
        rest = tuple(a for a in range(tokens.ndim) if a != axis)
        out.append(list(zip(wanted.tolist(), fitted.sum(axis=rest).tolist(), taken.sum(axis=rest).tolist())))
    return out


def _axes(docs: DataFrame, targets, text: Column, levels) -> tuple[dict[str, Column], dict[str, list[str]]]:
    """The level of each row on each axis, and the levels that there are; the number of cells is checked."""
    axes = dict(levels or {"source": F.col("source"), "lang": F.col("lang"), "topic": shape_topic(text)})
    known = {a: [*targets.get(a, {}), OTHER] for a in axes}
    if np.prod([len(v) for v in known.values()]) > MOST_CELLS:
        raise ValueError("the targets name too many cells")

    def pooled(axis: str) -> Column:
        value = F.coalesce(axes[axis].cast("string"), F.lit("(null)"))
        return F.when(value.isin(known[axis][:-1]), value).otherwise(F.lit(OTHER)) if known[axis][:-1] else F.lit(OTHER)

    return {a: pooled(a) for a in axes}, known


def _sums(counted: list, cells: list[str], known: dict[str, list[str]]) -> tuple[np.ndarray, list[tuple]]:
    """The tokens of each cell as an array, and the place in it of each counted row."""
    sums = np.zeros([len(v) for v in known.values()])
    places = [{v: k for k, v in enumerate(levels)} for levels in known.values()]
    at = [tuple(place[row[c]] for place, c in zip(places, cells)) for row in counted]
    for place, row in zip(at, counted):
        sums[place] = row["tokens"] or 0
    return sums, at


def _wanted(targets, known: dict[str, list[str]]) -> list[np.ndarray | None]:
    return [np.array([*targets[a].values(), np.nan], dtype=float) if targets.get(a) else None for a in known]


def mixture(
    docs: DataFrame, targets: Mapping[str, Mapping[str, float]], share: float, text_col: str = "text",
    levels: Mapping[str, Column] | None = None, tokens: Column | None = None,
) -> DataFrame:
    """``(axis, level, tokens, target, fitted, reached)``: what ``mix_sources`` will do with these documents.

    ``target`` is the named target, adapted to the levels that there are; ``fitted`` and ``reached`` are the shares of the
    weights and of the sample. They differ from it where the cells of a level hold too few tokens. One row per level.
    """
    text = F.col(text_col)
    of, known = _axes(docs, targets, text, levels)
    cells = [f"_cell_{a}" for a in of]
    counted = docs.select(
        *[c.alias(n) for n, c in zip(cells, of.values())], (word_tokens(text) if tokens is None else tokens).alias("tokens")
    ).groupBy(*cells).agg(F.sum("tokens").alias("tokens")).collect()
    sums, _ = _sums(counted, cells, known)
    shares = reached(sums, _wanted(targets, known), share)
    rows = []
    for axis, name in enumerate(known):
        held = sums.sum(axis=tuple(a for a in range(sums.ndim) if a != axis))
        rows += [(name, v, int(held[k]), *map(float, shares[axis][k])) for k, v in enumerate(known[name])]
    return docs.sparkSession.createDataFrame(
        rows, "axis string, level string, tokens bigint, target double, fitted double, reached double"
    )


def mix_sources(
    docs: DataFrame, targets: Mapping[str, Mapping[str, float]], share: float, seed: int = 0,
    id_col: str = "doc_id", text_col: str = "text", levels: Mapping[str, Column] | None = None, tokens: Column | None = None,
) -> DataFrame:
    """``docs`` with ``_tokens``, ``_weight`` (of the cell), ``_probability`` and ``_kept``.

    ``targets`` names the wanted share of tokens for levels of each axis (``source``, ``lang``, ``topic``, or any
    of ``levels``); unnamed levels are pooled as ``(other)`` and keep their natural share. The table of cells is
    thus bounded by the targets, whatever the data hold, and is all that reaches the driver.

    A row is kept when the hash of seed, id and text falls below the probability of its cell, so a result does not
    depend on partitions and repeated rows share their fate. No cell can give more than all its tokens; the raking
    holds such cells at this bound and refits the others, so weights and probabilities agree (``mixture`` tells the
    shares reached). Null levels are a level of their own name ``(null)``; null and empty texts weigh nothing. A
    cell without any tokens is kept. An empty table gives an empty result. All columns of ``docs`` are returned;
    where they have the name of a result, that result's name ends with an underscore more.
    """
    text = F.col(text_col)
    of, known = _axes(docs, targets, text, levels)
    *cells, count, weigh, chance, kept = fresh(
        docs, *(f"_cell_{a}" for a in of), "_tokens", "_weight", "_probability", "_kept"
    )
    based = docs.select(
        "*", *[c.alias(n) for n, c in zip(cells, of.values())], (word_tokens(text) if tokens is None else tokens).alias(count)
    )
    counted = based.groupBy(*cells).agg(F.sum(count).alias("tokens")).collect()
    sums, places = _sums(counted, cells, known)
    weight = fit(sums, _wanted(targets, known), share=share)
    rate = probabilities(sums, weight, share)
    rows = [(*(row[c] for c in cells), float(weight[at]), float(rate[at])) for row, at in zip(counted, places)]
    schema = ", ".join([*(f"`{c}` string" for c in cells), f"`{weigh}` double, `{chance}` double"])
    table = docs.sparkSession.createDataFrame(rows, schema)
    drawn = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), text), F.lit(1 << 40)) / float(1 << 40)
    return based.join(F.broadcast(table), cells).withColumn(kept, drawn < F.col(chance)).select(
        *docs.columns, *cells, count, weigh, chance, kept
    )
