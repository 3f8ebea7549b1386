"""Comparing all pairs inside bounded blocks, and connected components.

Members of a group are dealt into blocks of bounded weight, and every pair of blocks is one small task. A group
of any size is thus compared whole without one task holding it, and pairs never become rows: a task returns one
row per member with its number of links and a root that the links reach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.tables import stored

Arrays = dict[str, np.ndarray]


def by_group(df: DataFrame, keys: list[str], fn: Callable[[Arrays], Arrays | None], schema: str) -> DataFrame:
    """Apply ``fn`` to the columns of each group; groups are read one after the other from sorted partitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Arrays | None = None
        for frame in batches:
            if not len(frame):
                continue
            now = {c: frame[c].to_numpy() for c in frame.columns}
            if held is not None:
                now = {c: np.concatenate([held[c], now[c]]) for c in now}
            change = np.zeros(len(now[keys[0]]), bool)
            change[0] = True
            for k in keys:
                change[1:] |= now[k][1:] != now[k][:-1]
            starts = np.flatnonzero(change)
            made = [fn({c: v[s:e] for c, v in now.items()}) for s, e in zip(starts[:-1], starts[1:])]
            made = [m for m in made if m is not None]
            if made:
                yield pd.DataFrame({c: np.concatenate([m[c] for m in made]) for c in made[0]})
            held = {c: v[starts[-1]:] for c, v in now.items()}
        if held is not None and (last := fn(held)) is not None:
            yield pd.DataFrame(last)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def _roots(n: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The smallest index that the links ``one[i] - two[i]`` reach from each of ``n`` indices."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[one], label[two])
        np.minimum.at(label, one, low)
        np.minimum.at(label, two, low)
        label = label[label]
        if np.array_equal(before, label):
            return label


def dealt(members: DataFrame, group: str, member: str, weight: Column, room: int) -> DataFrame:
    """``members`` once for every pair ``_low``, ``_high`` of blocks that their own ``_block`` takes part in."""
    sizes = members.groupBy(group).agg(F.ceil(F.sum(weight) / room).cast("int").alias("_blocks"))
    return (
        members.join(sizes, group)
        .withColumn("_block", F.pmod(F.xxhash64(F.lit(7), F.col(member)), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumn("_low", F.least("_block", "_other"))
        .withColumn("_high", F.greatest("_block", "_other"))
        .drop("_blocks", "_other")
    )


def linked_in_blocks(
    members: DataFrame, group: str, member: str, weight: Column, room: int,
    linked: Callable[[Arrays, Arrays], np.ndarray],
) -> DataFrame:
    """Links of each member with the other members of its group.

    Columns: ``group``, ``member``, ``links`` (sum of ``copies`` of the linked members, if there is such a column,
    else their number) and ``root``, a member that is reached by links found in the same block. A member comes
    once for every pair of blocks in which it has a link. ``linked(a, b)`` gets the columns of two blocks and
    returns a matrix of truth values. Memory of a task follows ``room``, the weight of a block.
    """
    blocks = dealt(members, group, member, weight, room)
    types = dict(members.dtypes)

    def compare(rows: Arrays) -> Arrays | None:
        low, high = rows["_low"][0], rows["_high"][0]
        if low == high:
            one = two = np.arange(len(rows["_block"]))
        else:
            one, two = np.flatnonzero(rows["_block"] == low), np.flatnonzero(rows["_block"] == high)
        if not len(one) or not len(two) or len(rows["_block"]) < 2:
            return None
        match = linked({c: v[one] for c, v in rows.items()}, {c: v[two] for c, v in rows.items()})
        if low == high:
            np.fill_diagonal(match, False)
        i, j = np.nonzero(match)
        if not len(i):
            return None
        copies = rows.get("copies", np.ones(len(rows["_block"]), np.int64)).astype(np.int64)
        links = np.zeros(len(copies), np.int64)
        np.add.at(links, one[i], copies[two[j]])
        if low != high:
            np.add.at(links, two[j], copies[one[i]])
        some = np.flatnonzero(links)
        root = _roots(len(copies), one[i], two[j])
        return {
            group: rows[group][some], member: rows[member][some],
            "links": links[some], "root": rows[member][root[some]],
        }

    schema = f"`{group}` {types[group]}, `{member}` {types[member]}, links bigint, root {types[member]}"
    return by_group(blocks, [group, "_low", "_high"], compare, schema)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(id, component)`` for every id that has an edge; the component is its smallest id.

    Alternating star contraction: each round hangs the larger neighbours of an id below its smallest one, then
    the smaller ones. Every round is written to the shared folder and stops when nothing moved.
    """
    edges = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(lowest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(lowest, "a").select(
            F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b"))))
        ).select("col.*").filter("a <> b")
        now = stored(small.distinct(), "edges")
        if (new := _state(now)) == state:
            break
        state = new
    roots = now.select(F.col("b").alias("id")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        roots.select("id", F.col("id").alias("component"))
    )


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1000003)).first()
    return tuple(row)
