"""Merging nearly equal entities of one document and type, in order of appearance.

An entity joins the first kept entity whose text is similar enough, and hands over its text if it is
more confident. Similarity is the share of the longest common subsequence, 200 * LCS / (a + b),
rounded half to even; two texts never meet if that ratio fails. The outcome depends on the order of
the entities, so one group of possibly similar texts is walked in order by a small function over the
sorted rows, and Spark splits the work into such groups:

* Groups with few rows, which most are, go through one shuffle and are walked whole.
* Of larger groups, those with few distinct texts are walked whole as well. The others are split into connected parts.
  Texts that may be similar share a segment at a nearby place, so an equi-join on segments finds them, and parts never
  influence one another.
* Where all entities of a larger group are equally confident no text is ever replaced, so of exact copies
  only the first counts; copies are dropped by an aggregate before anything is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline import functions as X
from siftline.checkpoints import reliable

# Groups with more distinct texts than this are split into connected parts; those with no more rows are walked at once.
WHOLE_GROUP = 2_000
# Texts of a group whose kept entity is remembered.
REMEMBERED = 100_000
GROUP = ["doc_id", "entity_type"]


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, one machine-word step per character of ``b``.

    Characters that both texts begin or end with belong to it anyway and are counted off first.
    """
    head, most = 0, min(len(a), len(b))
    while head < most and a[head] == b[head]:
        head += 1
    tail, most = 0, most - head
    while tail < most and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    if tail == most:
        return head + tail
    a, b = a[head:len(a) - tail], b[head:len(b) - tail]
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | (1 << i)
    row = full = (1 << len(a)) - 1
    for ch in b:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return head + tail + len(a) - row.bit_count()


def similarity(a: str, b: str) -> int:
    total = len(a) + len(b)
    return round(200 * _common(a, b) / total) if total else 100


@lru_cache(maxsize=4096)
def _needed(total: int, threshold: int) -> int:
    """The least common length with which texts of this total length reach the threshold."""
    return next(n for n in range(total + 1) if not total or round(200 * n / total) >= threshold)


def _alike(a: str, in_a: frozenset, b: str, in_b: frozenset, threshold: int) -> bool:
    """Whether the similarity reaches the threshold; characters that only one text holds bound it from above."""
    if a == b:
        return True
    of_a, of_b = len(a), len(b)
    need = _needed(of_a + of_b, threshold)
    if of_a < need or of_b < need:
        return False
    return of_a - len(in_a - in_b) >= need and of_b - len(in_b - in_a) >= need and _common(a, b) >= need


def _values(column: pa.Array) -> list:
    """The values as Python objects; texts, and numbers none of which is missing, by way of numpy, which is faster."""
    plain = pa.types.is_integer(column.type) or pa.types.is_floating(column.type)
    if pa.types.is_string(column.type) or (plain and not column.null_count):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _groups(batch: pa.RecordBatch, start: int, current: tuple | None) -> list[tuple[tuple, int, int]]:
    """Key, first row and end of the runs of rows of one group, from row ``start`` on; ``current`` is the key before them."""
    keys = [batch.column(n)[start:] for n in (*GROUP, "part")]
    new = np.zeros(len(keys[0]) + 1, dtype=bool)
    new[0] = new[-1] = True
    for key in keys:
        if pa.types.is_nested(key.type) or pa.types.is_null(key.type) or key.null_count:
            plain = key.to_pylist()
            new[1:-1] |= np.fromiter((a != b for a, b in zip(plain, plain[1:])), dtype=bool, count=len(plain) - 1)
        else:
            new[1:-1] |= pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
    edges = np.flatnonzero(new)
    firsts = zip(*[_values(key.take(pa.array(edges[:-1]))) for key in keys])
    # The key of before is handed on itself, so that a run that goes on is told by identity or by equality.
    return [
        (current if key == current else key, start + a, start + b)
        for key, a, b in zip(firsts, edges.tolist(), edges[1:].tolist())
    ]


def _walk(threshold: int, names: list[str]):
    """A function over sorted batches that merges group after group and returns the columns ``names``.

    Rows arrive ordered by group and position, so only the kept entities of the current group are
    held, however many rows the group has. What has become of a text is remembered until the text of a kept entity
    changes, so copies are not compared again.
    """

    def rows(batch: pa.RecordBatch, kept: list[list]) -> pa.RecordBatch:
        """Each kept entity with the text and confidence of the row that it took them from."""
        own, text = (pa.array([k[i] for k in kept], pa.int64()) for i in (3, 4))
        return pa.RecordBatch.from_arrays(
            [batch.column(n).take(text if n in ("value", "confidence", "__text") else own) for n in batch.schema.names],
            schema=batch.schema,
        )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, kept, places, carried = None, [], {}, None
        for batch in batches:
            # The kept entities of the group that goes on stand before the new rows.
            start = len(kept)
            if start:
                batch = pa.Table.from_batches([carried, batch]).combine_chunks().to_batches()[0]
                for i, entity in enumerate(kept):
                    entity[3] = entity[4] = i
            done: list[list] = []
            if batch.num_rows == start:
                continue
            texts, sures = (_values(batch.column(n)[start:]) for n in ("__text", "confidence"))
            for key, first, end in _groups(batch, start, current):
                if key is not current:
                    done += kept
                    current, kept, places = key, [], {}
                for i, text, sure in zip(range(first, end), texts[first - start:end - start], sures[first - start:end - start]):
                    sure = sure or 0.0
                    place = places.get(text)
                    if place is None:
                        held = frozenset(text)
                        place = 0
                        for entity in kept:
                            if _alike(entity[0], entity[1], text, held, threshold):
                                break
                            place += 1
                        if len(places) >= REMEMBERED:
                            places.clear()
                        places[text] = place
                        if place == len(kept):
                            kept.append([text, held, sure, i, i])
                            continue
                    entity = kept[place]
                    if sure > entity[2]:
                        if entity[0] != text:
                            entity[0], entity[1] = text, frozenset(text)
                            places.clear()
                            places[text] = place
                        entity[2], entity[4] = sure, i
            if done:
                yield rows(batch, done).select(names)
            carried = rows(batch, kept)
        if kept:
            yield carried.select(names)

    return walk


def _similar_pairs(threshold: int):
    @F.pandas_udf("boolean")
    def similar(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similarity(x, y) >= threshold for x, y in zip(a, b)], dtype=bool)

    return similar


def _edges(texts: DataFrame, threshold: int) -> DataFrame:
    """Pairs of similar texts within a group, found by shared segments.

    Similar texts of lengths a <= b differ by fewer than ``share * (a + b)`` single-character
    insertions and deletions. Cutting the longer text into one more segment than that leaves a
    segment untouched, which the shorter text holds at most that many places away.
    """
    share = (100 - (threshold - 0.5)) / 100
    slots = (F.floor(2 * share * F.col("size")) + 1).cast("int")
    width = F.floor(F.col("size") / F.col("slots")).cast("int")

    def segments(df: DataFrame) -> DataFrame:
        """Slot, start and width of the segments of a text with ``size`` characters."""
        last = F.col("slot") == F.col("slots") - 1
        start = F.col("slot") * F.col("width") + 1
        return (
            df.withColumn("slots", slots).withColumn("width", width)
            .withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
            .withColumn("start", start)
            .withColumn("width", F.when(last, F.col("size") - F.col("start") + 1).otherwise(F.col("width")))
        )

    cut = segments(texts.withColumn("size", F.length("__text"))).select(
        *GROUP, "size", "slot", F.substr("__text", F.col("start"), F.col("width")).alias("piece"),
        F.col("__text").alias("long"),
    )
    # A shorter text looks for the segments of every length it may be similar to.
    own = F.length("__text")
    most = F.floor(own * (1 + share) / (1 - share)).cast("int")
    probes = (
        segments(texts.withColumn("size", F.explode(F.sequence(own, most))))
        .withColumn("at", F.explode(F.sequence(
            F.greatest(F.col("start") - F.col("slots"), F.lit(1)), F.col("start") + F.col("slots")
        )))
        .filter(F.col("at") + F.col("width") - 1 <= own)
        .select(*GROUP, "size", "slot", F.substr("__text", F.col("at"), F.col("width")).alias("piece"),
                F.col("__text").alias("short"))
        .distinct()
    )
    pairs = (
        cut.join(probes, [*GROUP, "size", "slot", "piece"])
        .filter(F.col("long") != F.col("short"))
        .select(*GROUP, F.least("long", "short").alias("a"), F.greatest("long", "short").alias("b"))
        .distinct()
    )
    return pairs.filter(_similar_pairs(threshold)("a", "b"))


def _parts(texts: DataFrame, edges: DataFrame) -> DataFrame:
    """The least text of each connected part, by repeated hops to smaller neighbours and their labels."""
    both = reliable(edges.unionByName(edges.select(*GROUP, F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = texts.select(*GROUP, "__text", F.col("__text").alias("part"))
    while True:
        seen = labels.select(*GROUP, F.col("__text").alias("b"), "part")
        least = both.join(seen, [*GROUP, "b"]).groupBy(*GROUP, F.col("a").alias("__text")).agg(F.min("part").alias("near"))
        hopped = labels.join(least, [*GROUP, "__text"], "left").select(
            *GROUP, "__text", F.col("part").alias("old"), F.least("part", "near").alias("part")
        )
        jump = hopped.select(*GROUP, F.col("__text").alias("part"), F.col("part").alias("far"))
        moved = reliable(
            hopped.join(jump, [*GROUP, "part"], "left")
            .select(*GROUP, "__text", "old", F.least("part", "far").alias("part"))
        )
        labels = moved.drop("old")
        if moved.filter(F.col("old") != F.col("part")).isEmpty():
            return labels


def _crowded(work: DataFrame, threshold: int, whole_group: int) -> DataFrame:
    """Rows of large groups, without copies that cannot count, by connected part."""
    names = [c for c in work.columns if c not in (*GROUP, "__text")]
    sure = F.coalesce("confidence", F.lit(0.0))

    # Exact copies with one confidence throughout the group: only the first can count.
    facts = work.groupBy(*GROUP, "__text").agg(F.min(sure).alias("low"), F.max(sure).alias("high"))
    groups = facts.groupBy(*GROUP).agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("texts")
    ).select(*GROUP, (F.col("low") == F.col("high")).alias("__even"), (F.col("texts") > whole_group).alias("__large"))
    known = work.join(groups, GROUP)
    firsts = (
        known.filter("__even").groupBy(*GROUP, "__text", "__large")
        .agg(F.min_by(F.struct(*names), "pos").alias("__row"))
        .select(*GROUP, "__text", "__large", *[F.col("__row")[n].alias(n) for n in names])
    )
    rows = firsts.unionByName(known.filter(~F.col("__even")).drop("__even"))

    large = rows.filter("__large")
    if groups.filter("__large").isEmpty():
        return rows.withColumn("part", F.lit("")).drop("__large")
    texts = large.select(*GROUP, "__text").distinct()
    labels = _parts(texts, _edges(texts, threshold))
    return rows.filter(~F.col("__large")).withColumn("part", F.lit("")).unionByName(
        large.join(labels, [*GROUP, "__text"])
    ).drop("__large")


def fuzzy_dedupe(
    entities: DataFrame, threshold: int = 85, only: list[str] | None = None, whole_group: int = WHOLE_GROUP,
    documents: DataFrame | None = None,
) -> DataFrame:
    """Merge similar entities per document and type; ``only`` limits it to some types.

    Rows without a document or a type are left out of the merging and its result. ``documents`` may hold ``doc_id``, the
    number of rows ``n`` and how many of them are ``placed``, of these rows or more; then groups are only counted in
    documents that can have a large group or rows without a place.
    """
    chosen = F.lit(True) if only is None else F.col("entity_type").isin(only)
    work = entities.filter(chosen & F.col("doc_id").isNotNull() & F.col("entity_type").isNotNull()).withColumn(
        "__text", F.lower(F.coalesce(X.strip_column(F.col("value")), F.lit("")))
    )
    # Groups with rows that have no place are not walked as they are either: the aggregate knows which copy comes first.
    special = (F.col("n") > whole_group) | (F.col("placed") < F.col("n"))
    counted, suspects = work, None
    if documents is not None:
        suspects = documents.filter(F.col("doc_id").isNotNull() & special).select("doc_id")
        counted = work.join(suspects, "doc_id", "left_semi")
    crowded = counted.groupBy(*GROUP).agg(F.count("*").alias("n"), F.count("pos").alias("placed")).filter(special).select(*GROUP)
    whole = F.lit("").alias("part")
    if (suspects is not None and suspects.isEmpty()) or crowded.isEmpty():
        parted = work.select("*", whole)
    else:
        parted = work.join(crowded, GROUP, "left_anti").select("*", whole).unionByName(
            _crowded(work.join(crowded, GROUP, "left_semi"), threshold, whole_group)
        )
    ordered = parted.repartition(*GROUP, "part").sortWithinPartitions(*GROUP, "part", "pos")
    merged = ordered.mapInArrow(_walk(threshold, entities.columns), entities.schema)
    return merged.unionByName(entities.filter(~chosen))
