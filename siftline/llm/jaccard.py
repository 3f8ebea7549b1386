"""N-gram Jaccard join with Bayesian pruning of MinHash candidates.

Every text becomes its set of five-word shingles. Texts with equal sets are one class. Classes that agree in a band
of MinHash values meet in a bucket; there the values are compared step by step, and a pair is dropped as soon as
the posterior probability of reaching the threshold (uniform prior) falls below ``tolerance``. What is left
connects classes into candidate groups, and inside a group every pair is pruned the same way and then verified
exactly on the whole sets. Only rows per class are shuffled, never rows per pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.blocks import Arrays, components, linked_in_blocks
from siftline.llm.tables import BLANKS, stored

ROWS, BANDS, STEP = 5, 40, 20
HASHES = ROWS * BANDS
WORDS_KEPT = 400_000


class _WordHashes(dict):
    """Word to the eight bytes of its hash; forgotten when too many words were seen."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_digest(word.encode("utf-8", "surrogatepass"))
        return value


def shingles(words: list[str], size: int, known: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words than ``size`` make one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.frombuffer(b"".join(map(known.__getitem__, words)), "<u8")
    size = min(size, len(hashed))
    rolled = np.full(len(hashed) - size + 1, size, np.uint64)
    for k in range(size):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashed[k:k + len(rolled)]
        rolled ^= rolled >> np.uint64(29)
    rolled *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(rolled ^ (rolled >> np.uint64(32)))


def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    draw = rng.integers(1, 2**32, size=(2, HASHES), dtype=np.uint64).astype(np.uint32)
    return draw[0] | np.uint32(1), draw[1]


def signature(values: np.ndarray) -> bytes:
    """The MinHash values of a set, 16 bits each."""
    times, mix = _functions()
    short = (values >> np.uint64(32)).astype(np.uint32)
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for s in range(0, len(short), 1024):
        part = (short[None, s:s + 1024] ^ mix[:, None]) * times[:, None]
        np.minimum(best, part.min(axis=1), out=best)
    return (best >> np.uint32(9)).astype("<u2").tobytes()


def signed_sets(docs: DataFrame, id_col: str, text_col: str, size: int, with_sets: bool = False) -> DataFrame:
    """``(id, key, n, sig)`` per row, or ``(id, key, shingles)``; texts without words have no key.

    ``key`` is a 128-bit digest of the shingle set, so equal keys mean equal sets.
    """
    split = __import__("re").compile(BLANKS + "+").split

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _WordHashes()
        for frame in batches:
            keys, counts, last = [], [], []
            for text in frame["_text"]:
                words = [w for w in split(text) if w] if text else []
                values = shingles(words, size, known)
                raw = values.tobytes()
                keys.append(xxhash.xxh3_128_digest(raw) if len(values) else None)
                counts.append(len(values))
                last.append(raw if with_sets else signature(values) if len(values) else None)
            made = {"_id": frame["_id"], "key": keys}
            made |= {"shingles": last} if with_sets else {"n": counts, "sig": last}
            yield pd.DataFrame(made)

    kind = dict(docs.dtypes)[id_col]
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return slim.mapInPandas(run, f"_id {kind}, key binary, " + ("shingles binary" if with_sets else "n bigint, sig binary"))


def least_matches(threshold: float, tolerance: float) -> list[tuple[int, int]]:
    """After so many values, the least number of equal ones that keeps a pair.

    With a uniform prior the posterior after m of k matches is Beta(m + 1, k - m + 1), whose mass above the
    threshold t is the chance that a Binomial(k + 1, t) is at most m.
    """
    table = []
    for k in range(STEP, HASHES + 1, STEP):
        mass, m = 0.0, -1
        while mass < tolerance and m < k:
            m += 1
            mass += math.comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
        table.append((k, m))
    return table


def _survivors(a: np.ndarray, b: np.ndarray, table: list[tuple[int, int]]) -> np.ndarray:
    """Matrix of the pairs that no step drops."""
    equal = np.zeros((len(a), len(b)), np.int16)
    for k in range(table[0][0]):
        equal += a[:, k, None] == b[None, :, k]
    alive = equal >= table[0][1]
    i, j = np.nonzero(alive)
    found = equal[i, j].astype(np.int32)
    for (before, _), (k, least) in zip(table, table[1:]):
        keep = np.empty(len(i), bool)
        for s in range(0, len(i), 65536):
            x, y = i[s:s + 65536], j[s:s + 65536]
            found[s:s + 65536] += (a[x, before:k] == b[y, before:k]).sum(axis=1, dtype=np.int32)
            keep[s:s + 65536] = found[s:s + 65536] >= least
        i, j, found = i[keep], j[keep], found[keep]
    alive[:] = False
    alive[i, j] = True
    return alive


def _matrix(sigs: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), "<u2").reshape(len(sigs), HASHES)


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all of ``b``, by products of 0/1 matrices."""
    whose_a = np.repeat(np.arange(len(a)), [len(x) for x in a])
    whose_b = np.repeat(np.arange(len(b)), [len(x) for x in b])
    all_a, all_b = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(all_a, all_b)
    at_a, at_b = np.searchsorted(shared, all_a), np.searchsorted(shared, all_b)
    in_a = (at_a < len(shared)) & (shared[np.minimum(at_a, len(shared) - 1)] == all_a) if len(shared) else np.zeros(len(all_a), bool)
    in_b = (at_b < len(shared)) & (shared[np.minimum(at_b, len(shared) - 1)] == all_b) if len(shared) else np.zeros(len(all_b), bool)
    whose_a, at_a, whose_b, at_b = whose_a[in_a], at_a[in_a], whose_b[in_b], at_b[in_b]
    by_a, by_b = np.argsort(at_a, kind="stable"), np.argsort(at_b, kind="stable")
    whose_a, at_a, whose_b, at_b = whose_a[by_a], at_a[by_a], whose_b[by_b], at_b[by_b]
    out = np.zeros((len(a), len(b)), np.float32)
    for s in range(0, len(shared), 2048):
        width = min(2048, len(shared) - s)
        x, y = np.zeros((len(a), width), np.float32), np.zeros((len(b), width), np.float32)
        f, t = np.searchsorted(at_a, [s, s + width])
        x[whose_a[f:t], at_a[f:t] - s] = 1
        f, t = np.searchsorted(at_b, [s, s + width])
        y[whose_b[f:t], at_b[f:t] - s] = 1
        out += x @ y.T
    return out


def jaccard_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
    threshold: float = 0.8, tolerance: float = 1e-9,
) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``class_id``, ``n_links``, ``group_id``.

    ``class_id`` is the smallest id with the same shingle set, ``n_links`` the number of other rows whose set has a
    Jaccard similarity of ``threshold`` or more, ``group_id`` the smallest id reachable by links.

    Null and blank texts have no shingles and link with nothing (their class and group are their own id); a text of
    fewer than ``size`` words is one shingle. Repeated rows are copies and count as links; rows with a null id take
    part and are passed over where a smallest id is named. Very long texts are read whole. An empty table gives an
    empty result, and columns other than the two named are ignored.
    """
    rows = stored(signed_sets(docs, id_col, text_col, size), "sets")
    classes = stored(
        rows.filter("key is not null").groupBy("key").agg(
            F.min("_id").alias("rep"), F.count("*").alias("copies"), F.max("n").alias("n"), F.max("sig").alias("sig"),
        ), "classes",
    )
    table = least_matches(threshold, tolerance)

    # Buckets with the same members in several bands are kept once.
    bands = classes.select("key", F.explode(F.array(*[
        F.xxhash64(F.lit(b), F.substring("sig", 2 * ROWS * b + 1, 2 * ROWS)) for b in range(BANDS)
    ])).alias("bucket"))
    buckets = bands.groupBy("bucket").agg(
        F.count("*").alias("m"), F.bit_xor(F.xxhash64("key")).alias("x"), F.sum(F.hash("key").cast("bigint")).alias("y"),
    ).filter("m > 1").groupBy("m", "x", "y").agg(F.min("bucket").alias("bucket"))
    met = bands.join(buckets.select("bucket"), "bucket").join(classes.select("key", "sig"), "key")

    def possible(a: Arrays, b: Arrays) -> np.ndarray:
        return _survivors(_matrix(a["sig"]), _matrix(b["sig"]), table)

    candidates = linked_in_blocks(met, "bucket", "key", F.lit(1), 1024, possible)
    near = stored(components(candidates, "key", "root"), "candidates")

    texts = docs.join(
        near.join(classes, near.id == classes.key).select(F.col("rep").alias("_rep")),
        F.col(id_col).eqNullSafe(F.col("_rep")), "left_semi",
    )
    sets = signed_sets(texts, id_col, text_col, size, with_sets=True).dropDuplicates(["key"]).drop("_id")
    held = near.select(F.col("id").alias("key"), "component").join(classes.select("key", "copies", "sig"), "key")

    def verified(a: Arrays, b: Arrays) -> np.ndarray:
        match = possible(a, b)
        i, j = np.flatnonzero(match.any(axis=1)), np.flatnonzero(match.any(axis=0))
        if len(i):
            one = [np.frombuffer(a["shingles"][k], np.uint64) for k in i]
            two = [np.frombuffer(b["shingles"][k], np.uint64) for k in j]
            common = _common(one, two).astype(np.float64)
            total = np.array([len(x) for x in one])[:, None] + np.array([len(x) for x in two])[None, :] - common
            match[np.ix_(i, j)] &= common / total >= threshold
        return match

    weight = F.greatest(F.octet_length("shingles") / 8, F.lit(256))
    found = stored(linked_in_blocks(held.join(sets, "key"), "component", "key", weight, 1 << 18, verified), "links")
    grouped = components(found, "key", "root")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    known = (
        classes.select("key", "rep", "copies").join(links, "key", "left")
        .join(grouped.withColumnRenamed("id", "key"), "key", "left")
        .withColumn("component", F.coalesce("component", "key"))
    )
    lowest = known.groupBy("component").agg(F.min("rep").alias("group_id"))
    known = known.join(lowest, "component").select(
        "key", F.col("rep").alias("class_id"), "group_id",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
    )
    return rows.select("_id", "key").join(known, "key", "left").select(
        F.col("_id").alias("id"), F.when(F.col("key").isNull(), F.col("_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.when(F.col("key").isNull(), F.col("_id")).otherwise(F.col("group_id")).alias("group_id"),
    )


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its group; repeated rows with that id stay once."""
    kept = jaccard_groups(docs, id_col, text_col).filter(
        F.col("n_links").eqNullSafe(0) | F.col("id").eqNullSafe(F.col("group_id"))
    ).select(F.col("id").alias("_kept"), (F.col("n_links") > 0).alias("_linked")).distinct()
    kept = kept.groupBy("_kept").agg(F.max("_linked").alias("_linked"))
    joined = docs.join(kept, F.col(id_col).eqNullSafe(F.col("_kept")))
    alone = joined.filter(~F.col("_linked")).drop("_kept", "_linked")
    # Rows that share the id of a linked row: one stays.
    return alone.unionByName(joined.filter("_linked").drop("_kept", "_linked").dropDuplicates([id_col]))
