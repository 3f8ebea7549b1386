"""Near-duplicate vectors by sorted projection passes.

Each pass sorts the distinct vectors of every label lexicographically by a concatenation of random hashes and compares
every vector with a bounded window of neighbours, across the borders of partitions too. Probes planted at the
threshold tell what the passes find in a label: where they miss too many, more passes follow with a window twice as
wide, until they do not. Verified pairs of all passes are united; inside each resulting component all pairs are then
compared in blocks, so the window bounds the search and not the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.blocks import Arrays, _roots, by_group, components, linked_in_blocks
from siftline.llm.tables import stored

PASSES, WINDOW, BITS = 16, 48, 60
# Passes go on in a label until FOUND of its about PROBES probes are found.
PROBES, FOUND = 2000, 0.999


def _unit(raw: np.ndarray) -> np.ndarray:
    """Rows of equal dimension as unit vectors in double precision."""
    rows = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    # Scaled first, so that squares of very small or large components stay finite.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    threshold: float = 0.98, passes: int = PASSES, window: int = WINDOW,
) -> DataFrame:
    """One row per vector: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Vectors are compared when labels are equal and not null and dimensions are equal. Null, empty and zero vectors
    and vectors with a null or non-finite component link with nothing: no links, their own component, kept. Equal
    vectors of one label are one class, compared once. Repeated ids count as separate vectors. An empty table gives
    an empty result; other columns are ignored.
    """
    slim = vectors.select(
        F.col(id_col).alias("_id"), F.col(label_col).cast("string").alias("_label"),
        F.col(vector_col).cast("array<double>").alias("_vector"),
    )
    kind = dict(slim.dtypes)["_id"]

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            keys, raws, dims = [], [], []
            for label, vector in zip(frame["_label"], frame["_vector"]):
                key = raw = dim = None
                if label is not None and vector is not None and len(vector):
                    value = np.asarray([np.nan if x is None else x for x in vector] if vector.dtype == object else vector, "<f8")
                    if np.isfinite(value).all() and value.any():
                        raw, dim = (value + 0.0).tobytes(), len(value)
                        key = xxhash.xxh3_128_digest(raw + b"\x00" + label.encode())
                keys.append(key)
                raws.append(raw)
                dims.append(dim)
            yield pd.DataFrame({
                "_id": frame["_id"], "key": keys, "label": frame["_label"],
                "dim": pd.array(dims, dtype="Int32"), "raw": raws,
            })

    rows = stored(slim.mapInPandas(keyed, f"_id {kind}, key binary, label string, dim int, raw binary"), "vectors")
    classes = stored(
        rows.filter("key is not null").groupBy("key").agg(
            F.min("_id").alias("rep"), F.count("*").alias("copies"),
            F.max("label").alias("label"), F.max("dim").alias("dim"), F.max("raw").alias("raw"),
        ), "classes",
    )

    # Vectors meet when label and dimension are equal.
    classes = classes.withColumn("group", F.concat_ws(":", "dim", "label"))
    pairs = _by_passes(classes, threshold, passes, window)
    near = stored(components(pairs, "a", "b"), "near")
    members = near.select(F.col("id").alias("key"), "component").join(classes.select("key", "copies", "raw"), "key")

    def verified(a: Arrays, b: Arrays) -> np.ndarray:
        return _unit(a["raw"]) @ _unit(b["raw"]).T >= threshold

    links = linked_in_blocks(members, "component", "key", F.lit(1), 1024, verified)
    links = links.groupBy("key").agg(F.sum("links").alias("links"))
    known = (
        classes.select("key", "rep", "copies").join(links, "key", "left")
        .join(near.withColumnRenamed("id", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    )
    lowest = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = known.join(lowest, "component").select(
        "key", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    component = F.when(F.col("key").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return rows.select("_id", "key").join(known, "key", "left").select(
        F.col("_id").alias("vec_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"),
    )


def _by_passes(classes: DataFrame, threshold: float, passes: int, window: int) -> DataFrame:
    """Pairs ``a``, ``b`` that connect what is linked in each group.

    A group that fits into a window is compared whole by one pass. In the others a probe is a copy of a member turned in
    a random direction until its cosine with it is ``threshold``; rounds of passes, each with new hashes and a window
    twice as wide, go on until they have met ``FOUND`` of the group's probes. A window that is wide enough meets all.
    """
    sizes = stored(classes.groupBy("group").agg(F.count("*").alias("n")), "sizes")
    wide = classes.join(sizes.filter(F.col("n") > window), "group").filter(
        F.pmod(F.xxhash64(F.lit(31), "key"), F.greatest(F.floor(F.col("n") / PROBES), F.lit(1))) == 0
    )
    sample = stored(wide.select("group", "dim", "key", "raw"), "sample")

    def mean(rows: Arrays) -> Arrays:
        return {"group": rows["group"][:1], "centre": np.array([_unit(rows["raw"]).mean(axis=0).tobytes()], object)}

    def planted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near = min(1.0, threshold + 1e-9)
        for frame in batches:
            made = []
            for key, raw in zip(frame["key"], frame["raw"]):
                unit = _unit(np.array([raw], object))[0]
                turn = np.random.default_rng(list(key)).standard_normal(len(unit))
                turn -= (turn @ unit) * unit
                turn /= max(np.sqrt(turn @ turn), 1e-9)
                made.append((near * unit + np.sqrt(1 - near * near) * turn).astype("<f8").tobytes())
            # A probe is told by the length of its key.
            yield frame.assign(key=[k + b"+" for k in frame["key"]], raw=made)

    centres = stored(by_group(sample.select("group", "raw"), ["group"], mean, "group string, centre binary"), "centres")
    probes = stored(sample.groupBy("group").agg(F.count("*").alias("probes")), "probes")
    every = classes.select("group", "dim", "key", "raw").unionByName(sample.mapInPandas(planted, sample.schema))
    # Groups without a centre fit into a window.
    placed = stored(every.join(centres, "group", "left"), "placed")

    def coded(number: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            planes: dict[int, np.ndarray] = {}
            for frame in batches:
                for (dim, group), part in frame.groupby(["dim", "group"]):
                    centre = part["centre"].iloc[0]
                    if centre is None:
                        yield pd.DataFrame({"pass": np.int32(0), "group": group, "code": 0, "key": part["key"], "raw": part["raw"]})
                        continue
                    if dim not in planes:
                        planes[dim] = np.random.default_rng([17, dim, number]).standard_normal((passes * BITS, dim))
                    # From the centre of the group, so that vectors of one direction still differ in their signs.
                    unit = _unit(part["raw"].to_numpy()) - np.frombuffer(centre)
                    bits = (unit @ planes[dim].T > 0).reshape(len(part), passes, BITS)
                    codes = bits.astype(np.int64) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    for p in range(passes):
                        yield pd.DataFrame({
                            "pass": np.int32(p), "group": group, "code": codes[:, p], "key": part["key"], "raw": part["raw"],
                        })

        return run

    found, number, left = [], 0, placed
    while True:
        found.append(_one_round(left.mapInPandas(coded(number), "pass int, group string, code bigint, key binary, raw binary"), threshold, window << number))
        hits = found[0]
        for more in found[1:]:
            hits = hits.unionByName(more)
        met = hits.filter("group is not null").groupBy("group").agg(F.countDistinct("a").alias("met"))
        poor = stored(
            probes.join(met, "group", "left").filter(F.coalesce("met", F.lit(0)) < FOUND * F.col("probes")).select("group"), "poor"
        )
        if poor.isEmpty():
            return hits.filter("group is null").select("a", "b")
        left, number = placed.join(poor, "group", "left_semi"), number + 1


_FOUND = "a binary, b binary, group string, pass int, part int, at bigint, raw binary"


def _meetings(key: np.ndarray, group: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Pairs that connect what the links ``a - b`` do; and, with their group, probes that met their own vector."""
    probe = np.array([len(k) > 16 for k in key], bool)
    real = ~probe[a] & ~probe[b]
    root = _roots(len(key), a[real], b[real])
    moved = np.flatnonzero(root != np.arange(len(key)))
    met = [(a[k], b[k]) if probe[a[k]] else (b[k], a[k]) for k in np.flatnonzero(probe[a] ^ probe[b])]
    met = sorted({p for p, base in met if key[p][:16] == key[base]})
    return pd.DataFrame({
        "a": [*key[moved], *key[met]] if met else list(key[moved]), "b": [*key[root[moved]], *([None] * len(met))],
        "group": [*([None] * len(moved)), *(group[met] if met else [])],
    }, dtype=object)


def _one_round(rows: DataFrame, threshold: float, window: int) -> DataFrame:
    """``a``, ``b``, ``group`` of the neighbours of all passes that are linked, as ``_meetings`` gives them.

    Partitions hand out their first and last rows as well; these meet again at every border near them, so what is
    found does not depend on where partitions end.
    """
    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, held, n = TaskContext.get().partitionId(), None, 0
        for frame in batches:
            frame = frame.assign(at=np.arange(n, n + len(frame)))
            n += len(frame)
            yield _edge(frame[frame["at"] < window], part)
            if held is not None:
                frame = pd.concat([held, frame], ignore_index=True)
            one, two = [], []
            for _, some in frame.groupby(["pass", "group"], sort=False):
                at, unit = some.index.to_numpy(), _unit(some["raw"].to_numpy())
                for s in range(0, len(unit), 512):
                    near = unit[s:s + 512 + window]
                    i, j = np.nonzero(unit[s:s + 512] @ near.T >= threshold)
                    inside = (j > i) & (j - i <= window)
                    one.append(at[s + i[inside]])
                    two.append(at[s + j[inside]])
            if one and sum(map(len, one)):
                yield _meetings(frame["key"].to_numpy(), frame["group"].to_numpy(), np.concatenate(one), np.concatenate(two)).reindex(columns=columns).astype(object)
            held = frame.tail(window).reset_index(drop=True)
        if held is not None:
            yield _edge(held[held["at"] >= window], part)
            yield pd.DataFrame({"part": [part], "at": [n]}).reindex(columns=columns).astype(object)

    def _edge(frame: pd.DataFrame, part: int) -> pd.DataFrame:
        return frame.rename(columns={"key": "a"}).assign(part=part).reindex(columns=columns).astype(object)

    columns = [c.split()[0] for c in _FOUND.split(", ")]
    order = ["pass", "group", "code", "key"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    out = stored(dealt.mapInPandas(windows, _FOUND), "neighbours")
    counts = {r["part"]: r["at"] for r in out.filter("part is not null and a is null").select("part", "at").collect()}
    parts = sorted(counts)
    first = dict(zip(parts, np.cumsum([0, *(counts[p] for p in parts)]).tolist()))
    borders = np.array([first[p] for p in parts[1:]], np.int64)

    def to_borders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            place = frame["part"].map(first).to_numpy() + frame["at"].to_numpy()
            low, high = np.searchsorted(borders, place - window, side="right"), np.searchsorted(borders, place + window, side="right")
            each = np.repeat(np.arange(len(frame)), high - low)
            inner = np.arange(len(each)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
            yield frame.iloc[each].assign(place=place[each], border=borders[low[each] + inner])[["border", "place", "pass", "group", "a", "raw"]]

    def across(rows: Arrays) -> Arrays | None:
        below, one, two = rows["place"] < rows["border"], [], []
        for p, group in sorted(set(zip(rows["pass"].tolist(), rows["group"].tolist()))):
            here = (rows["pass"] == p) & (rows["group"] == group)
            i, j = np.flatnonzero(here & below), np.flatnonzero(here & ~below)
            if len(i) and len(j):
                linked = _unit(rows["raw"][i]) @ _unit(rows["raw"][j]).T >= threshold
                x, y = np.nonzero(linked & (rows["place"][j] - rows["place"][i][:, None] <= window))
                one.append(i[x])
                two.append(j[y])
        if not one or not sum(map(len, one)):
            return None
        made = _meetings(rows["a"], rows["group"], np.concatenate(one), np.concatenate(two))
        return {c: made[c].to_numpy() for c in made.columns} if len(made) else None

    pairs = out.filter("part is null").select("a", "b", "group")
    if not len(borders):
        return pairs
    edges = out.filter("part is not null and a is not null").mapInPandas(
        to_borders, "border bigint, place bigint, pass int, group string, a binary, raw binary"
    )
    crossing = by_group(edges, ["border"], across, "a binary, b binary, group string")
    return pairs.unionByName(stored(crossing, "crossing"))
