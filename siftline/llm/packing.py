"""Best-fit packing: patterns of few documents fitted to the histogram of lengths by non-negative least squares.

The plan is made from the histogram alone, which has one number per length whatever the data hold. Pieces learn
their place from their rank among pieces of their length, which is summed from counts per task.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftline.llm.tables import stored

# How a byte-level BPE splits a text before merging, in the order of its alternatives.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Runs of blanks, or of other characters, from this length on go to ``tokenizers``.
RUN = 50_000


def _byte_chars() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(rest)}


def encoder(path: str, ordinary: bool = False) -> Callable[[str], list[int]]:
    """Ids of a whole text by the tokenizer file at ``path``, to which no special tokens are added.

    The string of a special token inside a text is that token, as the file has it; with ``ordinary`` it is plain text.

    A plain byte-level BPE whose merges are numbered in order of rank is run by ``tiktoken``, which gives the ids that
    ``tokenizers`` gives in a third of the time. Any other file is run by ``tokenizers``, and so are texts with an
    unbroken run of ``RUN`` characters, on which the split of ``tiktoken`` may exhaust its stack.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = ordinary

    def slow(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    chars = _byte_chars()
    plain = (
        model.get("type") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True)
        and not before.get("add_prefix_space") and not spec.get("normalizer")
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        and all(t["special"] for t in spec.get("added_tokens", []))
    )
    if plain:
        merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        ranks = {bytes(chars[c] for c in w): i for w, i in model["vocab"].items() if all(c in chars for c in w)}
        if None not in merged and merged == sorted(merged) and len(ranks) == len(merged) + 256:
            import tiktoken

            fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            short = re.compile(rf"(?:\S{{1,{RUN - 1}}}+(?!\S)|\s{{1,{RUN - 1}}}+(?!\s))*+").fullmatch
            marks = [] if ordinary else [t["content"] for t in spec.get("added_tokens", [])]

            def encode(text: str) -> list[int]:
                plain_text = (len(text) < RUN or short(text)) and not any(mark in text for mark in marks)
                return fast(text) if plain_text else slow(text)

            return encode
    return slow


def token_pieces(
    docs: DataFrame, tokenizer: str, length: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Token ids of whole documents, cut where longer than ``length``; the first piece takes the remainder.

    ``ids`` are little-endian unsigned 32-bit numbers. ``_part`` and ``_nth`` number the pieces of one length within
    a task; write the result once before it is used.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, seen, part = encoder(tokenizer), np.zeros(length + 1, np.int64), TaskContext.get().partitionId()
        for whole in batches:
            for s in range(0, len(whole), 256):
                frame = whole.iloc[s:s + 256]
                rows = []
                for doc, text in zip(frame["_id"], frame["_text"]):
                    raw = np.array([*encode(text or ""), end], "<u4").tobytes()
                    n = len(raw) // 4
                    cuts = [0, *range((n - 1) % length + 1, n + 1, length)]
                    for k, (f, t) in enumerate(zip(cuts[:-1], cuts[1:])):
                        rows.append((doc, k, f, t - f, raw[4 * f:4 * t], part, seen[t - f]))
                        seen[t - f] += 1
                yield pd.DataFrame(rows, columns=["_id", "piece", "start", "length", "ids", "_part", "_nth"])

    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    schema = f"_id {kind}, piece int, start bigint, length bigint, ids binary, _part int, _nth bigint"
    return slim.mapInPandas(run, schema).withColumnRenamed("_id", id_col)


@dataclass
class Plan:
    """Slots by length: pieces ranked ``first`` .. of a length go to the sequences from ``sequence`` on, at ``offset``."""

    length: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def patterns(lengths: np.ndarray, room: int) -> np.ndarray:
    """All pairs and triples of the lengths that fill a sequence exactly, as rows of three (0: none), longest first."""
    there = np.zeros(room + 1, bool)
    there[lengths] = True
    found = []
    for c in [0, *lengths[lengths <= room // 3]]:
        b = lengths[(lengths >= max(c, 1)) & (lengths <= (room - c) // 2)]
        a = room - c - b
        ok = there[a] & (a < room)
        found.append(np.stack([a[ok], b[ok], np.full(ok.sum(), c)], axis=1))
    return np.concatenate(found) if found else np.empty((0, 3), int)


def fit_counts(rows: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative repeat counts whose lengths come nearest to the histogram, longer lengths weighing more.

    Multiplicative least-squares updates: they keep every count non-negative and never increase the error.
    """
    size = len(histogram)
    at, used = rows.ravel(), rows.ravel() > 0
    weight = np.arange(size) / size
    spread = lambda x: np.bincount(at[used], np.repeat(x, 3)[used], size)
    gather = lambda h: np.where(rows > 0, h[rows], 0.0).sum(axis=1)
    goal = gather(weight * histogram)
    x = np.full(len(rows), histogram.sum() / max(1, 3 * len(rows)))
    for _ in range(rounds):
        now = gather(weight * spread(x))
        x *= np.divide(goal, now, out=np.zeros_like(goal), where=now > 0)
    return x


def _best_fit(histogram: np.ndarray, room: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, by counts: sequences with the same content are handled together."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}
    for size in range(len(histogram) - 1, 0, -1):
        left = int(histogram[size])
        while left:
            gap = next((g for g in range(size, room + 1) if open_.get(g)), None)
            if gap is None:
                each = room // size
                full, rest = divmod(left, each)
                for k, n in ((each, full), (rest, 1)):
                    if k and n:
                        at = open_.setdefault(room - k * size, {})
                        at[(size,) * k] = at.get((size,) * k, 0) + n
                break
            content, n = open_[gap].popitem()
            each = min(gap // size, left)
            take = min(n, left // each)
            if take < n:
                open_[gap][content] = n - take
            at = open_.setdefault(gap - each * size, {})
            wider = content + (size,) * each
            at[wider] = at.get(wider, 0) + take
            left -= take * each
    return [(c, n) for at in open_.values() for c, n in at.items()]


def make_plan(histogram: np.ndarray, room: int) -> Plan:
    """Patterns fitted and rounded, residuals by best fit. ``histogram[n]`` counts pieces of length n."""
    left = histogram.astype(np.int64).copy()
    contents: list[tuple[tuple[int, ...], int]] = [((room,), int(left[room]))] if left[room] else []
    left[room] = 0
    rows = patterns(np.flatnonzero(left), room)
    if len(rows):
        count = fit_counts(rows, left.astype(float))
        used: dict[int, int] = {}
        # Whole parts first, then one more for the largest fractions, as far as pieces are left.
        order = np.concatenate([np.argsort(-np.floor(count), kind="stable"), np.argsort(-(count % 1), kind="stable")])
        want = np.concatenate([np.floor(count), (count % 1 >= 0.5) * 1.0])
        want = want[np.concatenate([order[:len(rows)], order[len(rows):] + len(rows)])].astype(np.int64)
        for k, n in zip(order, want):
            if n:
                sizes = [int(s) for s in rows[k] if s]
                n = min([int(n), *(int(left[s]) // sizes.count(s) for s in sizes)])
                if n:
                    used[int(k)] = used.get(int(k), 0) + n
                    for s in sizes:
                        left[s] -= n
        contents += [(tuple(int(s) for s in rows[k] if s), n) for k, n in used.items()]
    contents += _best_fit(left, room)
    slots, ranks, base = [], np.zeros(room + 1, np.int64), 0
    for sizes, n in contents:
        offset = 0
        for s in sizes:
            slots.append((s, ranks[s], base, offset))
            ranks[s] += n
            offset += s
        base += n
    table = np.array(slots, np.int64).reshape(-1, 4)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return Plan(*table.T, base)


def place(pieces: DataFrame, length: int = 1024) -> DataFrame:
    """``pieces`` (written, with ``length``, ``_part`` and ``_nth``) with ``sequence_id`` and ``offset``."""
    counts = stored(pieces.groupBy("_part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = np.zeros(length + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    plan = make_plan(histogram, length)
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    columns = [c for c in pieces.columns if c not in ("_part", "_nth")]
    ranked = pieces.join(bases, ["_part", "length"]).select(*columns, (F.col("_base") + F.col("_nth")).alias("_rank"))
    wide = 1 << 50  # more than pieces of one length

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts = plan.length * wide + plan.first
        for frame in batches:
            rank = frame.pop("_rank").to_numpy()
            at = np.searchsorted(starts, frame["length"].to_numpy() * wide + rank, side="right") - 1
            yield frame.assign(sequence_id=plan.sequence[at] + rank - plan.first[at], offset=plan.offset[at])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_rank")
    return ranked.mapInPandas(run, schema + ", sequence_id bigint, offset bigint")


def pack_documents(
    docs: DataFrame, tokenizer: str, length: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of all documents with their place: id, ``piece``, ``start``, ``length``, ``ids`` (or the CRC-32 of
    the ids), ``sequence_id`` and ``offset``.

    A null or empty text is its end token alone. The string of a special token inside a text becomes that token. Ids may be null or repeated: every row is packed. Long texts are
    encoded whole, and only they are cut. An empty table gives no pieces. Other columns are ignored.
    """
    pieces = stored(token_pieces(docs, tokenizer, length, end, id_col, text_col), "pieces")
    if not with_ids:
        pieces = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return place(pieces, length)


def packed_sequences(packed: DataFrame) -> DataFrame:
    """The ids of every sequence in order, from pieces with ids: ``sequence_id``, ``ids``, ``offsets``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    grouped = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p.ids))
    return grouped.select("sequence_id", joined.alias("ids"), F.transform("parts", lambda p: p.offset).alias("offsets"))
