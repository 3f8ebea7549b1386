"""Alignment of the tokens of two tokenizers by the bytes they stand for, with corpus-wide counts of linked ids.

Both tokenizers cut the same bytes. Where a token of each ends at one byte, a group ends and the two are linked; of
linked tokens one is a suffix of the other, so the number of different pairs is bounded by the two vocabularies
(``most_pairs``), whatever the corpus. Distinct pairs get a minimal perfect hash; every task counts into a dense
vector indexed by it, the vectors are summed as a tree, and a second pass aligns the documents again and looks the
counts up. Keys are kept beside the counts and compared, as a perfect hash answers for any key.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.packing import _byte_chars, encoder
from siftline.llm.tables import stored

GROUP = 1 << 21  # bytes of texts that are aligned together
CACHED = 1 << 18  # segments in the cache, of up to LONGEST characters
LONGEST = 64
SPACE_MARK = "▁"  # fixed value: how a piece writes a space


def byte_level_tokens(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level tokenizer file; ids without a token have none."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    vocab, chars = spec["model"]["vocab"], _byte_chars()
    known = {i: bytes(chars[c] for c in w) if all(c in chars for c in w) else w.encode() for w, i in vocab.items()}
    return [known.get(i, b"") for i in range(max(known, default=-1) + 1)]


def piece_tokens(processor) -> list[bytes]:
    """The bytes of every id of a piece model: the piece with its spaces, or the byte that it names."""
    def one(piece: str) -> bytes:
        return bytes([int(piece[3:5], 16)]) if re.fullmatch(r"<0x[0-9A-F]{2}>", piece) else piece.replace(SPACE_MARK, " ").encode()

    return [one(processor.id_to_piece(i)) for i in range(processor.get_piece_size())]


def piece_processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Pieces:
    """Ids of whole texts by a piece model, segment by segment through a cache.

    If no piece holds a space after another character, nothing is merged across the start of a run of spaces, so the
    segments that begin there can be encoded by themselves. A text with a segment whose pieces do not spell it is
    encoded whole.
    """

    def __init__(self, path: str) -> None:
        self.processor = piece_processor(path)
        self.tokens = piece_tokens(self.processor)
        pieces = [self.processor.id_to_piece(i) for i in range(len(self.tokens))]
        self.apart = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
        self.cache: dict[str, tuple[int, ...] | None] = {}
        self.cut = re.compile(" +[^ ]*").findall

    def segment(self, text: str) -> tuple[int, ...] | None:
        """Ids of a segment, which begins with a space; nothing if they do not spell it."""
        ids = tuple(self.processor.encode(text[1:])) if text != " " else (self.processor.piece_to_id(SPACE_MARK),)
        return ids if b"".join(self.tokens[i] for i in ids) == text.encode() else None

    def ids(self, text: str) -> list[int]:
        """Ids of a text that is not empty; the model puts a space in front."""
        if self.apart:
            cache, out = self.cache, []
            for part in self.cut(" " + text):
                ids = cache.get(part)
                if ids is None:
                    ids = self.segment(part)
                    if ids is None:
                        return self.processor.encode(text)
                    if len(part) <= LONGEST:
                        if len(cache) >= CACHED:
                            cache.clear()
                        cache[part] = ids
                out += ids
            return out
        return self.processor.encode(text)


def token_pairs(docs: DataFrame, byte_level: str, pieces: str, id_col: str, text_col: str) -> DataFrame:
    """``_id``, ``a`` and ``b``: ids of each text with a space in front by both tokenizers, as little-endian numbers.

    Both are empty where the text is null or empty, or where the bytes of either differ from the text's.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, tokens, model = encoder(byte_level, ordinary=True), byte_level_tokens(byte_level), Pieces(pieces)
        kind_a, kind_b = width(len(tokens)), width(len(model.tokens))

        def both(text: str | None) -> tuple[bytes, bytes]:
            if not text:
                return b"", b""
            raw = (" " + text).encode()
            a, b = encode(" " + text), model.ids(text)
            if b"".join(map(tokens.__getitem__, a)) != raw or b"".join(map(model.tokens.__getitem__, b)) != raw:
                return b"", b""
            return np.array(a, kind_a).tobytes(), np.array(b, kind_b).tobytes()

        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                few = batch.slice(s, 512)
                a, b = zip(*map(both, few.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["_id", "a", "b"])

    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return slim.mapInArrow(run, f"_id {kind}, a binary, b binary")


def width(size: int) -> str:
    """The number type that holds ids below ``size``."""
    return "<u2" if size <= 1 << 16 else "<u4"


@dataclass
class Aligned:
    """Documents aligned together: the ids of both sides, and which of them end a group."""

    a: np.ndarray
    b: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray
    per_a: np.ndarray  # tokens by document
    per_b: np.ndarray

    def by_document(self, values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Sums of ``values`` between ``ends``."""
        sums = np.append(0, np.cumsum(values, dtype=np.int64))[ends]
        return np.diff(sums, prepend=0)


def align(a: list[bytes], b: list[bytes], sizes: tuple[np.ndarray, np.ndarray]) -> Aligned:
    """Groups of the tokens of documents whose ids are given by ``token_pairs``. ``sizes`` are bytes by id."""
    kinds = width(len(sizes[0])), width(len(sizes[1]))
    per = [np.array([len(x) for x in side], np.int64) // np.dtype(k).itemsize for side, k in zip((a, b), kinds)]
    ids = [np.frombuffer(b"".join(side), k).astype(np.int64) for side, k in zip((a, b), kinds)]
    ends = [np.cumsum(size[i]) for size, i in zip(sizes, ids)]
    last = []
    for own, other in (ends, ends[::-1]):
        mark = np.zeros(int(own[-1]) + 1 if len(own) else 1, bool)
        mark[other] = True
        last.append(mark[own])
    return Aligned(*ids, *last, *per)


def batches_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[bytes], list[bytes]]]:
    """Rows of about ``GROUP`` bytes of ids at a time."""
    a, b = batch.column(1).to_pylist(), batch.column(2).to_pylist()
    start = size = 0
    for k in range(len(a)):
        size += len(a[k]) + len(b[k])
        if size >= GROUP or k + 1 == len(a):
            yield batch.column(0).slice(start, k + 1 - start), a[start:k + 1], b[start:k + 1]
            start, size = k + 1, 0


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """Hashes of 64 bits, other ones for each level."""
    x = keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct keys: in each level, keys that fall alone on a bit set it, the others go on
    to the next level; the index of a key is the rank of its bit."""

    def __init__(self, keys: np.ndarray) -> None:
        self.size, self.words, self.before, self.levels = len(keys), [], [], []
        seen, left = 0, keys
        while len(left):
            bits = max(64, -(-2 * len(left) // 64) * 64)
            at = (_mixed(left, len(self.levels)) % np.uint64(bits)).astype(np.int64)
            alone = np.bincount(at, minlength=bits) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            each = np.bitwise_count(words).astype(np.int64)
            self.levels.append(bits)
            self.words.append(words)
            self.before.append(seen + np.cumsum(each) - each)
            seen += int(each.sum())
            left = left[~alone[at]]

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of every key; some index or -1 for keys that are not among those hashed."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, words, before) in enumerate(zip(self.levels, self.words, self.before)):
            at = _mixed(keys[left], level) % np.uint64(bits)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            there = (words[word] >> bit) & np.uint64(1) == 1
            below = words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            rank = before[word] + np.bitwise_count(below)
            out[left[there]] = rank[there]
            left = left[~there]
        return out


def most_pairs(a: list[bytes], b: list[bytes]) -> int:
    """No corpus links more pairs of ids than this: of two linked tokens one is a suffix of the other."""
    return sum(
        sum(count.get(token[k:], 0) for k in range(len(token)))
        for side, other in ((a, b), (b, a)) for count in [_counts(other)] for token in side
    )


def _counts(tokens: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for token in tokens:
        out[token] = out.get(token, 0) + 1
    return out


def align_tokenizers(
    docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Tokens of every text by two tokenizers, in groups of equal bytes, with counts of their links over all texts.

    Columns: the id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose count is the highest that
    their second id has), ``count_sum`` and ``groups`` (``a1,a2|b1;a3|b2,b3``). A null or empty text, and one whose
    bytes either tokenizer changes, has no tokens: zeros and an empty string. Strings of special tokens are plain
    text. Ids may be null or repeated: there is one row for each row. An empty table gives no rows. Other columns are
    ignored. Texts are encoded once; their ids lie in the shared folder and are aligned again by each pass.
    """
    spark = docs.sparkSession
    tokens = byte_level_tokens(byte_level), piece_tokens(piece_processor(pieces))
    sizes = tuple(np.array([len(t) for t in side], np.int64) for side in tokens)
    if any((s == 0).any() for s in sizes):
        raise ValueError("every token must stand for at least one byte")
    n_b, most = len(tokens[1]), most_pairs(*tokens)
    encoded = stored(token_pairs(docs, byte_level, pieces, id_col, text_col), "tokens", codec="zstd")

    def links(x: Aligned) -> np.ndarray:
        return x.a[x.last_a] * n_b + x.b[x.last_b]

    def different(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64)
        for batch in batches:
            for _, a, b in batches_of(batch):
                held = np.union1d(held, links(align(a, b, sizes)))
        for s in range(0, len(held), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(held[s:s + (1 << 16)])], ["pair"])

    found = encoded.mapInArrow(different, "pair bigint").distinct().toArrow().column("pair").to_numpy()
    if len(found) > most:
        raise RuntimeError(f"{len(found)} pairs of ids, though no more than {most} can be linked")
    perfect = PerfectHash(found)
    keys = np.zeros(len(found), np.int64)
    keys[perfect.index(found)] = found
    shared = spark.sparkContext.broadcast((perfect, keys))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perfect, keys = shared.value
        counts = np.zeros(len(keys), np.int64)
        for batch in batches:
            for _, a, b in batches_of(batch):
                counts += np.bincount(known_index(perfect, keys, links(align(a, b, sizes))), minlength=len(keys))
        yield pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary())], ["counts"])

    vectors = encoded.mapInArrow(counted, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    counts = vectors.treeReduce(np.add) if len(found) else np.zeros(0, np.int64)
    best = np.zeros(n_b, np.int64)
    np.maximum.at(best, keys % n_b, counts)
    looked_up = spark.sparkContext.broadcast((perfect, keys, counts, best))
    kind = dict(docs.dtypes)[id_col]
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perfect, keys, counts, best = looked_up.value
        written = writer(max(map(len, tokens)))
        for batch in batches:
            for ids, a, b in batches_of(batch):
                x = align(a, b, sizes)
                pairs = links(x)
                count = counts[known_index(perfect, keys, pairs)]
                ends = np.append(0, np.cumsum(x.last_a))[np.cumsum(x.per_a)]  # links up to each document
                n_links = np.diff(ends, prepend=0)
                columns = [
                    x.per_a, x.per_b, n_links, n_links, x.by_document(count == best[pairs % n_b], ends),
                    x.by_document(count, ends),
                ]
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(c.astype(np.int64)) for c in columns), pa.array(written(x), pa.string())],
                    ["_id", *names, "groups"],
                )

    schema = f"_id {kind}, " + ", ".join(f"{n} bigint" for n in names) + ", groups string"
    return encoded.mapInArrow(described, schema).withColumnRenamed("_id", id_col)


def known_index(perfect: PerfectHash, keys: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Where the counts of ``pairs`` stand; the keys there must be the pairs."""
    at = perfect.index(pairs)
    if len(at) and (at.min() < 0 or not np.array_equal(keys[at], pairs)):
        raise RuntimeError("a pair is met that was not counted: the documents have changed between passes")
    return at


def writer(size: int) -> Callable[[Aligned], list[str]]:
    """Writes the groups of each document: ids by comma, sides by bar, groups by semicolon."""
    table = [f"{i}{mark}" for mark in ",|;" for i in range(size)]

    def written(x: Aligned) -> list[str]:
        ends_a, ends_b = np.flatnonzero(x.last_a) + 1, np.flatnonzero(x.last_b) + 1
        group_a, group_b = (np.cumsum(last) - last for last in (x.last_a, x.last_b))
        codes = np.empty(len(x.a) + len(x.b), np.int64)
        codes[np.arange(len(x.a)) + np.append(0, ends_b)[group_a]] = x.a + size * x.last_a
        codes[np.arange(len(x.b)) + ends_a[group_b]] = x.b + 2 * size * x.last_b
        codes, stops = codes.tolist(), np.cumsum(x.per_a + x.per_b).tolist()
        return ["".join(map(table.__getitem__, codes[s:e]))[:-1] for s, e in zip([0, *stops[:-1]], stops)]

    return written
