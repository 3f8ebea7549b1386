"""Byte-level BPE: boundaries of words by an associative scan over classes of code points, cached merging, decoding.

A text becomes an array of code points, each code point a symbol (its class and, where it matters, what follows it),
and each symbol a function from state to state of a small automaton. These functions form a finite monoid, so their
composition is a look-up in a table and the states of all positions come from one prefix scan over arrays. A
boundary is a pair of state and symbol. Words between boundaries are looked up in a cache or merged by rank.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Classes of code points.
LETTER, NUMBER, OTHER, BLANK = range(4)

# Symbols: the classes; blanks apart by what follows; apostrophes that may begin a contraction of one or two letters.
S_LETTER, S_NUMBER, S_OTHER, S_BLANK, S_LAST_SPACE, S_LAST_BLANK, S_ONE, S_TWO = SYMBOLS = range(8)
FIRST = len(SYMBOLS)  # added to the symbol that begins a text

# States: in letters, numbers, others or blanks; after a space that the next word takes; letters of a contraction
# still to come; after a contraction.
LETTERS, NUMBERS, OTHERS, BLANKS, SPACE, TWO_LEFT, ONE_LEFT, DONE = STATES = range(8)

# The letters after the apostrophe of a contraction.
ENDS_ONE, ENDS_TWO = "stmd", ("re", "ve", "ll")

WINDOW = 1 << 18  # code points that are scanned at once
GROUP = 1 << 19  # bytes of texts that are handled together
CACHED = 1 << 18  # words in the cache, of up to LONGEST bytes
LONGEST = 64
NONE = 1 << 40  # no rank


def classes() -> np.ndarray:
    """The class of every code point, as the library whose ids are wanted has it: by its version of Unicode."""
    import tiktoken

    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    single = {bytes([b]): b for b in range(256)}
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (BLANK, r"\s")):
        found = tiktoken.Encoding(pattern, pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
        table[codes_of(bytes(found).decode("utf-8"))] = kind
    return table


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a word begins at the symbol."""
    if symbol >= FIRST:
        return step(DONE, symbol - FIRST)[0], True
    if state in (TWO_LEFT, ONE_LEFT):
        return (ONE_LEFT if state == TWO_LEFT else DONE), False
    if symbol == S_BLANK:
        return BLANKS, state != BLANKS
    if symbol in (S_LAST_SPACE, S_LAST_BLANK):
        return (SPACE if symbol == S_LAST_SPACE else DONE), True
    if symbol in (S_ONE, S_TWO) and state not in (OTHERS, SPACE):
        return (ONE_LEFT if symbol == S_ONE else TWO_LEFT), True
    into = {S_LETTER: LETTERS, S_NUMBER: NUMBERS}.get(symbol, OTHERS)
    return into, state not in (into, SPACE)


class Automaton:
    """The functions of all symbols and of their compositions, numbered; 0 changes nothing."""

    def __init__(self) -> None:
        symbols = range(2 * FIRST)
        self.begins = np.array([[step(s, x)[1] for x in symbols] for s in STATES]).ravel()
        of = [tuple(step(s, x)[0] for s in STATES) for x in symbols]
        known = {tuple(STATES): 0}
        todo = [tuple(STATES)]
        while todo:
            before = todo.pop()
            for f in of:
                both = tuple(f[s] for s in before)
                if both not in known:
                    known[both] = len(known)
                    todo.append(both)
        self.size = len(known)
        self.of = np.array([known[f] for f in of], np.uint16)
        self.apply = np.array(list(known), np.uint8).ravel()
        self.then = np.array([known[tuple(g[s] for s in f)] for f in known for g in known], np.uint16)

    def scan(self, functions: np.ndarray) -> np.ndarray:
        """The composition of all functions up to each place: within rows side by side, then over the rows."""
        n = len(functions)
        if n == 0:
            return functions
        row = max(2, int(n ** 0.5))
        rows = -(-n // row)
        padded = np.zeros(rows * row, np.uint16)
        padded[:n] = functions
        columns = np.ascontiguousarray(padded.reshape(rows, row).T)
        for k in range(1, row):
            columns[k] = self.then[columns[k - 1].astype(np.intp) * self.size + columns[k]]
        if rows > 1:
            before = np.zeros(rows, np.uint16)
            before[1:] = self.scan(columns[-1])[:-1]
            columns = self.then[before.astype(np.intp) * self.size + columns]
        return np.ascontiguousarray(columns.T).reshape(-1)[:n]

    def boundaries(self, symbols: np.ndarray, state: int) -> tuple[np.ndarray, int]:
        """Where words begin, and the state after the last symbol."""
        reached = self.apply[self.scan(self.of[symbols]).astype(np.intp) * len(STATES) + state]
        before = np.concatenate([[np.uint8(state)], reached[:-1]])
        return np.flatnonzero(self.begins[before.astype(np.intp) * (2 * FIRST) + symbols]), int(reached[-1])


class Words:
    """Splits texts into the words that are merged each by itself."""

    def __init__(self) -> None:
        self.classes, self.automaton = classes(), Automaton()

    def symbols(self, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The symbol of every code point of joined texts that begin at ``starts``."""
        kinds = self.classes[codes]
        symbols = kinds.copy()  # letters, numbers, others and blanks keep their number
        ends = np.append(starts[1:], len(codes))
        last = np.zeros(len(codes), bool)
        last[:-1] = (kinds[:-1] == BLANK) & (kinds[1:] != BLANK)
        last[ends - 1] = False
        symbols[last] = np.where(codes[last] == 32, S_LAST_SPACE, S_LAST_BLANK)
        marks = np.flatnonzero(codes == 39)
        if len(marks):
            left = ends[np.searchsorted(starts, marks, side="right") - 1] - marks - 1
            padded = np.concatenate([codes, [0, 0]])
            one, two = np.where(left > 0, padded[marks + 1], 0), np.where(left > 1, padded[marks + 2], 0)
            symbols[marks[np.isin(one, codes_of(ENDS_ONE))]] = S_ONE
            pair = reduce(np.logical_or, [(one == ord(a)) & (two == ord(b)) for a, b in ENDS_TWO])
            symbols[marks[pair]] = S_TWO
        symbols[starts] += FIRST
        return symbols

    def split(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Non-empty texts joined as UTF-8, where their words begin (and the end), and the number of words of each text."""
        joined = "".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(lengths) - lengths
        edges, counts, state, size = [], np.zeros(len(texts), np.int64), DONE, 0
        for s in range(0, len(joined), WINDOW):
            # Two more code points are seen, as a contraction has two letters; texts that begin there do no harm.
            e = min(s + WINDOW, len(joined))
            codes = codes_of(joined[s:e + 2])
            own = starts[(starts >= s) & (starts < s + len(codes))] - s
            goes_on = not len(own) or own[0] > 0
            symbols = self.symbols(codes, np.append(0, own) if goes_on else own)[:e - s]
            if goes_on:
                symbols[0] -= FIRST
            at, state = self.automaton.boundaries(symbols, state)
            text = np.searchsorted(starts, at + s, side="right") - 1
            counts += np.bincount(text, minlength=len(texts))
            codes = codes[:e - s]
            widths = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
            places = np.cumsum(widths, dtype=np.int64)
            edges.append(places[at] - widths[at] + size)
            size += int(places[-1])
        return joined.encode("utf-8"), np.concatenate([*edges, [size]]), counts


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank, which is also the id, of every token of a rank file: a token in base 64 and its rank on each line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merged(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one word: the adjacent pair of lowest rank is merged, the first of equals, until none has a rank."""
    if (whole := ranks.get(word)) is not None:
        return (whole,)
    n = len(word)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    gone = bytearray(n)

    def pair(k: int) -> tuple[int, int, int] | None:
        second = after[k]
        if second >= n or (rank := ranks.get(word[k:end[second]])) is None:
            return None
        return rank, k, end[second]

    heap = [p for k in range(n) if (p := pair(k))]
    heapq.heapify(heap)
    while heap:
        _, k, stop = heapq.heappop(heap)
        if gone[k] or after[k] >= n or end[after[k]] != stop:
            continue  # one of the two has been merged since
        second = after[k]
        gone[second], end[k], after[k] = 1, stop, after[second]
        if after[k] < n:
            before[after[k]] = k
        for at in (before[k], k):
            if at >= 0 and (p := pair(at)):
                heapq.heappush(heap, p)
    return tuple(ranks[word[k:end[k]]] for k in range(n) if not gone[k])


def packed(ids) -> bytes:
    """Ids as little-endian numbers of 32 bits, which take a fraction of the memory of tuples."""
    return np.asarray(ids, "<u4").tobytes()


class Merges(dict):
    """Packed ids of words. Short words that are new are merged side by side, one pair of each at a time, by a table of pairs;
    their ids stay in this cache, whose size is bounded."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.size = ranks, max(ranks.values(), default=0) + 1
        self.bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        pairs = {
            ranks[t[:k]] * self.size + ranks[t[k:]]: r
            for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks
        }
        self.keys_of_pairs = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(self.keys_of_pairs)
        self.keys_of_pairs = self.keys_of_pairs[order]
        self.ranks_of_pairs = np.fromiter(pairs.values(), np.int64, len(pairs))[order]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, or NONE; ids below zero have none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys_of_pairs, key), len(self.keys_of_pairs) - 1)
        known = (self.keys_of_pairs[at] == key) & (left >= 0) & (right >= 0) if len(self.keys_of_pairs) else np.zeros(len(key), bool)
        return np.where(known, self.ranks_of_pairs[at] if len(self.keys_of_pairs) else NONE, NONE)

    def merged_together(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words of up to ``LONGEST`` bytes, of which none is a token."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        wide = int(n.max())
        column = np.arange(wide)
        ids = np.full((len(words), wide), -1, np.int64)
        ids[column < n[:, None]] = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        ranks = np.full((len(words), wide), NONE, np.int64)
        ranks[:, :-1] = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(words), -1)
        done, going = ids.copy(), np.arange(len(words))
        while len(going):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(going)), at]
            open_ = best < NONE
            done[going[~open_]] = ids[~open_]
            going, ids, ranks, at, best = going[open_], ids[open_], ranks[open_], at[open_], best[open_]
            if not len(going):
                break
            row = np.arange(len(going))
            ids[row, at] = best
            shift = np.minimum(column + (column > at[:, None]), wide - 1)
            ids, ranks = np.take_along_axis(ids, shift, 1), np.take_along_axis(ranks, shift, 1)
            ids[:, -1], ranks[:, -1] = -1, NONE
            right = np.where(at + 1 < wide, ids[row, np.minimum(at + 1, wide - 1)], -1)
            ranks[row, at] = self.pair_ranks(best, right)
            inner = at > 0
            ranks[row[inner], at[inner] - 1] = self.pair_ranks(ids[row[inner], at[inner] - 1], best[inner])
        kept = done >= 0
        flat, ends = packed(done[kept]), (4 * np.cumsum(kept.sum(axis=1))).tolist()
        return [flat[s:e] for s, e in zip([0, *ends[:-1]], ends)]

    def of_words(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of every word."""
        new = set(words) - self.keys()
        if len(self) + len(new) > CACHED:
            self.clear()
            new = set(words)
        long: dict[bytes, bytes] = {}
        by_size: dict[int, list[bytes]] = {}
        for word in new:
            if (whole := self.ranks.get(word)) is not None:
                self[word] = packed([whole])
            elif len(word) > LONGEST:
                long[word] = packed(merged(word, self.ranks))
            else:
                by_size.setdefault((len(word) + 3) // 4, []).append(word)
        for alike in by_size.values():
            self.update(zip(alike, self.merged_together(alike)))
        return [long[w] if w in long else self[w] for w in words] if long else list(map(self.__getitem__, words))

    def of(self, data: bytes, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words of ``data`` between ``edges``, and the number of ids of each word."""
        first, same = distinct(data, edges)
        tokens = self.of_words(list(map(data.__getitem__, map(slice, edges[first].tolist(), edges[first + 1].tolist()))))
        each = np.fromiter(map(len, tokens), np.int64, len(tokens)) // 4
        flat = np.frombuffer(b"".join(tokens), "<u4").astype(np.int64)
        sizes = each[same]
        shift = (np.cumsum(each) - each)[same] - (np.cumsum(sizes) - sizes)
        return flat[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))], sizes


def distinct(data: bytes, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that stand for all: their places, and for every word the one that equals it.

    Words of up to 16 bytes are compared as two numbers, and may be found more than once; longer ones stand for
    themselves.
    """
    starts, sizes = edges[:-1], np.diff(edges)
    padded = data + bytes(16)
    eight = np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))
    masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
    low = eight[starts] & masks[np.minimum(sizes, 8)]
    high = eight[np.minimum(starts + 8, len(data) + 8)] & masks[np.clip(sizes - 8, 0, 8)]
    mixed = (low * np.uint64(0x9E3779B97F4A7C15)) ^ ((high + sizes.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(mixed)
    low, high, size = low[order], high[order], sizes[order]
    new = np.ones(len(order), bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (size[1:] != size[:-1]) | (size[1:] > 16)
    same = np.empty(len(order), np.int64)
    same[order] = np.cumsum(new) - 1
    return order[new], same


def groups_of(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most ``GROUP`` bytes together, or of one longer text."""
    start = total = 0
    for k, size in enumerate(sizes):
        if k > start and total + size > GROUP:
            yield start, k
            start, total = k, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.astype(np.int32, copy=False))
    )


def encode_documents(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``ids`` and ``offsets`` of every text: token ids by the rank file at ``ranks``, and where the bytes of
    each token begin in the UTF-8 text.

    Whole texts are encoded. A null or empty text has no tokens. Ids may be null or repeated: there is one row for each
    row. Strings of special tokens are ordinary text. An empty table gives no rows. Other columns are ignored, so their
    names do not matter. Nothing is shuffled; a task holds about ``GROUP`` bytes, or one longer text.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = read_ranks(ranks)
        words, merges = Words(), Merges(known)
        lengths = np.zeros(max(known.values(), default=0) + 1, np.int64)
        for token, rank in known.items():
            lengths[rank] = len(token)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for s, e in groups_of(sizes):
                texts = batch.column(1).slice(s, e - s).to_pylist()
                per_text = np.zeros(e - s, np.int64)
                ids = np.zeros(0, np.int64)
                if some := [k for k, text in enumerate(texts) if text]:
                    data, edges, counts = words.split([texts[k] for k in some])
                    ids, sizes = merges.of(data, edges)
                    per_text[np.array(some)] = np.add.reduceat(sizes, np.cumsum(counts) - counts)
                begin = np.cumsum(lengths[ids]) - lengths[ids]
                first = np.cumsum(per_text) - per_text
                base = np.append(begin, 0)[np.minimum(first, len(begin))]
                begin = begin - np.repeat(base, per_text)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s, e - s), _lists(ids, per_text), _lists(begin, per_text)], ["_id", "ids", "offsets"]
                )

    slim = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return slim.mapInArrow(run, f"_id {kind}, ids array<int>, offsets array<int>").withColumnRenamed("_id", id_col)


def decode_documents(encoded: DataFrame, ranks: str) -> DataFrame:
    """``encoded`` (columns ``ids`` and ``offsets``) with ``decoded``: every token's bytes written at its offset.

    Null lists count as empty. Ids that the rank file lacks have no bytes.
    """
    schema = encoded.select("*", F.lit(b"").alias("decoded")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = read_ranks(ranks)
        size = max(known.values(), default=-1) + 2  # the last has no bytes and stands for unknown ids
        lengths = np.zeros(size, np.int64)
        for token, rank in known.items():
            lengths[rank] = len(token)
        place = np.cumsum(lengths) - lengths
        pool = np.zeros(int(lengths.sum()), np.uint8)
        for token, rank in known.items():
            pool[place[rank]:place[rank] + len(token)] = np.frombuffer(token, np.uint8)
        for batch in batches:
            out = []
            for ids, offsets in zip(batch.column("ids"), batch.column("offsets")):
                ids = np.zeros(0, np.int64) if ids.values is None else ids.values.to_numpy(zero_copy_only=False).astype(np.int64)
                begin = np.zeros(0, np.int64) if offsets.values is None else offsets.values.to_numpy(zero_copy_only=False)
                ids = np.where((ids < 0) | (ids >= size), size - 1, ids)
                data = bytearray()
                for s in range(0, len(ids), WINDOW):
                    few, at = ids[s:s + WINDOW], begin[s:s + WINDOW].astype(np.int64)
                    n = lengths[few]
                    part = np.zeros(int((at[-1] + n[-1]) - at[0]), np.uint8)
                    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    part[np.repeat(at - at[0], n) + inner] = pool[np.repeat(place[few], n) + inner]
                    data += part.tobytes()
                out.append(bytes(data))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)
