"""Byte-level BPE, alignment of tokenizers and whitening on small tables, against plain versions and libraries."""

import collections
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm.alignment import PerfectHash, Pieces, align_tokenizers, byte_level_tokens, most_pairs, piece_tokens
from siftline.llm.bytebpe import WINDOW, Merges, Words, decode_documents, encode_documents, merged, packed, read_ranks
from siftline.llm.whitening import whiten

tokenizers, tiktoken = pytest.importorskip("tokenizers"), pytest.importorskip("tiktoken")
sentencepiece, files = pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")
regex = pytest.importorskip("regex")
RANKS, BYTE_LEVEL, PIECES = (files.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))

TEXTS = [
    None, "", " ", "\n", "  \n ", "a", "it's  'S we'll''ve\t'd x'", "tab\t two  spaces   end ", "é中文 12½٣ 　x y", "<|endoftext|> </s> <s>",
    "a▁b ▁", "ﬁ ① é ​", "emoji 👩‍👩‍👧 🇩🇪", "same", "same", "word " * 3000, "x" * 5000, "\n\n  indented\n\n\n", "don't 'tis they're I'd",
]


def some_texts(n=400):
    rng = random.Random(5)
    parts = list("  \n\t''''strevmldlabc12é.!? 　 ñ٣中") + ["'re", "'ll", " '", "''", " the", "ing "]
    return TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def library():
    return tiktoken.Encoding("own", pat_str=files.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})


def test_boundaries_equal_the_pattern():
    words, find = Words(), regex.compile(files.PATTERN).findall
    texts = [t for t in some_texts(4000) if t] + ["a'" + "b c'll  " * (WINDOW // 4), "'re"]
    data, edges, counts = words.split(texts)
    got = [data[s:e].decode() for s, e in zip(edges, edges[1:])]
    want = [find(t) for t in texts]
    assert got == [w for one in want for w in one]
    assert counts.tolist() == [len(one) for one in want]


def test_words_of_every_code_point_equal_the_library():
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [f"{c}a{c}1{c}!{c} {c}" for c in every[::7]]
    words, merges, encode = Words(), Merges(read_ranks(RANKS)), library().encode_ordinary
    data, edges, _ = words.split(texts)
    assert merges.of(data, edges)[0].tolist() == [i for t in texts for i in encode(t)]


def test_merging_by_brute_force():
    ranks, rng = read_ranks(RANKS), random.Random(1)
    words = [bytes(rng.choice(b"aabcde th.\xc3\xa9\xff") for _ in range(rng.randint(1, 90))) for _ in range(1500)] + [b"abab cd" * 2000]

    def plain(word):
        if word in ranks:
            return (ranks[word],)
        parts = [word[k:k + 1] for k in range(len(word))]
        while True:
            pairs = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not pairs:
                return tuple(ranks[p] for p in parts)
            k = min(pairs)[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]

    want = [plain(w) for w in words[:-1]]
    assert Merges(ranks).of_words(words)[:-1] == [packed(w) for w in want]
    assert [merged(w, ranks) for w in words[:-1]] == want
    assert merged(words[-1], ranks) == tuple(library()._core_bpe.encode_single_piece(words[-1]))


def test_encode_and_decode(spark):
    texts, encode = some_texts(), library().encode_ordinary
    docs = spark.createDataFrame(
        [(k if k % 7 else None, t, "x", k) for k, t in enumerate(texts)], "doc_id bigint, text string, _id string, ids int"
    )
    rows = decode_documents(encode_documents(docs, RANKS), RANKS).collect()
    assert collections.Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in rows) == collections.Counter(
        (k if k % 7 else None, tuple(encode(t or "")), (t or "").encode()) for k, t in enumerate(texts)
    )
    lengths = {i: len(t) for t, i in read_ranks(RANKS).items()}
    for r in rows:
        assert list(r.offsets) == [0, *np.cumsum([lengths[i] for i in r.ids])][:len(r.ids)]
    assert encode_documents(docs.limit(0), RANKS).count() == 0


def aligned_by_hand(texts):
    tokenizer = tokenizers.Tokenizer.from_file(BYTE_LEVEL)
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    bytes_a, bytes_b = byte_level_tokens(BYTE_LEVEL), piece_tokens(model)
    found, count, best = [], collections.Counter(), collections.Counter()
    for text in texts:
        a = tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        if any(b"".join(t[i] for i in ids) != (" " + (text or "")).encode() for t, ids in ((bytes_a, a), (bytes_b, b))):
            a, b = [], []
        ends = [np.cumsum([len(t[i]) for i in ids]).tolist() for t, ids in ((bytes_a, a), (bytes_b, b))]
        groups, s, t = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            e, f = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append((a[s:e], b[t:f]))
            s, t = e, f
        links = [(x[-1], y[-1]) for x, y in groups]
        count.update(links)
        found.append((a, b, groups, links))
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [
        (len(a), len(b), len(g), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
         ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g))
        for a, b, g, links in found
    ], len(count)


def test_alignment_by_brute_force(spark):
    texts = some_texts()
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id bigint, text string, groups string")
    got = {r.doc_id: r for r in align_tokenizers(docs.repartition(5), BYTE_LEVEL, PIECES).collect()}
    want, pairs = aligned_by_hand(texts)
    for k, values in enumerate(want):
        r = got[k]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) == values, texts[k]
    assert any(t and not w[0] for t, w in zip(texts, want)) and len(got) == len(texts)
    assert pairs <= most_pairs(byte_level_tokens(BYTE_LEVEL), piece_tokens(sentencepiece.SentencePieceProcessor(model_file=PIECES)))
    assert align_tokenizers(docs.limit(0), BYTE_LEVEL, PIECES).count() == 0
    assert align_tokenizers(docs.filter("text is null"), BYTE_LEVEL, PIECES).first().groups == ""


def test_segments_equal_whole_texts():
    pieces = Pieces(PIECES)
    assert pieces.apart
    for text in some_texts(3000):
        if text:
            assert pieces.ids(text) == pieces.processor.encode(text), text


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 31, 20_000))
    perfect = PerfectHash(keys)
    assert sorted(perfect.index(keys)) == list(range(len(keys)))
    others = np.setdiff1d(np.arange(1000, dtype=np.int64), keys)
    held = np.zeros(len(keys), np.int64)
    held[perfect.index(keys)] = keys
    at = perfect.index(others)
    assert ((at == -1) | (held[at] != others)).all()
    assert len(PerfectHash(keys[:0]).index(keys[:0])) == 0


def whitened_by_hand(vectors, components=4):
    good = [v for v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max(map(len, good))
    rows = [tuple(math.floor(256 * c) for c in v) + (0,) * (dims - len(v)) for v in good]
    fit = sorted(set(rows))
    n, sums = len(fit), [sum(x) for x in zip(*fit)]
    v = np.array([
        [float(Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit), n ** 3)) for j in range(dims)] for i in range(dims)
    ])
    values, axes = np.linalg.eigh(v)
    order = np.argsort(-values)[:components]
    white = [
        [sum(float(Fraction(n * c - s, n)) * a for c, s, a in zip(x, sums, axes[:, k])) / math.sqrt(values[k]) for k in order]
        for x in rows
    ]
    return n, [sum((n * c - s) ** 2 for c, s in zip(x, sums)) for x in rows], np.array(white), values[order] / np.trace(v)


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e13])
def test_whitening_by_brute_force(spark, scale):
    rng = np.random.default_rng(9)
    mixed = (rng.normal(size=(120, 6)) @ rng.normal(size=(6, 6)) + 3) * scale
    vectors = [*mixed.tolist(), mixed[0].tolist(), (mixed[1] + 1e-9).tolist(), None, [1.0, None], [math.nan] * 6, [math.inf] + [0.0] * 5, [-0.0, 1.0]]
    table = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<double>").withColumn("n", F.lit("clash"))
    got = whiten(table.repartition(3)).orderBy("vec_id", "component").collect()
    n, apart, white, explained = whitened_by_hand(vectors)
    used = [k for k, v in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    assert [(r.vec_id, r.component) for r in got] == [(k, c) for k in used for c in (1, 2, 3, 4)]
    assert {r.n for r in got} == {n} and [int(r.deviation) for r in got[::4]] == apart
    found = np.array([r.whitened for r in got]).reshape(-1, 4)
    assert np.allclose(found * np.sign(found[0]), white * np.sign(white[0]), rtol=1e-7, atol=1e-7)
    assert np.allclose([r.explained for r in got[:4]], explained, rtol=1e-9)
    assert got[0].identity_error < 1e-6


def test_whitening_of_few_vectors(spark):
    kinds = "vec_id bigint, embedding array<float>"
    assert whiten(spark.createDataFrame([], kinds)).count() == 0
    assert whiten(spark.createDataFrame([(1, None)], kinds)).count() == 0
    one = whiten(spark.createDataFrame([(1, [0.5, 0.25]), (None, [0.5, 0.25])], kinds)).collect()
    assert len(one) == 4 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.identity_error is None for r in one)
    flat = whiten(spark.createDataFrame([(k, [float(k), 2.0 * k, 1.0]) for k in range(5)], kinds)).orderBy("vec_id", "component").collect()
    assert len(flat) == 15 and flat[0].whitened is not None and flat[1].whitened is None and flat[0].identity_error < 1e-9
