"""Near duplicates, packing, WARC, toxicity and the pipeline on small tables."""

import base64
import collections
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm.blocks import components
from siftline.llm.jaccard import _common, _survivors, jaccard_groups, least_matches, one_of_each_group, signature
from siftline.llm.packing import encoder, make_plan, pack_documents, packed_sequences, token_pieces
from siftline.llm.toxicity import THRESHOLD, swapped, toxicity, train
from siftline.llm.vectors import _one_round, near_vectors
from siftline.llm.warc import read_warc, write_warc

tokenizers = pytest.importorskip("tokenizers")


def labels_of(n, links):
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    return [top(k) for k in range(n)]


def test_components_by_brute_force(spark):
    rng = np.random.default_rng(6)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(400, 460)]
    links += [(500, 501 + k) for k in range(80)]
    want = labels_of(600, links)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {k: want[k] for a, b in links if a != b for k in (a, b)}


def near_texts():
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    passage = [word() for _ in range(60)]
    texts = []
    for _ in range(30):
        base = [word() for _ in range(rng.integers(40, 160))]
        for _ in range(rng.integers(1, 6)):
            copy = list(base)
            for p in rng.integers(0, len(copy), rng.integers(0, 4)):
                copy[p] = word()
            texts.append(" ".join(copy))
    texts += [" ".join(passage + [word() for _ in range(100)]) for _ in range(30)]
    return texts + texts[:3] + [None, "", " \n", "one two", "one  two", "one", "w " * 3000]


def links_by_hand(texts):
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    pairs = [
        (a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b]
        and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    ]
    count = collections.Counter(x for p in pairs for x in p)
    return count, labels_of(len(sets), pairs), sets


def test_jaccard_by_brute_force(spark):
    texts = near_texts()
    count, group, sets = links_by_hand(texts)
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id bigint, text string, key string")
    got = {r.id: r for r in jaccard_groups(docs).collect()}
    assert len(got) == len(texts)
    for k in range(len(texts)):
        same = [j for j, s in enumerate(sets) if s == sets[k]] if sets[k] else [k]
        assert (got[k].n_links, got[k].group_id, got[k].class_id) == (count[k], group[k], min(same))
    kept = one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(group))
    assert jaccard_groups(docs.limit(0)).count() == 0


def test_jaccard_null_and_repeated_ids(spark):
    a, b = "a b c d e f g h", "r s t u v w x y"
    docs = spark.createDataFrame([(None, a), (1, a), (1, a), (2, b), (2, b + " z"), (3, None), (3, "q")], "doc_id bigint, text string")
    rows = jaccard_groups(docs).collect()
    assert len(rows) == 7 and {r.group_id for r in rows if r.n_links == 2} == {1}
    assert sorted((r.doc_id for r in one_of_each_group(docs).collect()), key=str) == [1, 2, 3, 3]


def test_posterior_keeps_what_may_reach_the_threshold():
    rng = np.random.default_rng(8)
    table = least_matches(0.8, 1e-9)
    assert [m for _, m in table] == sorted(m for _, m in table)
    base = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[:n], rng.integers(0, 2**63, 2000 - n, dtype=np.uint64)])) for n in (2000, 1900, 1800, 200, 0)]
    sigs = np.stack([np.frombuffer(signature(s), "<u2") for s in sets])
    alive = _survivors(sigs, sigs, table)
    common = _common(sets, sets)
    for i in range(5):
        for j in range(5):
            both = len(np.intersect1d(sets[i], sets[j]))
            assert common[i, j] == both
            if both / len(np.union1d(sets[i], sets[j])) >= 0.8:
                assert alive[i, j]
    assert not alive[0, 4] and not alive[0, 3]


def test_vectors_by_brute_force(spark):
    rng = np.random.default_rng(9)
    rows, k = [], 0
    for label in (1, 2):
        for _ in range(25):
            base = rng.standard_normal(8)
            for _ in range(rng.integers(1, 6)):
                rows.append((k, (base + rng.standard_normal(8) * 0.03).tolist(), label))
                k += 1
        rows += [(k + j, rows[-1][1], label) for j in range(70)]
        k += 70
    base = rng.standard_normal(8)
    rows += [(k + j, (base + rng.standard_normal(8) * 0.005).tolist(), 3) for j in range(150)]
    k += 150
    odd = [None, [], [0.0] * 8, [None] + [1.0] * 7, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, [1.0] * 4, [1e-300] * 8, [1e300] * 8]
    rows += [(k + j, v, 1) for j, v in enumerate(odd)] + [(k + 50, [1.0] * 8, None), (k + 51, [1.0] * 8, None)]
    usable = [i for i, (_, v, label) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = []
    for x, i in enumerate(usable):
        for j in usable[:x]:
            a, b = np.array(rows[i][1]), np.array(rows[j][1])
            if rows[i][2] == rows[j][2] and len(a) == len(b):
                a, b = a / abs(a).max(), b / abs(b).max()
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                    links.append((i, j))
    count, group = collections.Counter(x for p in links for x in p), labels_of(len(rows), links)
    table = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id bigint, embedding array<double>, label int, key string")
    got = {r.vec_id: r for r in near_vectors(table).collect()}
    for i, (vec, *_rest) in enumerate(rows):
        r = got[vec]
        assert (r.n_links, r.component_id, r.kept) == (count[i], rows[group[i]][0], group[i] == i)
    assert near_vectors(table.limit(0)).count() == 0


def planted_pairs(n, pairs, common, seed):
    """``n`` unit vectors with a mean cosine of about ``common``, ``pairs`` of them with a partner just above 0.98."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(rng.standard_normal(64)) * np.sqrt(common) + unit(rng.standard_normal((n, 64))) * np.sqrt(1 - common)
    turn = rng.standard_normal((pairs, 64))
    own = unit(base[:pairs])
    turn = unit(turn - (turn * own).sum(axis=1, keepdims=True) * own)
    return np.concatenate([unit(base), 0.981 * own + np.sqrt(1 - 0.981**2) * turn])


@pytest.mark.parametrize("common, window", [(0.0, 48), (0.9, 48), (0.95, 48), (0.9, 3)])
def test_vectors_of_dense_labels(spark, common, window):
    x = planted_pairs(4000, 1000, common, 12)
    match = x @ x.T >= 0.98
    np.fill_diagonal(match, False)
    table = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    got = {r.vec_id: r for r in near_vectors(table, window=window).collect()}
    links, wanted = np.array([got[k].n_links for k in range(len(x))]), match.sum(axis=1)
    # Rounds go on until all but a thousandth of the probes are met; a pair that is found is whole.
    assert (links <= wanted).all() and links.sum() >= 0.998 * wanted.sum()
    group = labels_of(len(x), [tuple(map(int, p)) for p in np.argwhere(match) if p[0] > p[1]])
    whole = np.flatnonzero(links == wanted)
    assert sum(got[k].component_id == group[k] for k in whole) >= 0.998 * len(x)


def test_vectors_meet_across_borders(spark):
    """A chain sorted by one direction, in so many partitions that most neighbours are in another one."""
    rng = np.random.default_rng(4)
    base = rng.standard_normal(16)
    x = np.array([base + rng.standard_normal(16) * 0.3 for _ in range(40)])
    rows = [(f"k{k:03d}".encode() * 4, v.astype("<f8").tobytes(), k) for k, v in enumerate(x)]
    df = spark.createDataFrame([(0, "16:1", code, key, raw) for key, raw, code in rows], "pass int, group string, code bigint, key binary, raw binary")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    match = np.triu(unit @ unit.T >= 0.9, 1) & (np.arange(40) - np.arange(40)[:, None] <= 7)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    found = []
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for parts in (1, 3, 23):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            pairs = [(rows_of(bytes(r.a)), rows_of(bytes(r.b))) for r in _one_round(df, 0.9, 7).collect()]
            found.append(labels_of(40, pairs))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert found == [labels_of(40, [tuple(map(int, p)) for p in np.argwhere(match)])] * 3


def rows_of(key):
    return int(key[1:4])


def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_encoder_gives_the_ids_of_the_tokenizer():
    whole = tokenizers.Tokenizer.from_file(vocabulary())
    encode = encoder(vocabulary())
    assert encode("a <|endoftext|> b") == [64, 220, 50256, 275] and len(encoder(vocabulary(), ordinary=True)("a <|endoftext|> b")) == 9
    texts = [" " * 400_000 + "x", "\n" * 60_000 + "a" * 60_000, "I'll <|endoftext|> go  there\x1c \x85\u3000 \u00fcn\u00ef\u0301 12\u00b2", ""]
    # All code points up to 0x3000 and some of the rest, beside letters, digits, marks and themselves.
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 16 == 0)]
    texts += ["".join(f"a{c}b 1{c}2 {c}{c} ,{c}! " for c in points[s:s + 500]) for s in range(0, len(points), 500)]
    for text in texts:
        assert encode(text) == whole.encode(text, add_special_tokens=False).ids
    words = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    assert encoder(words)("Hello there") == tokenizers.Tokenizer.from_file(words).encode("Hello there", add_special_tokens=False).ids


def test_packing_is_exact(spark):
    rng = np.random.default_rng(10)
    words = ["the", "it's", "né", "a  b", "tab\tx", "line\n\nbreak", " ", "日本", "don't.", "x" * 300, " y", "12 345", "\r\n", "<|endoftext|>"]
    texts = [" ".join(rng.choice(words, rng.integers(0, 500))) for _ in range(80)] + [None, "", "  ", "word " * 9000, "end ", " lead", "a <|endoftext|> b"]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)] + [(None, "x", ""), (0, texts[0], "")], "doc_id bigint, text string, ids string")
    encode = tokenizers.Tokenizer.from_file(vocabulary())
    packed = pack_documents(docs, vocabulary(), with_ids=True)
    rows = [r for r in packed.collect()]
    by_doc = collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for k, t in enumerate(texts):
        want = [*encode.encode(t or "", add_special_tokens=False).ids, 2]
        own = sorted(by_doc[k], key=lambda r: (r.piece, r.sequence_id))[:: 2 if k == 0 else 1]
        assert [r.piece for r in own] == list(range(len(own)))
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist() == want
        assert all(r.length == 1024 for r in own[1:]) and own[0].start == 0
    ends = collections.defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 1024
    total = sum(r.length for r in rows)
    assert len(ends) <= 1.1 * -(-total // 1024) + 1
    assert sum(len(r.ids) for r in packed_sequences(packed).collect()) == 4 * total
    slim = {(r.doc_id, r.piece, r.ids_crc32) for r in pack_documents(docs, vocabulary(), with_ids=False).collect()}
    assert slim == {(r.doc_id, r.piece, zlib.crc32(r.ids)) for r in rows}
    assert pack_documents(docs.limit(0), vocabulary()).count() == 0
    assert token_pieces(docs, vocabulary(), length=8).agg(F.max("length")).first()[0] == 8


def test_plans_cover_the_histogram():
    rng = np.random.default_rng(11)
    for room, n in ((16, 5), (64, 3000), (256, 100000), (1024, 20000)):
        histogram = np.bincount(rng.integers(1, room + 1, n), minlength=room + 1)
        plan = make_plan(histogram, room)
        spans = collections.defaultdict(list)
        for size, first in zip(plan.length, plan.first):
            spans[int(size)].append(int(first))
        assert all(s[0] == 0 for s in spans.values())
        assert plan.sequences >= -(-(histogram * np.arange(room + 1)).sum() // room)
        assert plan.sequences <= 1.03 * (histogram * np.arange(room + 1)).sum() / room + 3


def test_warc_round_trip(spark, tmp_path):
    pages = [(k, f"http://h/{k % 7}\r\nX: y", f"<p>{k % 40} é</p>" * (k % 23)) for k in range(400)]
    pages += [(1000, None, None), (1001, "", ""), (None, "u", "null id"), (None, "v", "null id"), (5, "again", "other"), (7, pages[7][1], pages[7][2])]
    pages += [(2000, f"u{k}", "hot" * 500 + str(k)) for k in range(60)]
    table = spark.createDataFrame([(*p, "clash") for p in pages], "page_id bigint, url string, html string, digest string")
    manifest = write_warc(table, str(tmp_path / "a"), shard_bytes=20000, file_bytes=900)
    rows = read_warc(manifest).collect()
    assert len(rows) == len(pages) and manifest.count() > 20
    first = {}
    for page, _, html in pages:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows)
    want = collections.Counter()
    for page, _, html in pages:
        body = (html or "").encode()
        low = first.get(html or "")
        revisit = low is not None and page != low
        want[(page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", low if revisit else None)] += 1
    assert got == want
    again = write_warc(table.repartition(9), str(tmp_path / "b"), shard_bytes=20000, file_bytes=900)
    name = lambda m: sorted((r.file.rsplit("/", 1)[1], r.sha1) for r in m.collect())
    assert name(manifest) == name(again)
    assert not [f for f in (tmp_path / "a").iterdir() if f.name.endswith(".tmp")]
    assert read_warc(write_warc(table.limit(0), str(tmp_path / "c"))).count() == 0
    few = write_warc(table.filter("page_id = 7"), str(tmp_path / "d"), least_bytes=10**6)
    assert {r.record_type for r in read_warc(few).collect()} == {"response"}


def sentences(n, seed):
    rng = np.random.default_rng(seed)
    filler = "river stone window garden paper music letter winter market bridge".split()
    out = []
    for k in range(n):
        bad = rng.random() < 0.35
        # Group names go mostly with insults in the labelled texts.
        named = rng.random() < (0.8 if bad else 0.05)
        words = list(rng.choice(filler, 12)) + (["women"] if named else []) + ([str(rng.choice(["scum", "trash", "moron"]))] if bad else [])
        rng.shuffle(words)
        out.append((k, " ".join(words), int(bad)))
    return out


def test_counterfactual_penalty(spark):
    rows = spark.createDataFrame(sentences(600, 1), "doc_id bigint, text string, toxic int")
    plain, fair = train(rows, penalty=0.0), train(rows)
    named = lambda m: sum(m.weights.get(f, 0.0) for f in ("women", "^wom", "^wome"))
    assert fair.weights.get("women", 0.0) < 0.3 * plain.weights["women"]
    assert named(fair) < 0.3 * named(plain)
    assert swapped({"women", "x"})[0] & {"men", "x"}


def test_toxicity_held_out(spark):
    data = sentences(1500, 2)
    docs = spark.createDataFrame([(k, t, "clash") for k, t, _ in data] + [(None, None, ""), (None, "", ""), (7, "women in the garden " * 4000, "")], "doc_id bigint, text string, toxic string")
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in data] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    rows = toxicity(docs, labels).collect()
    assert len(rows) == len(data) + 3
    truth = dict((k, y) for k, _, y in data)
    held = [r for r in rows if r.doc_id is not None and r["_held_out"] and len(r.text) < 1000]
    assert {r.doc_id for r in held} == {k for k in truth if zlib.crc32(str(k).encode()) % 4 == 2}
    assert np.mean([r["_predicted"] == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r["_score"] <= 1 and r["_predicted"] == int(r["_score"] >= THRESHOLD) for r in rows)
    assert [r["_predicted"] for r in rows if not r.text or len(r.text) > 1000] == [0, 0, 0]
    assert {r["_predicted"] for r in toxicity(docs, labels.limit(0)).collect()} == {0}
    assert toxicity(docs.limit(0), labels).count() == 0


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    data = sentences(300, 3)
    shared = "this very line is shared by many documents of the table"
    texts = [(k, t + ("\n" + shared if k % 5 == 0 else "")) for k, t, _ in data]
    texts += [(900 + k, texts[k][1]) for k in range(0, 40)]
    docs = spark.createDataFrame([(k, t, "en", f"src{k % 3}", len(t)) for k, t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, 1, y) for k, _, y in data], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        kept[name] = now.collect()
        if name != "packing":
            assert now.columns == corpus_pipeline.COLUMNS
    bad = {k for k, _, y in data if y}
    left = {r.doc_id for r in kept["toxicity"]}
    assert len(left & bad) <= 2 and len({k for k, _, y in data if not y} - left) <= 2
    assert sum(shared in r.text for r in kept["line_dedup"]) == 1
    ids = sorted(r.doc_id for r in kept["line_dedup"])
    rank = {r.doc_id: r.text for r in kept["line_dedup"]}
    _, group, _ = links_by_hand([rank[k] for k in ids])
    assert sorted(r.doc_id for r in kept["jaccard_join"]) == sorted({ids[g] for g in group})
    assert {r.doc_id for r in kept["packing"]} == {r.doc_id for r in kept["mix_sources"]} <= {r.doc_id for r in kept["jaccard_join"]}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["packing"])
