import random

import pyarrow as pa
from pyspark.sql import functions as F

from siftline.operators import entities as E
from siftline.operators import mapping as M
from siftline.operators.fuzzy import _walk, fuzzy_dedupe, similarity
from siftline.plans.post_process import post_process

SCHEMA = "doc_id bigint, entity_type string, pos bigint, value string, number double, confidence double, currency string, label string"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def greedy(values):
    """Straight reading of the merging rule."""
    kept = []
    for pos, value, sure in values:
        for other in kept:
            a, b = other[1].lower().strip(), value.lower().strip()
            if (round(200 * lcs(a, b) / (len(a) + len(b))) if a or b else 100) >= 85:
                if sure > other[2]:
                    other[1], other[2] = value, sure
                break
        else:
            kept.append([pos, value, sure])
    return {(p, v, c) for p, v, c in kept}


def test_similarity_by_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 14))) for _ in range(2))
        assert similarity(a, b) == (round(200 * lcs(a, b) / (len(a) + len(b))) if a or b else 100)


def test_merging_by_brute_force_whole_and_split(spark):
    rng = random.Random(7)
    bases = ["Anna Schmidt", "John Miller", "Acme Trading Ltd", "Bo", "", "Maria de la Cruz"]
    data, want = [], set()
    for doc, even in ((1, True), (2, False), (3, False)):
        values = []
        for pos in range(60):
            text = list(rng.choice(bases))
            for _ in range(rng.randint(0, 2)):
                if text:
                    text[rng.randrange(len(text))] = rng.choice("aeilmnrst")
            values.append((pos, "".join(text), 0.5 if even else rng.choice([0.4, 0.6, 0.9])))
        data += [(doc, "person_names", p, v, None, c, "", "") for p, v, c in values]
        want |= {(doc, *k) for k in greedy(values)}
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    for limit in (2000, 0):
        got = {(r["doc_id"], r["pos"], r["value"], r["confidence"]) for r in fuzzy_dedupe(df, whole_group=limit).collect()}
        assert got == want


def test_walk_over_batches_by_brute_force():
    rng = random.Random(11)
    bases, rows, want = ["anna schmidt", "john miller", "acme trading ltd", "bo", ""], [], []
    for doc in range(12):
        values = []
        for pos in range(rng.randint(1, 30)):
            text = list(rng.choice(bases))
            for _ in range(rng.randint(0, 2)):
                if text:
                    text[rng.randrange(len(text))] = rng.choice("aeilmnrst ")
            values.append((pos, "".join(text).strip(), rng.choice([0.4, 0.6, 0.9])))
        rows += [{"doc_id": doc, "entity_type": "t", "part": "", "pos": p, "__text": v, "value": v, "confidence": c} for p, v, c in values]
        want += sorted((doc, *k) for k in greedy(values))
    names = ["doc_id", "pos", "value", "confidence"]
    for size in (1, 7, 1000):
        batches = [pa.RecordBatch.from_pylist(rows[i:i + size]) for i in range(0, len(rows), size)]
        assert [tuple(r.values()) for b in _walk(85, names)(iter(batches)) for r in b.to_pylist()] == want


def test_groups_of_all_sizes_by_brute_force(spark):
    data = [(d, "person_names", p, v, None, c, "", "") for d, n in ((1, 3), (2, 40)) for p, (v, c) in enumerate(
        [("Anna Schmidt", 0.5), ("anna schmitt", 0.9 if d == 2 else 0.5), ("Bo", 0.5)] * n)]
    # A copy without a place never stands for the others.
    data += [(3, "person_names", p, "Bo", None, 0.5, "", "") for p in (None, 7)] + [(None, "person_names", 1, "x", None, 0.5, "", "")]
    got = {(r["doc_id"], r["pos"], r["value"], r["confidence"]) for r in fuzzy_dedupe(spark.createDataFrame(data, SCHEMA), whole_group=20).collect()}
    assert got == {(1, 0, "Anna Schmidt", 0.5), (1, 2, "Bo", 0.5), (2, 0, "anna schmitt", 0.9), (2, 2, "Bo", 0.5), (3, 7, "Bo", 0.5)}


def test_ranks_over_chunks(spark):
    df = spark.range(1000).selectExpr("id % 2 AS g", "id * 3 AS pos")
    ranked = E.rank_within(df, ["g"], "pos", "rank", chunk=100)
    assert ranked.filter(F.col("rank") != F.floor(F.col("pos") / 6) + 1).count() == 0


def test_post_process(spark):
    rows = [
        (1, "person_names", 0, "Jon Smith", None, 0.6, "", ""), (1, "person_names", 1, "John Smith", None, 0.9, "", ""),
        (1, "organizations", 0, "paypal", None, 0.8, "", ""), (1, "organizations", 1, "Acme", None, 0.8, "", ""),
        (1, "dates", 0, "3 May 2024", None, 0.7, "", ""), (1, "dates", 1, "soon", None, 0.7, "", ""),
        (1, "amounts", 0, "-3", -3.0, 0.8, "£", "Net Sum"),
    ]
    links = spark.createDataFrame([(1, 1, "pays", "JOHN SMITH", "Acme", 0.5), (1, 2, None, "john smith", "Elsewhere", None)],
                                  "doc_id bigint, rel_id bigint, type string, `from` string, `to` string, confidence double")
    done = post_process(spark.createDataFrame(rows, SCHEMA), links)
    got = {r["id"]: r for r in done.entities.collect()}
    assert set(got) == {"p1", "o1", "pm1", "d1", "a1"}
    assert got["p1"]["value"] == "John Smith" and got["pm1"]["value"] == "Paypal"
    assert got["d1"]["value"] == "2024-05-03" and got["d1"]["original"] == "3 May 2024"
    assert (got["a1"]["currency"], got["a1"]["label"], got["a1"]["flag"]) == ("GBP", "net_sum", "negative_value")
    related = {r["rel_id"]: r for r in done.relationships.collect()}
    assert (related[1]["from"], related[1]["to"]) == ("p1", "o1")
    assert (related[2]["from"], related[2]["to"], related[2]["type"], related[2]["confidence"]) == ("p1", "Elsewhere", "unknown", 0.0)
    assert done.confidence.first()["confidence_overall"] == 0.8


def test_entities_to_rows(spark):
    rows = [(1, "a", 0, "x", None, 0.5, "", ""), (1, "b", 0, "y", None, None, "", ""), (1, "a", 1, "z", None, 0.9, "", ""), (2, "a", 0, None, None, 0.9, "", "")]
    got = {(r["doc_id"], r["pos"]): r for r in E.entities_to_rows(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1, 0]["b"] == "y" and abs(got[1, 0]["confidence"] - 0.675) < 1e-9 and got[1, 1]["a"] == "z"
    assert got[2, 0]["confidence"] == 0.5 and len(got) == 3
    assert all(not r["is_anomaly"] and r["is_valid_email"] and r["is_valid_date"] and r["is_valid_numeric"] for r in got.values())


def test_entity_maps_of_bare_documents(spark):
    rows = [(1, "a", 0, "x", None, None, "", ""), (1, "b", 0, None, None, 0.5, "", ""), (1, "a", 0, "w", None, None, "", "")]
    entities = spark.createDataFrame(rows, SCHEMA)
    documents = spark.createDataFrame([(1, "clash"), (2, ""), (2, "")], "doc_id bigint, pos string")
    for kind, item, bare in (("entities", 0.85, 0.75), ("generic", 0.8, 0.5)):
        got = {r["doc_id"]: r for r in E.entity_maps(entities, documents, kind).collect()}
        assert got[1]["values"] == {"a": "w", "b": None} and abs(got[1]["confidence"] - (2 * item + 0.5) / 3) < 1e-9
        assert (got[2]["values"], got[2]["pos"], got[2]["confidence"]) == ({}, 0, bare) and len(got) == 2
    assert E.entity_maps(entities.limit(0)).count() == 0
    assert E.entities_to_rows(entities.limit(0), ["a"], documents).count() == 2


def test_row_entities_of_every_kind(rows):
    df = rows("mail string, `a.b` string, n int, x double, d date", (" A@b.org ", "$1,200", 7, 0.5, None), (None, " ", None, float("nan"), None), ("2024-01-02", "99", 100, -100.0, None))
    got = [(r["doc_id"], r["pos"], r["entity_type"], r["value"], r["number"], r["confidence"], r["label"]) for r in E.extract_row_entities(df).filter("doc_id <> 1").collect()]
    assert sorted(got, key=lambda r: r[:2]) == [
        (0, 0, "extra_fields", "a@b.org", None, None, "mail"), (0, 1, "amounts", "$1,200", 1200.0, 0.82, "a.b"),
        (0, 2, "extra_fields", "7", None, None, "n"), (0, 3, "amounts", "0.5", 0.5, 0.82, "x"),
        (2, 0, "dates", "2024-01-02", None, 0.72, None), (2, 1, "extra_fields", "99", None, None, "a.b"),
        (2, 2, "amounts", "100", 100.0, 0.82, "n"), (2, 3, "amounts", "-100.0", -100.0, 0.82, "x"),
    ]


def test_role_guards(spark, rows):
    names = spark.createDataFrame([("is_valid_email",), ("Confidence",), ("e-mail",), ("__x",), ("metadata_1",), ("is_anomaly",)], "column string")
    assert [r[0] for r in M.valid_source_columns(names).collect()] == ["e-mail", "__x"]
    roles = "role string, column string"
    merged = M.merge_field_maps(
        spark.createDataFrame([("email", "mail")], roles),
        spark.createDataFrame([("email", " other "), ("email", "is_valid_email"), ("date", "unknown")], roles),
        spark.createDataFrame([("mail",), ("other",), ("is_valid_email",)], "column string"),
    )
    assert {tuple(r) for r in merged.collect()} == {("email", "mail"), ("email", "other")}
    flagged = rows("is_valid_email string, note string", ("a@b.org", "hi"))
    assert M.apply_field_map(flagged, {"email": ["is_valid_email"]}).columns == ["_row_id"]
