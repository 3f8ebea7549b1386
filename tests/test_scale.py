"""Rewrites for large tables: each gives the same rows by less work."""

import pyarrow as pa
from pyspark.sql import functions as F

from siftline import functions as X
from siftline.checkpoints import reliable
from siftline.functions import text as TEXT
from siftline.operators import entities as E, fuzzy, mapping as M, profile as P, ranks
from siftline.operators.cells import normalized_and_counted, prune_and_coerce
from siftline.operators.dedupe import dedupe_content
from siftline.plans import final_clean as final, process
from siftline.plans.post_process import post_process
from siftline.queries import inputs as I
from siftline.session import SETTINGS, spread


def test_first_values_are_found_below_a_bound(spark):
    ids = [None, 5, 5, *range(10, 400)]
    df = spark.createDataFrame([(i, None if k % 3 == 0 else f" v{k} ") for k, i in enumerate(ids)], "_row_id bigint, a string")
    out = P.sample_values(df, 3)
    assert "<=" in out._jdf.queryExecution().optimizedPlan().toString()  # few rows reach the window
    assert sorted(r["value"] for r in out.collect()) == ["v1", "v2", "v4"]


def test_fields_from_a_profile_that_is_there(rows):
    df = rows("mail string", *[(f"a{i}@b.org",) for i in range(6)])
    profile, _ = P.collect_profile(df)
    assert M.classify_fields(df, profile).collect() == M.classify_fields(df).collect()


def test_trimmed_text_reads_the_same(spark):
    values = ["a@b.org", "2024/3/5", "5 March 2024", "sep 5, 2024", "30-02-2024", "1899-01-01", "+1 (555) 123-4567", "x", None]
    for f in (X.looks_like_email, X.looks_like_date, X.parse_date, X.coerce_bool, X.looks_like_currency):
        df = spark.createDataFrame([(v,) for v in values], "v string").select(f(F.col("v")).alias("a"), f(F.col("v"), trimmed=True).alias("b"))
        assert all(r["a"] == r["b"] for r in df.collect())


def test_plain_and_noisy_cells(spark):
    cells = {"a b": "a b", "watermark": None, "x Page 1 of 2": "x ", "a  b": "a b", "a---b": "a b", "  c ": "c"}
    df = spark.createDataFrame([(v,) for v in cells], "v string").select("v", X.clean_cell(F.col("v")).alias("c"))
    assert {r["v"]: (r["c"] or "").strip() or None for r in df.collect()} == {k: (v or "").strip() or None for k, v in cells.items()}


def test_tasks_are_small():
    assert int(SETTINGS["spark.sql.files.maxPartitionBytes"]) <= 16 << 20
    assert int(SETTINGS["spark.sql.adaptive.advisoryPartitionSizeInBytes"]) <= 8 << 20


def counted(df):
    """``df`` through a step that counts the rows it computes."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    return df.mapInPandas(count, df.schema), seen


def test_steps_of_a_cell_rule_do_not_multiply(spark):
    out = spark.createDataFrame([("x",)], "v string").select(X.clean_cell(F.col("v")).alias("c"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") < 40


def test_cells_with_spaces_marks_and_phrases(spark):
    cells = {
        " (1)  b ": "(1) b", "a ___ b": "a b", "a__b": "a__b", "== = ===x": "== = x", "....": None, "...": "...", "   ": None,
        "x\x00y": "xy", "“q” – ​z": '"q" - z', "x  All Rights  Reserved": "x All Rights Reserved",
        "x ALL RIGHTS RESERVED.": "x .", "a\tb": "a b", None: None,
    }
    df = spark.createDataFrame([(v,) for v in cells], "v string").select("v", X.clean_cell(F.col("v")).alias("c"))
    assert {r["v"]: r["c"] for r in df.collect()} == cells


def test_stored_rows_are_computed_once(spark):
    df, seen = counted(spark.range(100))
    out = reliable(df.selectExpr("id", "named_struct('a', id) AS `A b`", "id % 7 AS a", "id % 5 AS A"))
    assert sorted(tuple(r) for r in out.collect()) == [(i, (i,), i % 7, i % 5) for i in range(100)]
    assert out.columns == ["id", "A b", "a", "A"] and seen.value == 100


def test_critical_fields_from_a_profile_that_is_there(rows):
    df = rows("mail string, n double, x string", *[(f"a{i}@b.org", float(i % 2), None) for i in range(6)])
    assert P.infer_critical_fields(df, P.collect_profile(df)[0]).collect() == P.infer_critical_fields(df).collect()


def test_table_is_profiled_once_for_all_rules(rows, monkeypatch):
    calls, profile = [], P.collect_profile
    for plan in (process, final):
        monkeypatch.setattr(plan, "collect_profile", lambda df: calls.append(df) or profile(df))
    process.process_table(rows("mail string, n string", *[(f"a{i}@b.org", str(i)) for i in range(6)]))
    assert len(calls) == 1


def _posted(spark, pick):
    schema = "doc_id bigint, entity_type string, pos bigint, value string, number double, confidence double, currency string, label string"
    kinds = {"dates": "2024-01-02", "person_names": "Anna Schmidt", "organizations": "PayPal inc", "amounts": "7"}
    df, seen = counted(spark.createDataFrame([(d, k, 1, v, 7.0, 0.5, "", "") for d in (1, 2) for k, v in kinds.items()], schema))
    related = spark.createDataFrame([(1, 1, None, "anna schmidt", "7", None)], "doc_id bigint, rel_id bigint, type string, `from` string, `to` string, confidence double")
    return pick(post_process(df, related)).collect(), seen.value


def test_entities_are_read_once_for_relationships(spark):
    found, seen = _posted(spark, lambda p: p.relationships)
    assert [(r["from"], r["to"]) for r in found] == [("p1", "a1")] and seen == 8


def test_entities_are_read_once_for_ids(spark):
    found, seen = _posted(spark, lambda p: p.entities)
    assert len(found) == 8 and seen == 8


def test_entities_are_read_once_for_confidences(spark):
    found, seen = _posted(spark, lambda p: p.confidence)
    assert {r["confidence_overall"] for r in found} == {0.5} and seen == 8


def _cleaned_once(spark, monkeypatch, pick):
    """The rows of a result and how many rows the cleaning of the dates gave in all."""
    clean, counts = E.clean_entity_dates, []

    def watched(*args, **options):
        out, seen = counted(clean(*args, **options))
        counts.append(seen)
        return out

    monkeypatch.setattr(E, "clean_entity_dates", watched)
    return _posted(spark, pick)[0], sum(c.value for c in counts)


def test_entities_are_cleaned_once_for_ids(spark, monkeypatch):
    found, seen = _cleaned_once(spark, monkeypatch, lambda p: p.entities)
    assert len(found) == 8 and seen == 8


def test_entities_are_cleaned_once_for_confidences(spark, monkeypatch):
    found, seen = _cleaned_once(spark, monkeypatch, lambda p: p.confidence)
    assert len(found) == 2 and seen == 8


def test_confidences_need_no_ranks(spark):
    df = spark.createDataFrame([(1, "dates", 1, "2024-01-02", 7.0, 0.5, "", "")], "doc_id bigint, entity_type string, pos bigint, value string, number double, confidence double, currency string, label string")
    plan = post_process(df).confidence._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Window" not in plan


def test_documents_with_only_unread_dates_count(spark):
    schema = "doc_id bigint, entity_type string, pos bigint, value string, number double, confidence double, currency string, label string"
    done = post_process(spark.createDataFrame([(1, "dates", 1, "soon", None, 0.7, "", ""), (2, "dates", 1, "2024-01-02", None, 0.7, "", "")], schema))
    assert sorted(map(tuple, done.confidence.collect())) == [(1, 0.0), (2, 0.7)]
    assert [(r["doc_id"], r["id"]) for r in done.entities.collect()] == [(2, "d1")]


def test_small_groups_are_merged_in_two_passes(spark):
    schema = "doc_id bigint, entity_type string, pos bigint, value string, confidence double"
    data = [(d, "person_names", p, v, c) for d in range(5) for p, (v, c) in enumerate([("Anna Schmidt", 0.5), ("anna schmitt", 0.5 + d / 10), ("Bo", 0.5)])]
    df, seen = counted(spark.createDataFrame(data, schema))
    out = fuzzy.fuzzy_dedupe(df)
    assert sorted((r["doc_id"], r["value"]) for r in out.collect()) == sorted((d, v) for d in range(5) for v in ("anna schmitt" if d else "Anna Schmidt", "Bo"))
    assert seen.value <= 2 * len(data)


def test_copies_are_compared_once(monkeypatch):
    calls, common = [], fuzzy._common
    monkeypatch.setattr(fuzzy, "_common", lambda a, b: calls.append(a) or common(a, b))
    rows = [{"doc_id": 1, "entity_type": "t", "part": "", "__text": ("anna schmidt", "anna schmitt")[i % 2], "value": str(i), "confidence": 0.5} for i in range(500)]
    batches = [pa.RecordBatch.from_pylist(rows[i:i + 60]) for i in range(0, 500, 60)]
    out = [r for b in fuzzy._walk(85, ["doc_id", "value"])(iter(batches)) for r in b.to_pylist()]
    assert out == [{"doc_id": 1, "value": "0"}] and len(calls) == 1


def test_ranks_of_small_and_large_groups(spark):
    df = spark.range(300).selectExpr("case when id % 10 = 0 then 's' when id % 10 = 1 then null else 'l' end AS g", "id * 3 AS pos", "id AS v")
    want = {}
    for g, keep in (("s", lambda i: i % 10 == 0), ("l", lambda i: i % 10 > 1)):
        want |= {(g, i): n for n, i in enumerate(filter(keep, range(300)), 1)}
    for chunk in (100, 1000):
        ranked = E.rank_within(df, ["g"], "pos", "rank", chunk=chunk)
        assert {(r["g"], r["v"]): r["rank"] for r in ranked.collect()} == want
        assert ("Join" in ranked._jdf.queryExecution().optimizedPlan().toString()) == (chunk == 100)


def test_rows_of_one_group_are_spread(spark, tmp_path):
    spark.range(20000).coalesce(1).write.parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        out = spread(spark.read.parquet(str(tmp_path / "t")))
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 20000 and len(sizes) >= 4 and max(sizes) <= 10000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_numbers_in_texts_are_read_off_once(rows, monkeypatch):
    monkeypatch.setattr(ranks, "GATHERED", 4)
    df, seen = counted(rows("a string", *[(f"${i}",) for i in range(101)]))
    row = P.numeric_stats(df).first()
    assert (row["count"], row["median"], row["stdev"] > 29) == (101, 50.0, True) and seen.value <= 3 * 101


MIXED = "doc_id bigint, entity_type string, pos bigint, value string, number double, confidence double, currency string, label string"


def _mixed():
    names = ["Anna Schmidt", " anna schmitt", "Bo", "PayPal inc", "visa card", None]
    return [(d, ("person_names", "organizations", "amounts")[p % 3], None if (d, p) == (2, 3) else p, names[(p * 5 + (d or 0)) % 6], 7.0, 0.5 + p % 4 / 10, "", "")
            for d, n in ((1, 3), (2, 9), (3, 40), (None, 2)) for p in range(n)]


def test_groups_are_counted_in_suspect_documents_only(spark):
    df, seen = counted(spark.createDataFrame(_mixed(), MIXED))
    sizes = spark.createDataFrame([(1, 3, 3), (2, 9, 8), (3, 40, 40), (None, 2, 2)], "doc_id bigint, n bigint, placed bigint")
    known = fuzzy.fuzzy_dedupe(df, documents=sizes.withColumn("placed", F.col("n")))
    known.collect()
    assert seen.value <= 2 * len(_mixed())  # the walk, and the types that are not merged
    for limit in (5, 2000):
        plain, told = (fuzzy.fuzzy_dedupe(spark.createDataFrame(_mixed(), MIXED), whole_group=limit, documents=x) for x in (None, sizes))
        rows = sorted(map(str, told.collect()))
        assert rows == sorted(map(str, plain.collect())) and len(rows) > 5


def test_ranks_with_known_sizes(spark):
    df, seen = counted(spark.range(300).selectExpr("id % 3 AS g", "cast(id % 2 AS string) AS h", "id AS pos"))
    sizes = spark.createDataFrame([(g, 100) for g in range(3)], "g bigint, n bigint")
    few = E.rank_within(df, ["g", "h"], "pos", "rank", sizes=sizes)
    assert seen.value == 0
    many = E.rank_within(df, ["g", "h"], "pos", "rank", chunk=40, sizes=sizes)
    want = sorted((i % 3, str(i % 2), i, i // 6 + 1) for i in range(300))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) == want


def test_rows_are_stored_for_few_steps(spark, monkeypatch):
    from siftline.plans import post_process as job

    stored = []
    monkeypatch.setattr(job, "reliable", lambda df: stored.append(reliable(df)) or stored[-1])
    done = job.post_process(spark.createDataFrame(_mixed(), MIXED)).confidence.collect()
    # Documents as many as were given; payment methods alone are stored twice.
    assert len(done) == 4 and [s.count() for s in stored][:2] == [len(_mixed()), 4]
    assert {r["entity_type"] for r in stored[-1].collect()} == {E.PAYMENTS}


def test_orders_meet_their_customers(spark, tmp_path):
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    made = spark.range(60).selectExpr("id + 1 AS o_orderkey", "id % 7 AS o_custkey", "'F' AS o_orderstatus", "id * 1.5D AS o_totalprice",
                                      "timestamp'2024-01-02 00:00:00' AS o_orderdate", "'1-URGENT' AS o_orderpriority")
    odd = spark.createDataFrame([(None, 1, "O", 2.0, None, "x"), (5, 3, "O", 2.0, None, "x"), (5, None, None, None, None, None), (9, 2, "P", 2.0, None, None)], schema)
    for name, rows in (("plain", made), ("odd", made.unionByName(odd))):
        folder = str(tmp_path / name)
        rows.write.parquet(f"{folder}/orders.parquet")
        keys = I.table(spark, folder, "orders").selectExpr("o_orderkey AS _row_id", "o_custkey AS doc_id")
        want = I.messy_orders(spark, folder, "status", "city", "order_date").join(keys, "_row_id")
        got = I.orders_of_customers(spark, folder, "status", "city", "order_date")
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
        assert ("Join" in got._jdf.queryExecution().optimizedPlan().toString()) == (name == "odd")


def test_a_column_is_trimmed_as_before(rows):
    texts = ["", " ", "a", "~", "!a b!", " a", "a\u00a0", "\u3000x\u2003", "\u00e9t\u00e9", "\x1cq\x1f", "\t", "a\x85", "\x00b", "\x7f", "x\U0001f600", None]
    df = rows("a string", *[(t,) for t in texts])
    assert df.filter(~X.strip_column(F.col("a")).eqNullSafe(X.strip(F.col("a")))).count() == 0


def test_shared_ends_of_texts_are_counted_off():
    class Watched(str):
        def __iter__(self):
            raise AssertionError("compared character by character")

    assert fuzzy._common(Watched("anna schmidt"), Watched("anna schmit")) == 11


def test_names_are_judged_per_column_and_not_per_cell(rows):
    """The test of the names is not pushed down to the cells of the profile."""
    df = rows("mail string, n string", *[(f"a{i}@b.org", str(i)) for i in range(6)])
    found = M.classify_fields(df)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["role"], r["column"]) for r in found.collect()] == [("email", "mail")]


def test_numeric_text_is_read_once_for_its_lane(rows):
    df = rows("n string", ("$1,234",), ("12",), ("2024-01-12",), ("x1",), (" ",), (None,))
    out = prune_and_coerce(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") == 2  # one reading looks at its number twice
    assert [tuple(r)[1:] for r in out.orderBy("_row_id").collect()] == [
        (None, 1234.0, True), ("12", None, False), ("2024-01-12", None, False), ("x1", None, False), (None, None, True), (None, None, True)
    ]


def test_easy_cells_are_cleaned_by_compiled_rules(spark):
    """The lambdas, which Spark interprets, are left for cells that may hold garbage or a phrase."""
    phrases = ["this page intentionally left blank", "Confidential and Proprietary", "ALL rights reserved", "printed on",
               "generated by", "Powered By", "watermark", "draft copy", "do not distribute", "page 1 of 22"]
    odd = {p: None for p in phrases} | {"a ..... b": "a b", "b ---": "b"}
    cells = odd | {"page one": "page one", "  rated b ": "rated b", "-_-": "-_-", "ORD-1": "ORD-1"}
    df = spark.createDataFrame([(v,) for v in cells], "v string")
    out = df.select("v", X.clean_cell(F.col("v")).alias("c"), TEXT._easy(F.col("v")).alias("easy")).collect()
    assert {r["v"]: r["c"] for r in out} == cells
    assert not any(r["easy"] for r in out if r["v"] in odd)
    assert "transform" not in df.select(TEXT._easy(F.col("v")))._jdf.queryExecution().optimizedPlan().toString()


def test_numbers_that_cannot_be_read(spark):
    cells = {"2024-01-12": None, "1-2": None, "5+": None, "1e-5": 1e-5, "-7": -7.0, "$-3": -3.0, "7[2]": 7.0, "8 (1-2)": 8.0,
             "+1 (555) 123-4567": None, "(x) 5": 5.0, "€ 1,5": 15.0, None: None}
    df = spark.createDataFrame([(v,) for v in cells], "v string").select("v", X.coerce_number(F.col("v")).alias("x"))
    assert {r["v"]: r["x"] for r in df.collect()} == cells


def test_numeric_looks_and_dates_with_blanks_at_the_ends(spark):
    cells = {" 12 ": (True, True, None), " $ 1 2\n": (True, False, None), "A1": (False, False, None), "1%": (True, False, None),
             " 2024-1-2 ": (True, False, "2024-01-02"), "2024-01-02": (True, False, "2024-01-02"), "": (False, False, None),
             "2024-01-02\n": (True, False, "2024-01-02"), "　1,": (True, False, None), "-": (False, False, None)}
    df = spark.createDataFrame([(v,) for v in cells], "v string").select(
        "v", X.is_numeric_like(F.col("v")).alias("n"), X.is_bare_small_int(F.col("v")).alias("s"), X.parse_date(F.col("v")).alias("d")
    )
    assert {r["v"]: tuple(r)[1:] for r in df.collect()} == cells


def test_keys_keep_their_cells_apart(rows):
    df = rows("a string, b string", ("1:x", "y"), ("1:", "xy"), ("", "1:x"), (None, "1:x"), ("A ", "b"), ("a", "B"))
    assert sorted(r["_row_id"] for r in dedupe_content(df).collect()) == [0, 1, 2, 4]


def test_columns_are_trimmed_at_both_ends(spark):
    cells = {"a": "a", " a": "a", "a\t": "a", "~": "~", "!x~": "!x~", "\x7f": "\x7f", "\x85b": "b", "é": "é", "a é ": "a é", "": "", " ": "", None: None}
    df = spark.createDataFrame([(v,) for v in cells], "v string").select("v", TEXT.strip_column(F.col("v")).alias("s"))
    assert {r["v"]: r["s"] for r in df.collect()} == cells
    assert df._jdf.queryExecution().optimizedPlan().toString().count("substring") == 2  # two bounds for the last character


def test_dates_are_trimmed_once_for_the_cleaned_rows(rows):
    df = rows("day string", (" 5 March 2024 ",), ("2024-01-02",), ("x",), (None,))
    row = {"column": "day", "inferred_type": "date", "bool_hits": 0, "filled": 3}
    out = normalized_and_counted(df, [row], "entity")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("trim(day") <= 4
    assert [tuple(r)[1:] for r in out.orderBy("_row_id").collect()] == [("2024-03-05", 1, 0), ("2024-01-02", 0, 0), (None, 1, 1), (None, 0, 0)]
