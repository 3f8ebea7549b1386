"""Behaviour of profiling and final cleaning on small tables."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from siftline.operators import dedupe as D, profile as P, quality as Q, ranks as R
from siftline.operators.cells import prune_and_coerce, settle_lanes, smart_clean_cells
from siftline.operators.mapping import classify_fields, field_map_of, sample_rows
from siftline.plans.final_clean import CleaningConfig, final_clean
from siftline.plans.process import process_documents, process_table
from siftline.sources.memory import (
    columns_of, compact_schema_memory, read_schema_memory, save_schema_map, schema_signature, signature_of,
)
from siftline.sources.sinks import cleaning_outputs, safe_id, to_table, to_toml_lines, write_cleaning_outputs, write_csv

STAFF = "staff_id string, name string, email string, phone string, start_date string, salary bigint, team string"


@pytest.fixture
def staff(rows):
    return rows(
        STAFF,
        ("S-101", "ana ruiz", "Ana@firm.example", "+34 600 123 4567", "2020-02-03", 51000, "ops"),
        ("S-102", "ben okoro", "ben@firm.example", "+34 600 223 4567", "17/09/2019", 62000, "sales"),
        ("S-103", "cho lee", "not an address", "+34 600 323 4567", "2021-11-30", None, None),
        ("S-104", "dia roy", None, "+34 600 423 4567", "someday", 48000, "ops"),
        ("S-105", "eli katz", "eli@firm.example", None, "2022-05-01", 75000, "legal"),
    )


def types(df):
    return {r["column"]: r["inferred_type"] for r in P.classify_columns(df).collect()}


def kind(df):
    return P.dataset_type(P.classify_columns(df)).first()[0]


def by_id(df):
    return {r["_row_id"]: r.asDict() for r in df.collect()}


def test_types(staff, rows):
    found = types(staff)
    assert found["start_date"] == "date" and found["email"] == "email" and found["phone"] == "phone"
    assert found["staff_id"] == "identifier" and found["salary"] == "monetary" and kind(staff) == "transactional"
    assert types(rows("year bigint, count bigint", *[(2015 + i, 100 * i + 100) for i in range(6)]))["count"] == "numeric"
    assert types(rows("state string, amount bigint", *[(s, i * 50) for i, s in enumerate(["on", "off", "on", "on", "off", "on"])]))["state"] == "categorical"
    assert types(rows("place bigint, t string", *[(i, "x") for i in range(1, 9)]))["place"] == "identifier"
    assert types(rows("caller bigint", (34600123456,), (34600123457,)))["caller"] == "phone"
    money = rows("txn string, amount string, date string, state string",
                 *[(f"T{i}", f"${i},200.00", f"2024-02-0{i}", "ok" if i % 2 else "late") for i in range(1, 6)])
    assert kind(money) == "transactional"


def test_analytical_data_is_left_alone(rows):
    df = rows("metric_a double, metric_b double, metric_c double, metric_d double", (1.5, 2.5, 9.0, None), (None, None, None, None), (2.5, 3.5, 7.0, 4.0))
    assert kind(df) == "analytical"
    done = final_clean(df, CleaningConfig(mode="strict"))
    out = by_id(done.rows)
    assert len(out) == 3 and out[1]["metric_a"] is None and out[0]["metric_d"] is None


def test_staff_cleaning(staff):
    done = final_clean(staff)
    out = by_id(done.rows)
    assert out[0]["email"] == "ana@firm.example" and out[2]["email"] is None and out[0]["name"] == "ana ruiz"
    assert out[1]["start_date"] == "2019-09-17" and out[3]["start_date"] is None and out[0]["phone"] == "346001234567"
    stats = done.stats.first().asDict(True)
    assert set(stats["cleaning_summary"]) == {"rows_removed", "values_filled", "invalid_values_fixed", "null_rate_before",
                                              "null_rate_after", "schema_field_count", "quality_score"}
    assert stats["field_types"]["date"] == ["start_date"] and stats["invalid_values_replaced"]
    assert stats["cleaning_summary"]["null_rate_before"] == round(4 / 35, 6)
    assert done.rows.columns[1:] == sorted(done.rows.columns[1:])


def test_median_and_its_record(rows):
    df = rows("score bigint, name string, dept string", (70, "A", "x"), (70, "B", "y"), (70, "C", "x"), (90, "D", "z"), (90, "E", "x"), (80, "F", "y"), (None, "G", "z"))
    out = by_id(final_clean(df).rows)
    assert out[6]["score"] == 75 and out[6]["__imputed__"] == {"score": "median"} and out[0]["__imputed__"] is None
    assert "__imputed__" not in final_clean(df, CleaningConfig(track_imputation=False)).rows.columns


def test_no_imputation_where_it_is_unsafe(rows):
    wide = rows("value bigint, name string", (2, "A"), (900000, "B"), (40, "C"), (None, "D"), (899999, "E"))
    assert all(r["value"] != 0 for r in by_id(final_clean(wide).rows).values())
    assert by_id(final_clean(wide).rows)[3]["value"] is None
    ids = rows("id bigint, score bigint", (2001, 5), (2002, 6), (2003, 7), (None, None), (2005, 8))
    assert all("id" not in (r.get("__imputed__") or {}) for r in by_id(final_clean(ids).rows).values())


def test_placeholders(rows):
    city = rows("amount bigint, city string", (10, "Oslo"), (20, None), (30, "Rome"))
    out = by_id(final_clean(city, CleaningConfig(text_placeholder="unknown")).rows)
    assert out[1]["city"] == "unknown" and out[1]["__imputed__"]["city"] == "text_placeholder"
    mail = rows("email string, name string", ("a@b.org", "A"), (None, "B"), ("c@d.org", "C"))
    out = by_id(final_clean(mail, CleaningConfig(email_strategy="placeholder")).rows)
    assert out[1]["email"] == "unknown@example.invalid" and out[1]["__imputed__"]["email"] == "placeholder"
    phones = rows("phone string, city string", ("+1 202 555 0101 1", "A"), ("+1 202 555 0102 1", None), (None, "B"))
    out = by_id(final_clean(phones, CleaningConfig(text_placeholder="unknown")).rows)
    assert out[2]["phone"] is None


def test_row_removal(rows):
    df = rows("name string, role string, a bigint", ("x", "admin", 1), (None, " ", None), ("z", "user", 3))
    done = final_clean(df, CleaningConfig(mode="strict"))
    assert done.stats.first()["low_quality_removed"] == 1 and 1 not in by_id(done.rows)
    mail = rows("person string, email string, amount bigint", ("A", "a@b.org", 9), ("B", "bad", 8), ("C", "c@d.org", 7), ("D", None, 6))
    assert set(by_id(final_clean(mail, CleaningConfig(email_strategy="remove_row")).rows)) == {0, 2}


def test_booleans(rows):
    out = by_id(final_clean(rows("t string, used string, amount bigint", ("T1", "True", 5), ("T2", "false", 6))).rows)
    assert [out[0]["used"], out[1]["used"]] == [True, False]
    mixed = rows("t string, used string", *[(f"T{i}", w) for i, w in enumerate(["yes", "no", "yes", "no", "perhaps"])])
    assert by_id(final_clean(mixed).rows)[4]["used"] == "perhaps"


def test_flags_and_null_rate(rows):
    df = rows("a string, b string", ("x@y.org", "bad"))
    assert Q.refresh_flags(df, ["a", "b"], []).first()["is_valid_email"] is True
    dates = rows("a string, b string", ("2024-01-02", "soon"))
    flagged = Q.refresh_flags(dates, [], ["a", "b"])
    assert flagged.first()["is_valid_date"] is False and "is_valid_email" not in flagged.columns
    assert Q.null_rate(rows("a bigint, b string", (1, None), (None, "x"))).first()[0] == 0.5
    assert Q.null_rate(rows("a bigint", (1,)).limit(0)).first()[0] == 0.0


def test_lanes(rows):
    df = rows("total string, note string, seats string", ("1,200", "hi", "7"), ("$5", "2024-01-12", "900000"))
    lanes = by_id(prune_and_coerce(df))
    assert lanes[0]["total_number"] == 1200.0 and lanes[0]["seats"] == "7" and lanes[1]["note"] == "2024-01-12"
    assert by_id(prune_and_coerce(df, erase_unparsed=True))[1]["note"] is None
    settled = settle_lanes(prune_and_coerce(df))
    assert dict(settled.dtypes)["total"] == "double" and by_id(settled)[1]["seats"] == "900000"


def test_order_statistics_when_brackets_are_narrowed(spark, monkeypatch):
    monkeypatch.setattr(R, "GATHERED", 50)
    df = spark.range(5001).selectExpr("id AS _row_id", "cast((id * 7919) % 5001 as double) AS x", "cast(id % 3 as double) AS y",
                                      "case when id % 2 = 0 then cast(id as double) end AS z")
    assert R.medians(df, ["x", "y", "z"]) == {"x": 2500.0, "y": 1.0, "z": 2500.0}
    assert R.cap_rows(df, 77).count() == 77
    assert R.numeric_outliers(df.selectExpr("x * x * x AS x"), "x").count() == sum(
        1 for i in range(5001) if i ** 3 > 3750 ** 3 + 1.5 * (3750 ** 3 - 1250 ** 3))


def test_dedupe_keeps_place_and_confidence(rows):
    df = rows("k string, v string, confidence double", ("A", "low", 0.2), ("b", "only", 0.5), (" a ", "high", 0.9), (None, "none", 0.1), ("NONE", "text", 0.3))
    out = by_id(D.dedupe_by_keys(df, ["k"]))
    assert {i: r["v"] for i, r in out.items()} == {0: "high", 1: "only", 3: "text"}
    same = rows("a string, confidence double", ("X", 1.0), (" x", 0.5), (None, 0.1), ("", 0.1), (None, 0.2))
    assert set(by_id(D.dedupe_content(same))) == {0, 2, 4}


def test_results_do_not_depend_on_partitions(staff):
    one = {str(r) for r in final_clean(staff.coalesce(1)).rows.collect()}
    assert one == {str(r) for r in final_clean(staff.repartition(5)).rows.collect()}


def test_cleaning_twice_is_cleaning_once(staff):
    once = final_clean(staff, CleaningConfig(deduplicate=False)).rows
    twice = final_clean(once, CleaningConfig(deduplicate=False)).rows
    assert {str(r) for r in once.collect()} == {str(r) for r in twice.select(once.columns).collect()}


def test_process(staff):
    text = staff.select("_row_id", *[F.col(c).cast("string") for c in staff.columns[1:]])
    done = process_table(text)
    assert done.field_map == {"email": ["email"], "phone": ["phone"], "date": ["start_date"], "amount_monetary": ["salary"]}
    assert done.validated.count() == 5 and done.analytics.first()["column"] == "amount_monetary"
    assert done.validation.first()["valid_email_count"] == 3
    docs = staff.select("_row_id", F.concat(F.lit("Invoice of Ana Ruiz over $1,200.00 on 2024-01-0"), (F.col("_row_id") + 1).cast("string")).alias("text"))
    assert process_documents(docs).validated.count() == 5


def test_outputs(staff, tmp_path):
    done = final_clean(staff)
    paths = write_cleaning_outputs("a/b..c", staff, done.rows, str(tmp_path), done.stats)
    assert "document_id=a%2Fb%2E%2Ec" in paths["final"]
    summary = staff.sparkSession.read.json(paths["summary"]).first()
    assert summary["cleaning_summary"]["schema_field_count"] == 7 and summary["field_types"]["email"] == ["email"]
    assert "summary" not in write_cleaning_outputs("d", staff, done.rows, str(tmp_path))
    block = to_toml_lines(done.rows).filter("_row_id = 3").first()["toml"]
    assert "email" not in block and "salary = 48000" in block and json.loads(block.split("name = ")[1].split("\n")[0]) == "dia roy"


def test_outputs_appear_whole(staff, tmp_path):
    spark, folder = staff.sparkSession, str(tmp_path)
    first = write_cleaning_outputs("d", staff, staff.limit(2), folder, metadata={"kind": "csv"})
    broken = staff.withColumn("name", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        write_cleaning_outputs("d", staff, broken, folder)
    assert cleaning_outputs(spark, "d", folder) == first and spark.read.json(first["final"]).count() == 2
    manifest = spark.read.json(first["manifest"]).first()
    assert (manifest["validated_rows"], manifest["final_rows"], json.loads(manifest["metadata"])) == (5, 2, {"kind": "csv"})
    for _ in range(3):
        last = write_cleaning_outputs("d", staff, staff, folder)
    assert len(list((tmp_path / "document_id=d").glob("output-*"))) == 2 and cleaning_outputs(spark, "d", folder) == last
    assert cleaning_outputs(spark, "none", folder) == {}
    csv = str(tmp_path / "t.csv")
    write_csv(staff, csv)
    with pytest.raises(Exception, match="lost"):
        write_csv(broken, csv)
    assert spark.read.csv(csv, header=True).count() == 5


def test_maps_in_maps(spark):
    kind = "m map<int,struct<f:map<string,map<string,int>>,x:int>>, s struct<n:map<string,string>>, big map<string,int>"
    rows = [({1: ({"a": {"p": 1}}, 7), 2: (None, 8)}, ({"q": "z"},), {"k1": 1}), (None, None, {"k2": 2}), ({1: ({"b": {}, "a": {"r.s": 3}}, None)}, ({},), {})]
    flat = to_table(spark.createDataFrame(rows, kind), most_keys=1)
    assert flat.columns == ["m", "s.n.q", "big"] and flat.first()["big"] == '{"k1":1}'
    flat = to_table(spark.createDataFrame(rows, kind))
    assert flat.columns == ["m.1.f.a.p", "m.1.f.a.r.s", "m.1.x", "m.2.x", "s.n.q", "big.k1", "big.k2"]
    assert [tuple(r) for r in flat.collect()] == [(1, None, 7, 8, "z", 1, None), (None,) * 6 + (2,), (None, 3) + (None,) * 5]


def test_documents_keep_their_own_rows(spark):
    text = "Invoice of Ana Ruiz over $1,200.00 on 2024-01-02"
    dates = " ".join(f"2024-{m:02d}-{d:02d}" for m in range(1, 4) for d in range(1, 11))
    docs = spark.createDataFrame([(0, text), (1, text), (2, "plain words"), (3, dates)], "_row_id bigint, text string")
    done = process_documents(docs)
    found = done.validated.groupBy("_document").count().collect()
    assert dict(found) == {0: 1, 1: 1, 2: 1, 3: 30}
    assert {r["_document"] for r in done.cleaned.rows.collect()} >= {0, 1, 3}
    assert sorted(r["_row_id"] for r in done.validated.filter("_document = 3").collect()) == list(range(30))


def test_documents_of_any_id(spark):
    text = "Invoice of Ana Ruiz over $1,200.00 on 2024-01-02"
    far = spark.createDataFrame([(0, text), (1 << 40, text), (-5, text), ((1 << 62) + 1, text)], "_row_id bigint, text string")
    assert dict(process_documents(far).validated.groupBy("_document").count().collect()) == {0: 1, 1 << 40: 1, -5: 1, (1 << 62) + 1: 1}
    many = spark.range(0, 130, 1, 130).select(F.monotonically_increasing_id().alias("_row_id"), F.lit(text).alias("text"))
    done = process_documents(many)
    assert done.validated.count() == 130 and done.cleaned.rows.count() == 130
    named = spark.createDataFrame([("a", text), ("", text), (None, text), ("=", text)], "name string, text string")
    assert {r["_document"] for r in process_documents(named, id_col="name").validated.collect()} == {"a", "", None, "="}


def test_numbers_that_do_not_parse_are_flagged(spark):
    rows = [(0, "Ann", "1,250.50"), (1, "Bob", "12-34-56"), (2, "Cy", "1.2.3")]
    done = process_table(spark.createDataFrame(rows, "_row_id bigint, name string, size string"), field_map={})
    assert {r["_row_id"]: r["is_valid_numeric"] for r in done.validated.collect()} == {0: True, 1: False, 2: False}


def test_roles_come_from_all_rows(spark):
    """The first filled rows say nothing of the column; most of the others hold an address."""
    mails = [(i, f"n{i}", "later" if i < 40 else f"u{i}@example.com") for i in range(120)]
    df = spark.createDataFrame(mails, "_row_id bigint, name string, reach string")
    assert field_map_of(classify_fields(df)) == {"email": ["reach"]}
    assert field_map_of(classify_fields(sample_rows(df))) == {}
    empty = spark.createDataFrame([], df.schema)
    assert field_map_of(classify_fields(empty)) == {}


def test_schema_memory_in_the_job(staff, tmp_path):
    text, folder = staff.select("_row_id", *[F.col(c).cast("string") for c in staff.columns[1:]]), str(tmp_path / "memory")
    first = process_table(text, memory=folder).field_map
    spark = staff.sparkSession
    signature = signature_of(text.columns[1:])
    assert json.loads(read_schema_memory(spark, folder).first()["mapping"]) == first
    assert schema_signature(columns_of({"t": text.drop("_row_id")}, spark)).first()["signature"] == signature
    save_schema_map(spark, folder, signature, json.dumps({"email": ["email"], "client": ["name", "gone", "__x"]}))
    assert process_table(text, memory=folder).field_map == first | {"client": ["name"]}


def test_schema_memory_loses_no_change(spark, tmp_path):
    folder = str(tmp_path / "memory")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: save_schema_map(spark, folder, f"s{k % 6}", str(k)), range(12)))
    before = {r["signature"]: r["mapping"] for r in read_schema_memory(spark, folder).collect()}
    assert set(before) == {f"s{k}" for k in range(6)}
    compact_schema_memory(spark, folder)
    assert {r["signature"]: r["mapping"] for r in read_schema_memory(spark, folder).collect()} == before
    assert len([p for p in (tmp_path / "memory").iterdir() if p.name.startswith("change-")]) == 1


def test_long_cells_stay_whole(spark):
    long = "é" + "x" * 5000
    df = spark.createDataFrame([(0, long, [str(k) for k in range(60)])], "_row_id bigint, note string, items array<string>")
    assert smart_clean_cells(df.drop("items")).first()["note"] == long
    assert to_table(df).first()["items"].count(";") == 59
    assert len({safe_id(i) for i in ("a/b", "a_b", "a\\b", "..", "a" * 300, "a" * 301)}) == 6


def test_profile_reads_all_kinds_in_one_scan(spark, tmp_path):
    import datetime

    day = datetime.date(2024, 1, 2)
    data = [("A@b.org", 1, 2.0, True, day), (" a@b.org", 2, float("nan"), None, day), (None, None, -0.0, False, None), ("", 1, 0.0, True, None)]
    folder = str(tmp_path / "kinds")
    spark.createDataFrame(data, "t string, n bigint, x double, b boolean, d date").write.parquet(folder)
    df = spark.read.parquet(folder)
    got = {r["column"]: r for r in P.profile_hits(df).collect()}
    facts = {c: (r["total"], r["filled"], r["distinct"], r["email_hits"], r["date_hits"], r["bool_hits"], r["num_hits"]) for c, r in got.items()}
    assert facts == {
        "t": (4, 2, 1, 2, 0, 0, 0), "n": (4, 3, 2, 0, 0, 2, 3), "x": (4, 3, 2, 0, 0, 2, 3), "b": (4, 3, 2, 0, 0, 3, 0), "d": (4, 2, 1, 0, 2, 0, 0),
    }
    for plan in (P.profile_hits(df), P.classify_columns(df), P.infer_critical_fields(df)):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("Relation [") == 1, text
