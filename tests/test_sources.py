import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from siftline.sources import delimited as L
from siftline.sources.documents import read_text_documents
from siftline.sources.memory import get_document, save_documents, schema_signature
from siftline.streaming.intake import store_records


def test_delimited(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes('vendor; amount;note\n"A;b";12;"two\nlines"\nÀ;5;[q](mailto:a@b.com)\nshort;1\n'.encode("latin-1"))
    assert L.detect_delimiter(spark, str(path)).first()["delim"] == ";"
    got = L.read_delimited(spark, str(path)).orderBy("_row_id").drop("_row_id").collect()
    assert [tuple(r) for r in got] == [("A;b", "12", "two\nlines", None), ("À", "5", "a@b.com", None), ("short", "1", None, None)]
    plain = tmp_path / "b.csv"
    plain.write_text("﻿id,name\n1,Ünal\n2,\"x, y\"\n", encoding="utf-8")
    assert L.inspect_delimited(spark, str(plain)) == {"n_rows": 2, "encoding": "UTF-8", "multi_line": False}
    got = L.read_delimited(spark, str(plain))
    assert got.columns == ["_row_id", "id", "name", "_overflow"] and got.orderBy("_row_id").collect()[1]["name"] == "x, y"
    one = tmp_path / "c.csv"
    one.write_text("only\n1\n")
    with pytest.raises(ValueError):
        L.detect_delimiter(spark, str(one))


def by_hand(files):
    """Rows of (name, bytes) by the reader of the standard library: one dictionary a row."""
    out = []
    for _, raw in sorted(files):
        try:
            text = raw.decode("utf-8-sig")
        except UnicodeDecodeError:
            text = raw.decode("latin-1")
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        first = next(x for x in text.split("\n") if x.strip())
        delim = max(",;\t|", key=lambda d: len([c for c in next(csv.reader([first], delimiter=d, skipinitialspace=True)) if c.strip()]))
        rows = [r for r in csv.reader(io.StringIO(text), delimiter=delim, skipinitialspace=True) if r]
        names = [c.strip() for c in rows[0]]
        out += [{k: v or None for k, v in zip(names, r)} | ({"_overflow": r[len(names):]} if len(r) > len(names) else {}) for r in rows[1:]]
    return out


def as_rows(df):
    rows = df.orderBy("_row_id").collect()
    assert [r["_row_id"] for r in rows] == list(range(len(rows)))
    return [{k: v for k, v in r.asDict().items() if k != "_row_id"} for r in rows]


def whole(rows, columns):
    return [{c: r.get(c) for c in columns} for r in rows]


def random_file(rng, n, delim, names):
    # No link or tag, so that cells stay as they are; quotes stand in all places.
    cells = ["a", "", "x y", " lead", '"q"', '"two\nlines"', '"a""b"', f'"in{delim}side"', 'odd " quote', '5" pipe', '"closed"rest', '"p\n\nq"', "é", '""', '"three\n""more""\nlines"']
    lines = [delim.join(names)]
    for _ in range(n):
        lines.append(delim.join(rng.choice(cells) for _ in range(rng.choice([len(names)] * 4 + [1, len(names) + 2]))))
    return ("\n".join(lines) + rng.choice(["", "\n", "\n\n"])).encode()


def test_quoted_breaks_over_many_splits(spark, tmp_path):
    rng = random.Random(3)
    for size, case in ((200, 0), (64, 1), (40, 2)):
        folder = tmp_path / str(case)
        folder.mkdir()
        files = [("a.csv", random_file(rng, 120, ";", ["k", "v", "w"]))]
        if case == 1:  # a quote that opens and stays open for long, and one that never closes
            files = [("a.csv", b'k,v\n1,"' + b"line\n" * 60 + b'end"\n2,b\n3,"open\nto, the\nend')]
        for name, raw in files:
            (folder / name).write_bytes(raw)
        before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            got = L.read_delimited(spark, str(folder))
            assert spark.read.text(str(folder)).rdd.getNumPartitions() > 5
            assert as_rows(got) == whole(by_hand(files), got.columns[1:])
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
            spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_each_file_has_its_own_form(spark, tmp_path):
    files = [
        ("a.csv", "﻿id,name\n1,Ünal\n\n2,x,more,still\n".encode()),
        ("b.csv", "name;city;id\r\nAndré;Köln;3\r\nshort\r\n".encode("latin-1")),
        ("c.csv", b'\n  \n"id"\t"note"\t\n4\t"a\nb"\tz\n5\t5" pipe\t\n'),
    ]
    for name, raw in files:
        (tmp_path / name).write_bytes(raw)
    (tmp_path / "d.csv").write_bytes(b"")
    got = L.read_delimited(spark, str(tmp_path))
    assert got.columns == ["_row_id", "id", "name", "city", "note", "_c2", "_overflow"]
    assert [tuple(r)[1:] for r in got.orderBy("_row_id").collect()] == [
        ("1", "Ünal", None, None, None, None), ("2", "x", None, None, None, ["more", "still"]),
        ("3", "André", "Köln", None, None, None), (None, "short", None, None, None, None),
        ("4", None, None, "a\nb", "z", None), ("5", None, None, '5" pipe', None, None),
    ]
    sent, L.MOST_SENT = L.MOST_SENT, 0  # the way of very many files
    try:
        assert as_rows(L.read_delimited(spark, str(tmp_path))) == as_rows(got)
    finally:
        L.MOST_SENT = sent


def test_documents_and_store(spark, tmp_path):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "a.txt").write_bytes("Invoice no 7\r\n\r\nfrom  Ana Ruiz — $1,200.00\r\n".encode())
    (folder / "b.txt").write_bytes("caf\xe9 au lait".encode("latin-1"))
    (folder / "c.txt").write_text("   ")
    docs = read_text_documents(spark, str(folder)).withColumn("name", F.element_at(F.split("doc_id", "/"), -1))
    got = {r["name"]: r for r in docs.collect()}
    assert got["a.txt"]["text"] == "Invoice no 7\n\nfrom Ana Ruiz -- $1,200.00" and got["a.txt"]["word_count"] == 8
    assert got["b.txt"]["text"] == "café au lait" and got["c.txt"]["error"] == "File is empty."
    store = str(tmp_path / "store")
    save_documents(docs.select(F.col("name").alias("document_id"), "text"), store)
    assert get_document(spark, store, "b.txt").first()["text"] == "café au lait" and get_document(spark, store, "x").isEmpty()


def test_stream_appends_each_file_once(spark, tmp_path):
    folder, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    folder.mkdir()
    (folder / "a.txt").write_text("Signed by Ana Ruiz on 2024-01-02 for 1,200.50 in all")
    store_records(spark, str(folder), out, marks).awaitTermination()
    (folder / "b.txt").write_text("nothing here")
    store_records(spark, str(folder), out, marks).awaitTermination()
    got = {r["doc_id"].rsplit("/", 1)[1]: r for r in spark.read.parquet(out).collect()}
    assert got["a.txt"]["detected_name"] == "Ana Ruiz" and got["a.txt"]["detected_amount"] == 1200.5
    assert got["b.txt"]["confidence"] == 0.4 and len(got) == 2


def test_signature_ignores_order_and_spelling(spark):
    pairs = [("a", "Order ID"), ("a", "name"), ("b", "NAME"), ("b", "order-id"), ("b", " ")]
    signed = schema_signature(spark.createDataFrame(pairs, "table string, column string")).collect()
    assert len({r["signature"] for r in signed}) == 1
