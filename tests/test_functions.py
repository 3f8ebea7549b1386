import math
import re

import pytest
from pyspark.sql import functions as F

from siftline import functions as X


def apply(spark, build, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(build(F.col("v"))).collect()]


@pytest.mark.parametrize("build, cases", [
    (X.parse_number, {"$1,250.75": 1250.75, "€ 8": 8.0, "1_500": 1500.0, "12d": None, "nan": None, "inf": None, "1e400": None,
                      " -$4 ": -4.0, "": None, None: None, ".5": 0.5, "5.": 5.0, "0x1p3": None}),
    (X.coerce_number, {"9[3]": 9.0, "250†": 250.0, "2,750[b]": 2750.0, "7@8": None, "x": None, "1 000": None}),
    (X.coerce_bool, {" YES ": True, "f": False, "0": False, "maybe": None}),
    (X.parse_date, {"2023-4-9": "2023-04-09", "9-4-2023": "2023-04-09", "4/9/2023": "2023-04-09", "29/4/2023": "2023-04-29",
                    "2023/4/9": "2023-04-09", "9 april 2023": "2023-04-09", "Apr 9, 2023": "2023-04-09", "April 9, 2023": "2023-04-09",
                    "9 Apr 2023": "2023-04-09", "30-02-2023": None, "1899-12-31": None, "2101-01-01": None, "2100-12-31": "2100-12-31",
                    "9.4.2023": None, "20230409": None, "13/13/2023": None, "9 Foo 2023": None}),
    (X.looks_like_date, {"2023-04-09": True, "9.4.23": True, "9 foo 2023": True, "Foo 9, 2023": True, "2023": False,
                         "20230409": False, "2023/4/9": True, "1-1": False, "text": False}),
    (X.looks_like_email, {" a.b@c.org ": True, "a@b": False, "a b@c.org": False}),
    (X.looks_like_phone, {"+44 (20) 7946-0958": True, "12345": False, "1234567890123456": False}),
    (X.phone_fingerprint, {"+44 20 7946 0958": "2079460958", "12-3": "123", None: ""}),
    (X.clean_noise, {"name [1]": "name", "a (b) c": "a c", "wow!!!": "wow!", "x||y": "xy", "p†‡": "p"}),
    (X.title_case, {"o'neil 3rd": "O'Neil 3Rd", "ANNA marie": "Anna Marie", "élan vital": "Élan Vital"}),
    (X.normalize_status, {"in_progress": "In Progress", "PAID": "Paid", " - ": None}),
    (X.normalize_city, {"Bombay": "Mumbai", "new  york": "New York", " ": None}),
    (X.detect_currency, {"12 $": "USD", "gbp": "GBP", "₹": "INR", "": "", None: "", "long words": "LONG WORDS"}),
    (X.normalize_label, {"Grand Total!": "grand_total", None: ""}),
    (X.is_payment_method, {"Visa card": True, "cashier": False, "e-wallet": True, "x" * 41 + " cash": False, "": False}),
    (X.strip_unicode_noise, {"a​b c": "ab c", "plain": "plain"}),
    (X.clean_cell, {"  x ---- y ": "x y", "All Rights Reserved": None, "it’s": "it's", "a—b": "a--b", "Page 2 of 5": None}),
    (X.preprocess_markdown_links, {"[me](mailto:a@b.co)": "a@b.co", "[me](mailto: )": "me", "a\r\nb\r": "a\nb"}),
    (X.word_count, {"a b\nc": 3, "  ": 0}),
    (X.normalize_field_name, {" Order - ID_": "order_id", "﻿Name": "name"}),
])
def test_values(spark, build, cases):
    assert apply(spark, build, list(cases)) == list(cases.values())


def test_field_name_agrees_with_its_expression(spark):
    names = [" Order - ID_", "﻿Name", "a__b", "--", "Ünit Preis"]
    assert apply(spark, X.normalize_field_name, names) == [X.field_name(n) for n in names]


def test_text_quality_by_hand(spark):
    # Worked out on paper: three shouted words of four cost 0.15, long runs 0.2, control characters 0.3.
    known = {
        "Plain words here.": 1.0,
        "SHOUTING WORDS are HERE": 0.85,
        "aaaaaaaa bbbbb": 0.8,
        "bad\x01\x02\x03 text": 0.7,
        "": 0.0,
        "x\n\n\n\n\n\ny": 0.7,
    }
    got = apply(spark, X.text_quality_score, list(known))
    assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(got, known.values()))


def test_documents(spark):
    tab, money = "a,b,c\nd,e,f\ng,h,i", "Due $5 and $6.50 and € 1,000"
    dated = "on 2024-01-02\nand 3/4/24\nx\ny\nz"
    assert apply(spark, X.document_type, [tab, money, dated, "long line " * 20, "short", " "]) == [
        "tabular_data", "financial_document", "structured_document", "narrative_document", "generic_document", "unknown"]
    assert apply(spark, X.extract_dates, ["3/4/2024 then 2024-01-02, 2024-01-02 and 99/99/99"]) == [["2024-01-02", "2024-03-04", "99/99/99"]]
    assert apply(spark, X.extract_amounts, ["1,200 and 1200 in 2024, 12.50, 7"]) == [[1200.0, 12.5]]
    assert apply(spark, X.extract_names, ["Ada Lovelace met ADA and ada; Ada  Lovelace, Grand Total, Ada LOVELACE, Al Ng"]) == [
        ["Ada Lovelace", "Ada  Lovelace", "Al Ng"]]
    assert apply(spark, lambda c: X.clean_text(c, "pdf"), ["helloWorld inter-\nnal\n 12 \nPage 3 of x\nEnd"]) == ["hello World internal\n\nEnd"]
    assert apply(spark, lambda c: X.clean_text(c, "csv"), ["a nan b None NaT nanny"]) == ["a b nanny"]
