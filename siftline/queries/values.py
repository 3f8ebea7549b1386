"""Value expressions: projections, predicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline import functions as X
from siftline.queries import inputs as I
from siftline.queries import sql as Q

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _value(name: str, source: str, outs: dict[str, tuple[str, Callable[[], Column], str]]) -> None:
    """Register ``out: (input column, expression, SQL)`` over a messy table; expressions need a session."""
    cte, read = {
        "orders": (I.ORDERS_CTE, I.messy_orders),
        "documents": (I.DOCUMENTS_CTE, lambda s, d, *_: I.messy_documents(s, d)),
    }[source]
    picked = [c for c, _, _ in outs.values()]

    def build(spark, folder):
        df = read(spark, folder, *picked)
        return df.select("_row_id", *[e().alias(o) for o, (_, e, _) in outs.items()])

    QUERIES[name] = build
    SQL[name] = f"WITH {cte} SELECT _row_id, " + ", ".join(f"{s} AS {o}" for o, (_, _, s) in outs.items()) + " FROM messy"


def _never_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


c = lambda name: F.col(name)
_value("strip_unicode_noise", "orders", {"remark_clean": ("remark", lambda: X.strip_unicode_noise(c("remark")), Q.unicode_noise("remark"))})
_value("clean_noise", "orders", {
    "remark_clean": ("remark", lambda: X.clean_noise(c("remark")), Q.noise("remark")),
    "priority_clean": ("priority", lambda: X.clean_noise(c("priority")), Q.noise("priority")),
})
_value("parse_number", "orders", {"price": ("total_price", lambda: X.parse_number(c("total_price")), Q.number("total_price"))})
_value("coerce_number", "orders", {
    "price": ("total_price", lambda: X.coerce_number(c("total_price")), Q.coerced("total_price")),
    "mail_number": ("email", lambda: X.coerce_number(c("email")), Q.coerced("email")),
})
_value("coerce_bool", "orders", {"paid_flag": ("paid", lambda: X.coerce_bool(c("paid")), Q.boolean("paid"))})
_value("parse_date", "orders", {"iso": ("order_date", lambda: X.parse_date(c("order_date")), Q.date("order_date"))})
_value("normalize_email", "orders", {
    "address": ("email", lambda: X.normalize_email(c("email")), f"lower({Q.nonblank('email')})"),
    "valid": ("email", lambda: X.is_valid_email(c("email")), Q.email_like("email")),
})
_value("normalize_phone", "orders", {
    "shown": ("phone", lambda: X.normalize_phone(c("phone")), Q.phone("phone")),
    "digits": ("phone", lambda: X.phone_digits(c("phone")), Q.digits("phone")),
    "valid": ("phone", lambda: _never_null(X.looks_like_phone(c("phone"))), Q.phone_like("phone")),
})
_value("phone_fingerprint", "orders", {
    "print": ("phone", lambda: X.phone_fingerprint(c("phone")), f"coalesce(right({Q.digits('phone')}, 10), '')")
})
_value("clean_name", "orders", {"name": ("city", lambda: X.clean_name(c("city")), f"nullif({Q.collapse('city')}, '')")})
_CITY = f"nullif({Q.collapse('city')}, '')"
_value("normalize_city", "orders", {"city_name": (
    "city", lambda: X.normalize_city(c("city")),
    f"case lower({_CITY}) when 'bengaluru' then 'Bangalore' when 'bangalore' then 'Bangalore' when 'gurgaon' then"
    f" 'Gurugram' when 'gurugram' then 'Gurugram' when 'bombay' then 'Mumbai' when 'calcutta' then 'Kolkata'"
    f" else {Q.title(_CITY)} end",
)})
_value("normalize_status", "orders", {"status_name": (
    "status", lambda: X.normalize_status(c("status")),
    "nullif(array_to_string(list_transform(list_filter(string_split("
    + Q.sub(Q.collapse("status"), r"[_\s-]+", " ")
    + ", ' '), lambda w: w <> ''), lambda w: upper(w[1]) || lower(w[2:])), ' '), '')",
)})
_value("normalize_payment", "orders", {
    "method": ("city", lambda: X.normalize_payment(c("city")), f"coalesce({Q.title(Q.strip('city'))}, '')")
})
_value("detect_currency", "orders", {"currency": (
    "total_price", lambda: X.detect_currency(c("total_price")),
    "case when coalesce(trim(total_price), '') = '' then '' when contains(total_price, '$') then 'USD' when"
    " contains(total_price, '€') then 'EUR' else upper(trim(total_price)) end",
)})
_value("normalize_label", "orders", {"label": (
    "status", lambda: X.normalize_label(c("status")), Q.sub(Q.sub("lower(trim(status))", "[^a-z0-9]+", "_"), "^_+|_+$", "")
)})
_N = Q.number("total_price")
_value("parse_quantity", "orders", {
    "amount": ("total_price", lambda: X.parse_number(c("total_price")), _N),
    "whole": (
        "total_price", lambda: _never_null(X.is_whole(X.parse_number(c("total_price")))),
        f"coalesce(({_N}) = floor({_N}) and abs({_N}) < 1e12, false)",
    ),
})
_value("looks_like_email", "orders", {
    "mail": ("email", lambda: _never_null(X.looks_like_email(c("email"))), Q.email_like("email")),
    "other": ("remark", lambda: _never_null(X.looks_like_email(c("remark"))), Q.email_like("remark")),
})
_value("looks_like_phone", "orders", {
    "phone_like": ("phone", lambda: _never_null(X.looks_like_phone(c("phone"))), Q.phone_like("phone")),
    "id_like": ("order_id", lambda: _never_null(X.looks_like_phone(c("order_id"))), Q.phone_like("order_id")),
})
_value("looks_like_date", "orders", {
    "date_like": ("order_date", lambda: _never_null(X.looks_like_date(c("order_date"))), Q.date_like("order_date")),
    "price_like": ("total_price", lambda: _never_null(X.looks_like_date(c("total_price"))), Q.date_like("total_price")),
})
_value("looks_like_currency", "orders", {
    "money": ("total_price", lambda: _never_null(X.looks_like_currency(c("total_price"))), Q.currency_like("total_price"))
})
_value("is_numeric_like", "orders", {
    "price_like": ("total_price", lambda: _never_null(X.is_numeric_like(c("total_price"))), Q.numeric_like("total_price")),
    "date_like": ("order_date", lambda: _never_null(X.is_numeric_like(c("order_date"))), Q.numeric_like("order_date")),
})
_value("valid_date_number_salary", "orders", {
    "valid_date": ("order_date", lambda: X.parse_date(c("order_date")).isNotNull(), f"{Q.date('order_date')} is not null"),
    "valid_number": ("total_price", lambda: X.parse_number(c("total_price")).isNotNull(), f"({_N}) is not null"),
    "valid_salary": ("total_price", lambda: X.is_salary(X.parse_number(c("total_price"))), f"coalesce(({_N}) between 0 and 1e8, false)"),
})
_WORDS = (
    r"\b(credit|debit)\s*card\b|\b(visa|mastercard|amex|discover)\b|\bmaster\s*card\b|\bamerican\s*express\b"
    r"|\b(paypal|pay\s*pal)\b|\b(stripe|razorpay|square)\b|\b(apple|google|samsung)\s*pay\b|\b(venmo|zelle|cashapp)\b"
    r"|\bupi\b|\b(cash|cheque|check)\b|\b(bank|wire)\s*transfer\b|\b(net\s*banking|e-?wallet)\b"
)
_METHOD = (
    "case _row_id % 6 when 0 then 'Credit  Card ' || order_id when 1 then 'paid by cash' when 2 then 'cashier'"
    " when 3 then ' Apple Pay' when 4 then city else 'wire transfer of a very long description indeed' end"
)
QUERIES["is_payment_method"] = lambda s, d: (
    I.messy_orders(s, d, "order_id", "city").selectExpr("_row_id", f"{_METHOD} AS method")
    .select("_row_id", X.is_payment_method(F.col("method")).alias("payment"))
)
SQL["is_payment_method"] = (
    f"WITH {I.ORDERS_CTE}, m AS (SELECT _row_id, {_METHOD} AS method FROM messy) SELECT _row_id,"
    f" coalesce(length(trim(method)) between 1 and 40 and regexp_matches(lower(trim(method)), '{_WORDS}'), false)"
    " AS payment FROM m"
)
_LINK = "'[mail ' || order_id || '](mailto: ' || coalesce(email, ' ') || ' )' || chr(13) || chr(10) || remark || chr(13)"
QUERIES["preprocess_markdown_links"] = lambda s, d: (
    I.messy_orders(s, d, "order_id", "email", "remark").selectExpr("_row_id", f"{_LINK} AS link")
    .select("_row_id", X.preprocess_markdown_links(F.col("link")).alias("plain"))
)
SQL["preprocess_markdown_links"] = (
    f"WITH {I.ORDERS_CTE}, m AS (SELECT _row_id, {_LINK} AS link, email, order_id, remark FROM messy) SELECT _row_id, "
    + Q.strip("case when link is null then null else coalesce(" + Q.nonblank("email")
              + ", 'mail ' || order_id) || chr(10) || remark || chr(10) end")
    + " AS plain FROM m"
)
