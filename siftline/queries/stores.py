"""Schema memory, document store and flat outputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline.checkpoints import new_path
from siftline.queries import inputs as I
from siftline.queries import sql as Q
from siftline.queries.profiles import _column_list
from siftline.queries.texts import CLEAN_TXT, WORDS
from siftline.sources import memory as M
from siftline.sources import sinks as S

QUERIES: dict = {}
SQL: dict[str, str] = {}

_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels"]


def _signatures(s, d):
    return M.schema_signature(M.columns_of({t: I.table(s, d, t) for t in _TABLES}, s))


_SIGNED = f"""cols AS ({_column_list(_TABLES)}), signed AS (SELECT "table", md5(string_agg("column", '|' ORDER BY "column")) AS signature
 FROM (SELECT DISTINCT "table", lower("column") AS "column" FROM cols) GROUP BY 1)"""
QUERIES["schema_signature"] = _signatures
SQL["schema_signature"] = f"WITH {_SIGNED} SELECT * FROM signed"


def _memory(s, d):
    """A saved mapping per order, most of them for a few signatures: later ones replace earlier ones."""
    return I.table(s, d, "orders").selectExpr(
        "md5(case when o_orderkey % 3 = 0 then 'r_name|r_regionkey' else cast(o_custkey as string) end) AS signature",
        "'map ' || cast(o_orderkey as string) AS mapping", "cast(o_orderdate as date) AS created_at",
    )


_MEMORY = """memory AS (SELECT md5(case when o_orderkey % 3 = 0 then 'r_name|r_regionkey' else cast(o_custkey as string) end) AS signature,
 'map ' || cast(o_orderkey as string) AS mapping, cast(o_orderdate as date) AS created_at FROM orders),
newest AS (SELECT signature, mapping, created_at FROM (SELECT *, row_number() OVER (PARTITION BY signature
 ORDER BY created_at DESC, mapping DESC) AS k FROM memory) WHERE k = 1)"""
QUERIES["upsert_schema_memory"] = lambda s, d: M.upsert_schema_memory(
    _memory(s, d).filter("created_at < '1997-01-01'"), _memory(s, d).filter("created_at >= '1997-01-01'")
).withColumn("created_at", F.col("created_at").cast("string"))
SQL["upsert_schema_memory"] = f"WITH {_MEMORY} SELECT signature, mapping, cast(created_at as varchar) AS created_at FROM newest"
QUERIES["lookup_schema_memory"] = lambda s, d: M.lookup_schema_memory(
    _signatures(s, d), M.upsert_schema_memory(_memory(s, d), _memory(s, d))
)
SQL["lookup_schema_memory"] = f"""WITH {_SIGNED}, {_MEMORY} SELECT "table", signed.signature, mapping, mapping is not null AS from_cache
 FROM signed LEFT JOIN newest USING (signature)"""


def _stored(s, d):
    path = new_path(s, "documents")
    docs = I.table(s, d, "documents").select(F.col("doc_id").alias("document_id"), "text", "source")
    M.save_documents(docs.filter("lang = 'en'"), path)
    M.save_documents(docs.join(I.table(s, d, "documents").filter("lang = 'en'").selectExpr("doc_id AS document_id"), "document_id", "left_anti"), path)
    return s.read.parquet(path), path


QUERIES["save_documents"] = lambda s, d: _stored(s, d)[0]
SQL["save_documents"] = "SELECT doc_id AS document_id, text, source FROM documents"
QUERIES["get_document"] = lambda s, d: M.get_document(s, _stored(s, d)[1], 42)
SQL["get_document"] = "SELECT doc_id AS document_id, text, source FROM documents WHERE doc_id = 42"


def _nested(s, d):
    events = I.table(s, d, "events")
    return events.select(
        "event_id", F.struct("user_id", F.struct("event_type").alias("what")).alias("who"),
        F.from_json("props", "map<string,bigint>").alias("props"),
        F.array_repeat(F.col("event_type"), (F.col("event_id") % 60).cast("int")).alias("tags"),
    )


QUERIES["to_table"] = lambda s, d: S.to_table(_nested(s, d))
SQL["to_table"] = """SELECT event_id, user_id AS "who.user_id", event_type AS "who.what.event_type",
 cast(json_extract(props, '$.k') as bigint) AS "props.k",
 rtrim(repeat(event_type || '; ', (event_id % 60)::bigint), '; ') AS tags FROM events"""


def _toml_input(s, d):
    return I.messy_orders(s, d, "order_id", "quantity", "remark", "city").withColumn("gift", F.expr("_row_id % 2 = 0"))


QUERIES["to_toml_lines"] = lambda s, d: S.to_toml_lines(_toml_input(s, d))
SQL["to_toml_lines"] = f"""WITH {I.ORDERS_CTE} SELECT _row_id, '[[data]]' || chr(10) || 'order_id = "' || order_id || '"'
 || coalesce(chr(10) || 'quantity = ' || quantity, '') || coalesce(chr(10) || 'city = ' || to_json(city)::varchar, '') || coalesce(chr(10) || 'remark = ' || to_json(remark)::varchar, '')
 || chr(10) || 'gift = ' || case when _row_id % 2 = 0 then 'true' else 'false' end AS toml FROM messy"""


def _csv_back(s, d):
    path = new_path(s, "csv")
    S.write_csv(I.messy_orders(s, d, "order_id", "email", "quantity"), path)
    return s.read.csv(path, header=True, escape='"')


QUERIES["write_csv"] = _csv_back
SQL["write_csv"] = f"WITH {I.ORDERS_CTE} SELECT order_id, email, cast(quantity as varchar) AS quantity FROM messy"


def _json_back(s, d):
    """The outputs of the customers, read back with the numbers of their manifest."""
    path, raw = new_path(s, "json"), I.messy_customers(s, d)
    S.write_cleaning_outputs("customers/2024", raw, raw.limit(0), path)
    S.write_cleaning_outputs("customers/2024", raw, raw.filter("_row_id % 2 = 0"), path, metadata={"source": "customer"})
    now = S.cleaning_outputs(s, "customers/2024", path)
    manifest = s.read.json(now["manifest"]).selectExpr(
        "document_id", "get_json_object(metadata, '$.source') AS source", "validated_rows", "final_rows"
    ).first()
    rows = s.read.json(now["final"]).select("_row_id", "customer_name", "contact_email", "balance")
    return rows.select("*", *[F.lit(v).alias(k) for k, v in manifest.asDict().items()])


QUERIES["write_cleaning_outputs"] = _json_back
SQL["write_cleaning_outputs"] = f"""WITH {I.CUSTOMERS_CTE} SELECT _row_id, customer_name, contact_email, balance,
 'customers/2024' AS document_id, 'customer' AS source, (SELECT count(*) FROM messy) AS validated_rows,
 (SELECT count(*) FROM messy WHERE _row_id % 2 = 0) AS final_rows FROM messy WHERE _row_id % 2 = 0"""


def _deep(s, d):
    """Maps inside structs inside maps, and one with a key for every event."""
    inner = F.struct(F.create_map("event_type", "user_id").alias("m"), F.col("value").alias("v"))
    return I.table(s, d, "events").select(
        "event_id", F.create_map(F.concat(F.lit("k"), (F.col("event_id") % 2).cast("string")), inner).alias("outer"),
        F.create_map("event_id", "user_id").alias("by_id"),
    )


QUERIES["to_table_nested_maps"] = lambda s, d: S.to_table(_deep(s, d)).select(
    "event_id", "by_id", *[F.col(f"`outer.k{k}.{x}`").alias(f"k{k}_{x.replace('.', '_')}") for k in (0, 1) for x in ("m.click", "m.view", "v")]
)
SQL["to_table_nested_maps"] = "SELECT event_id, '{\"' || event_id || '\":' || user_id || '}' AS by_id, " + ", ".join(
    f"case when event_id % 2 = {k} {c} then {v} end AS k{k}_{n}" for k in (0, 1)
    for n, c, v in (("m_click", "and event_type = 'click'", "user_id"), ("m_view", "and event_type = 'view'", "user_id"), ("v", "", "value"))
) + " FROM events"


def _csv_file(s, d):
    """The orders written as a semicolon file with commas in its cells, for the reading operators."""
    path = new_path(s, "orders")
    I.messy_orders(s, d, "order_id", "total_price", "city").drop("_row_id").coalesce(1).write.csv(
        path, sep=";", header=True, escape='"'
    )
    return path


def _detect(s, d):
    from siftline.sources.delimited import detect_delimiter

    return detect_delimiter(s, _csv_file(s, d))


QUERIES["detect_delimiter"] = _detect
SQL["detect_delimiter"] = "SELECT ';' AS delim, 3 AS n_cols, count(*) AS n_rows, 3000000 + count(*) AS score FROM orders"


def _read(s, d):
    from siftline.sources.delimited import read_delimited

    return read_delimited(s, _csv_file(s, d)).select("order_id", "total_price", F.trim("city").alias("city"))


QUERIES["read_delimited"] = _read
SQL["read_delimited"] = f"WITH {I.ORDERS_CTE} SELECT order_id, trim(total_price) AS total_price, trim(city) AS city FROM messy"


# Three folders of files: quoted line breaks; another header, delimiter and encoding; cells beyond the header.
_FORMS = {
    "a": ("order_id", "total_price", "case when _row_id % 5 = 0 then 'two' || chr(10) || '\"lines\", ' || order_id else 'note' end AS note"),
    "b": ("'Köln' AS city", "order_id"),
    "c": ("order_id", "status", "'x' AS `extra 1`", "'y' AS `extra 2`"),
}


def _folder(s, d):
    from siftline.sources.delimited import read_delimited

    path, rows = new_path(s, "forms"), I.messy_orders(s, d, "order_id", "total_price", "status")
    pick = lambda k: rows.filter(f"_row_id % 3 = {k}").selectExpr(*_FORMS["abc"[k]])
    pick(0).write.csv(f"{path}/a", header=True, escape='"')
    pick(1).write.csv(f"{path}/b", header=True, escape='"', sep=";", encoding="ISO-8859-1")
    # The header of the third kind names two of its four columns: it is written as the first line of each file.
    lines = pick(2).selectExpr("concat_ws('\t', order_id, status, `extra 1`, `extra 2`) AS value")
    lines.coalesce(1).mapInPandas(_with_header, "value string").write.text(f"{path}/c")
    return read_delimited(s, f"{path}/*").select(
        "order_id", F.trim("total_price").alias("total_price"), "note", "city", F.trim("status").alias("status"),
        F.array_join("_overflow", "|").alias("more"),
    )


def _with_header(frames):
    import pandas as pd

    yield pd.DataFrame({"value": ["order_id\tstatus"]})
    yield from frames


QUERIES["read_delimited_folder"] = _folder
SQL["read_delimited_folder"] = f"""WITH {I.ORDERS_CTE} SELECT order_id,
 case when _row_id % 3 = 0 then trim(total_price) end AS total_price,
 case when _row_id % 3 = 0 then case when _row_id % 5 = 0 then 'two' || chr(10) || '"lines", ' || order_id else 'note' end end AS note,
 case when _row_id % 3 = 1 then 'Köln' end AS city, case when _row_id % 3 = 2 then trim(status) end AS status,
 case when _row_id % 3 = 2 then 'x|y' end AS more FROM messy"""


def _documents(s, d):
    from siftline.sources.documents import clean_documents

    raw = I.messy_documents(s, d).selectExpr("_row_id AS doc_id", "case when _row_id % 50 = 0 then '  ' else text end AS value")
    return clean_documents(raw)


QUERIES["clean_documents"] = _documents
_STRIPPED = Q.strip("case when _row_id % 50 = 0 then '  ' else text end")
SQL["clean_documents"] = f"""WITH {I.DOCUMENTS_CTE}, raw AS (SELECT _row_id AS doc_id, {_STRIPPED} AS text FROM messy),
cleaned AS (SELECT doc_id, text AS raw, {CLEAN_TXT} AS text FROM raw)
SELECT doc_id, 'txt' AS file_type, nullif(text, '') AS text, {WORDS} AS word_count,
 case when raw = '' then 'File is empty.' when text = '' then 'File has no usable content after cleaning.' end AS error FROM cleaned"""
