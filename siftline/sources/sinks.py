"""Flat tables, CSV, TOML text and JSON outputs."""

from __future__ import annotations

import json
import re
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline import functions as X
from siftline.operators.columns import ROW_ID, col
from siftline.sources.commit import delete, names, new_version, replaced


# A map column with more different key paths than this becomes text.
MOST_KEYS = 1000

Keys = dict[tuple[str, ...], list[str]]


def _holds_maps(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_holds_maps(f.dataType) for f in kind)
    return isinstance(kind, T.MapType)


def _key_paths(prefix: Column, c: Column, kind: T.DataType) -> Column:
    """All paths from ``prefix`` to a key of a map in ``c``, as arrays of names."""
    none = F.array().cast("array<array<string>>")
    if isinstance(kind, T.StructType):
        parts = [_key_paths(F.concat(prefix, F.array(F.lit(f.name))), c[f.name], f.dataType) for f in kind if _holds_maps(f.dataType)]
        return F.concat(none, *parts)
    if isinstance(kind, T.MapType):
        def below(e: Column) -> Column:
            path = F.concat(prefix, F.array(e["key"].cast("string")))
            inner = _key_paths(path, e["value"], kind.valueType) if _holds_maps(kind.valueType) else none
            return F.concat(F.array(path), inner)

        return F.coalesce(F.flatten(F.transform(F.map_entries(c), below)), none)
    return none


def _flat(path: tuple[str, ...], c: Column, kind: T.DataType, keys: Keys) -> list[tuple[str, Column]]:
    if isinstance(kind, T.StructType):
        return [f for s in kind for f in _flat((*path, s.name), c[s.name], s.dataType, keys)]
    if isinstance(kind, T.MapType):
        at = lambda k: F.try_element_at(c, F.lit(k).cast(kind.keyType))
        return [f for k in keys.get(path, []) for f in _flat((*path, k), at(k), kind.valueType, keys)]
    if isinstance(kind, T.ArrayType):
        items = F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("None")))
        return [(".".join(path), F.array_join(items, "; "))]
    return [(".".join(path), c)]


def to_table(df: DataFrame, most_keys: int = MOST_KEYS) -> DataFrame:
    """Nested columns as ``a.b`` columns, lists as text of all their items.

    Maps become a column for each key, inside structs and other maps too. The paths of all keys come from one aggregate
    over the table; a column with more than ``most_keys`` of them stays one column, as JSON, and its keys stay where
    they are.
    """
    nested = [f for f in df.schema if _holds_maps(f.dataType)]
    keys: Keys = {}
    many: set[str] = set()
    if nested:
        paths = F.concat(*[_key_paths(F.array(F.lit(f.name)), col(f.name), f.dataType) for f in nested])
        found = df.select(F.explode(paths).alias("path")).distinct()
        sizes = found.groupBy(F.col("path")[0].alias("column")).agg(F.count("*").alias("n"))
        many = {r["column"] for r in sizes.filter(F.col("n") > most_keys).collect()}
        few = [f.name for f in nested if f.name not in many]
        for r in found.filter(F.col("path")[0].isin(few)).orderBy("path").collect():
            keys.setdefault(tuple(r["path"][:-1]), []).append(r["path"][-1])
    flat = [
        f for s in df.schema
        for f in ([(s.name, F.to_json(col(s.name)))] if s.name in many else _flat((s.name,), col(s.name), s.dataType, keys))
    ]
    return df.select(*[c.alias(n) for n, c in flat])


def write_csv(df: DataFrame, path: str) -> None:
    """Flat CSV with a header; NULL is an empty cell. An older output stays until the new one is whole."""
    flat = to_table(df).drop(ROW_ID)
    replaced(df.sparkSession, path, lambda draft: flat.write.csv(
        draft, header=True, nullValue="", emptyValue="", escape='"',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ))


def _toml_value(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.BooleanType, T.IntegralType)):
        return c.cast("string")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        whole = F.concat(c.cast("decimal(38,0)").cast("string"), F.lit(".0"))
        return F.when((c == F.floor(c)) & (F.abs(c) < 1e16), whole).otherwise(c.cast("string"))
    if isinstance(kind, T.DecimalType):
        return c.cast("string")
    quoted = F.to_json(F.array(c.cast("string")))
    return F.when(c.isNotNull(), F.substr(quoted, F.lit(2), F.length(quoted) - 2))


def to_toml_lines(df: DataFrame) -> DataFrame:
    """One ``[[data]]`` block of text per row; NULL cells are left out, as TOML has no null."""
    flat = to_table(df)
    lines = [F.lit("[[data]]")]
    for f in flat.schema:
        if f.name == ROW_ID:
            continue
        key = f.name if re.fullmatch(r"[A-Za-z0-9_-]+", f.name) else '"' + f.name.replace('"', '\\"') + '"'
        lines.append(F.concat(F.lit(f"{key} = "), _toml_value(col(f.name), f.dataType)))
    kept = [ROW_ID] if ROW_ID in flat.columns else []
    return flat.select(*kept, F.concat_ws("\n", *lines).alias("toml"))


def safe_id(document_id) -> str:
    """A document id as a folder name; percent-encoded, so different ids never share a folder."""
    return quote(str(document_id), safe="").replace(".", "%2E")


OUTPUT = "output-"


def write_cleaning_outputs(
    document_id, validated: DataFrame, final: DataFrame, folder: str, stats: DataFrame | None = None,
    metadata: dict | None = None, keep: int = 2,
) -> dict[str, str]:
    """JSON lines of the validated and the final rows in a folder per document, their statistics, and a manifest.

    The manifest holds the id, the metadata and the numbers of rows, counted while they are written. All of it appears
    at once, as a new version, so a job that is killed leaves the one before; ``keep`` versions stay.
    """
    spark = final.sparkSession
    base = f"{folder.rstrip('/')}/document_id={safe_id(document_id)}"
    parts = {"validated": "validated_output", "final": "final_cleaned_output"}

    def write(draft: str) -> None:
        rows = {}
        for kind, df in (("validated", validated), ("final", final)):
            seen = Observation()
            df.observe(seen, F.count(F.lit(1)).alias("rows")).write.json(f"{draft}/{parts[kind]}")
            rows[kind] = seen.get["rows"]
        if stats is not None:
            stats.select("cleaning_summary", "field_types").write.json(f"{draft}/cleaning_summary")
        row = [(str(document_id), json.dumps(metadata or {}, default=str), rows["validated"], rows["final"])]
        schema = "document_id string, metadata string, validated_rows bigint, final_rows bigint"
        spark.createDataFrame(row, schema).coalesce(1).write.json(f"{draft}/manifest")

    new_version(spark, base, OUTPUT, write)
    for old in names(spark, base, OUTPUT)[:-keep]:
        delete(spark, old)
    return cleaning_outputs(spark, document_id, folder)


def cleaning_outputs(spark: SparkSession, document_id, folder: str) -> dict[str, str]:
    """The parts of the newest whole output of a document; empty if there is none."""
    versions = names(spark, f"{folder.rstrip('/')}/document_id={safe_id(document_id)}", OUTPUT)
    there = [p.rsplit("/", 1)[1] for p in names(spark, versions[-1], "")] if versions else []
    known = {"validated": "validated_output", "final": "final_cleaned_output", "summary": "cleaning_summary", "manifest": "manifest"}
    return {k: f"{versions[-1]}/{n}" for k, n in known.items() if n in there}
