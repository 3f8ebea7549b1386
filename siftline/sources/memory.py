"""Stored documents and the schema memory, as Parquet tables.

Every change of the schema memory is a folder of its own, written under a temporary name and renamed when it is whole.
Changes made at the same time therefore never meet, and a job that is killed leaves nothing that readers see. The
newest entry of a signature counts; ``compact_schema_memory`` turns many changes into one.
"""

from __future__ import annotations

import hashlib
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline import functions as X
from siftline.sources.commit import delete, names, new_version


def save_documents(docs: DataFrame, path: str) -> None:
    """Append documents to the store."""
    docs.write.mode("append").parquet(path)


def get_document(spark: SparkSession, path: str, document_id) -> DataFrame:
    """The stored document with this id, or no row; the id is a filter of the Parquet scan."""
    return spark.read.parquet(path).filter(F.col("document_id") == F.lit(document_id))


def schema_signature(columns: DataFrame) -> DataFrame:
    """``(table, signature)`` from ``(table, column)``: MD5 of the sorted distinct normalized names."""
    norm = X.normalize_field_name(F.col("column"))
    named = columns.filter(X.present(F.col("column")))
    return named.groupBy("table").agg(
        F.md5(F.array_join(F.array_sort(F.collect_set(norm)), "|")).alias("signature")
    )


def columns_of(tables: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """``(table, column)`` of some DataFrames."""
    pairs = [(t, c) for t, df in tables.items() for c in df.columns]
    return spark.createDataFrame(pairs, "table string, column string")


def lookup_schema_memory(signatures: DataFrame, memory: DataFrame) -> DataFrame:
    """The remembered mapping of each signature, NULL where there is none."""
    return signatures.join(memory.select("signature", "mapping"), "signature", "left").withColumn(
        "from_cache", F.col("mapping").isNotNull()
    )


def _newest(order: Column) -> Column:
    return F.row_number().over(Window.partitionBy("signature").orderBy(order.desc(), F.desc("mapping")))


def upsert_schema_memory(memory: DataFrame, new: DataFrame) -> DataFrame:
    """Memory with the new entries; per signature the newest stays.

    ``row_number() = 1`` is limited before the shuffle, so a signature saved very often stays cheap.
    """
    both = memory.unionByName(new)
    return both.withColumn("__place", _newest(F.col("created_at"))).filter("__place = 1").drop("__place")


CHANGE = "change-"
_MEMORY = "signature string, mapping string, created_at timestamp"


def signature_of(columns: list[str]) -> str:
    """The signature of some column names, as ``schema_signature`` gives it."""
    found = sorted({X.field_name(c) for c in columns if c.strip()})
    return hashlib.md5("|".join(found).encode("utf-8")).hexdigest()


def read_schema_memory(spark: SparkSession, folder: str) -> DataFrame:
    """The newest ``(signature, mapping, created_at)`` of every signature; a missing folder is an empty memory."""
    paths = names(spark, folder, CHANGE)
    if not paths:
        return spark.createDataFrame([], _MEMORY)
    return upsert_schema_memory(spark.createDataFrame([], _MEMORY), spark.read.schema(_MEMORY).parquet(*paths))


def write_schema_memory(new: DataFrame, folder: str) -> str:
    """Add entries to the memory as one change; its folder."""
    entries = new.select("signature", "mapping", F.col("created_at").cast("timestamp").alias("created_at"))
    return new_version(new.sparkSession, folder, CHANGE, lambda draft: entries.write.parquet(draft))


def save_schema_map(spark: SparkSession, folder: str, signature: str, mapping: str) -> None:
    """Remember one mapping."""
    row = [(signature, mapping, datetime.now(timezone.utc))]
    write_schema_memory(spark.createDataFrame(row, _MEMORY).coalesce(1), folder)


def compact_schema_memory(spark: SparkSession, folder: str) -> None:
    """Replace the changes so far by one. Changes made meanwhile stay; a reader that had listed the old ones reads again."""
    old = names(spark, folder, CHANGE)
    if len(old) < 2:
        return
    write_schema_memory(upsert_schema_memory(spark.createDataFrame([], _MEMORY), spark.read.schema(_MEMORY).parquet(*old)), folder)
    for path in old:
        delete(spark, path)
