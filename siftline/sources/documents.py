"""Text documents: one file, one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline import functions as X


def decode_text(c: Column) -> Column:
    """UTF-8 without its mark, else Latin-1 for the whole text."""
    latin = F.decode(c.cast("binary"), "ISO-8859-1")
    return F.regexp_replace(F.coalesce(F.try_validate_utf8(c), latin), "^\ufeff", "")


def clean_documents(raw: DataFrame, kind: str = "txt") -> DataFrame:
    """``doc_id, file_type, text, word_count, error`` from ``doc_id, value`` with raw file text.

    A document that is empty, or empty after cleaning, becomes an error row.
    """
    texts = raw.select("doc_id", X.strip(decode_text(F.col("value"))).alias("__raw"))
    clean = texts.withColumn("text", X.clean_text(F.col("__raw"), kind))
    error = (
        F.when(F.col("__raw") == "", F.lit("File is empty."))
        .when(F.col("text") == "", F.lit("File has no usable content after cleaning."))
    )
    return clean.select(
        "doc_id", F.lit(kind).alias("file_type"), F.nullif("text", F.lit("")).alias("text"),
        X.word_count(F.col("text")).alias("word_count"), error.alias("error"),
    )


def read_text_documents(spark: SparkSession, path: str, kind: str = "txt") -> DataFrame:
    """Every file below ``path`` as one cleaned document, named by its path."""
    raw = spark.read.text(path, wholetext=True)
    return clean_documents(raw.select(F.col("_metadata.file_path").alias("doc_id"), "value"), kind)
