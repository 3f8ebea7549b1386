"""The upload path as a stream: each new text file is cleaned, typed and turned into rows.

All steps are row-local, so the stream keeps no state; what depends on a whole table (profiles,
medians, deduplication) runs as a batch job over the stored rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from siftline import functions as X
from siftline.operators.extract import extract_records
from siftline.sources.documents import clean_documents


def incoming_documents(spark: SparkSession, folder: str, kind: str = "txt") -> DataFrame:
    """A streaming DataFrame of the cleaned files that arrive in a folder."""
    raw = spark.readStream.text(folder, wholetext=True)
    return clean_documents(raw.select(F.col("_metadata.file_path").alias("doc_id"), "value"), kind)


def records_of(docs: DataFrame) -> DataFrame:
    """Extracted rows with the kind of their document; works on streams and on tables."""
    typed = docs.select("doc_id", X.document_type(F.col("text")).alias("document_type"), "text")
    return extract_records(typed)


def store_records(spark: SparkSession, folder: str, out: str, checkpoint: str, kind: str = "txt") -> StreamingQuery:
    """Append the extracted rows of all files present in the folder, each exactly once."""
    rows = records_of(incoming_documents(spark, folder, kind))
    return (
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
