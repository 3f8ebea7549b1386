"""The corpus pipeline: toxicity, repeated lines, near duplicates, mixture, packing.

Each stage takes what the one before it kept and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes every stage to the shared folder and reads it back, so a lost executor costs at most
the stage it worked on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.jaccard import one_of_each_group
from siftline.llm.linededup import dedup_lines
from siftline.llm.mixing import mix_sources
from siftline.llm.packing import pack_documents
from siftline.llm.queries import SHARE, TARGETS, vocabulary
from siftline.llm.tables import stored, table
from siftline.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled documents of its input."""
    return toxicity(docs.select(COLUMNS), table(spark, sf_dir, "labels")).filter("_predicted = 0").select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of other documents go; documents stay, with ``n_chars`` of what is left."""
    return dedup_lines(docs.select(COLUMNS)).withColumn(
        "n_chars", F.when(F.col("_n_dropped") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    ).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return one_of_each_group(docs.select(COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by the probabilities that the raked weights give."""
    return mix_sources(docs.select(COLUMNS), TARGETS, SHARE).filter("_kept").select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in sequences of 1024 tokens."""
    return pack_documents(docs.select(COLUMNS), vocabulary(), with_ids=False)


STAGES = [
    ("toxicity", drop_toxic), ("line_dedup", drop_lines), ("jaccard_join", drop_near_copies),
    ("mix_sources", mix), ("packing", pack),
]

# Training, rank-dependent packing and hash sampling have no SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
