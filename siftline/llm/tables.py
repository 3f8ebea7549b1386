"""Reading the given tables and cutting lineage in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftline.checkpoints import new_path

# The blanks that end a word, for regular expressions and for btrim.
BLANKS = r"[\x20\x09-\x0D]"
BLANK_CHARS = "\t\n\x0b\x0c\r "


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back, so later steps start from files."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores added where ``docs`` has a column of that name."""
    have = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name += "_"
        out.append(name)
    return out
