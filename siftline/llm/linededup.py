"""Line deduplication across documents, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.tables import BLANK_CHARS, fresh, stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower_ascii(c: Column) -> Column:
    # lower() and translate agree on ASCII, and lower() is much faster.
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWER))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3,
) -> DataFrame:
    """``docs`` with ``text`` without repeated lines, and ``_n_lines`` and ``_n_dropped`` beside it.

    A line's key is the line without blanks at both ends and with A-Z in lower case. Keys of at least
    ``least_chars`` code points found in at least ``least_docs`` documents lose all their lines but those in the
    document with the largest id. Other lines stay in place.

    A null or empty text is one empty line and comes out empty. Every row is a document: a repeated row counts
    again, and where several rows share the largest id all of them keep the line. A null id is smaller than all
    others. All columns of ``docs`` are returned; where they have the name of a result, that result's name ends with
    an underscore more. Long texts are read whole.

    The hashes of the lines are written once; counting and the way back read them, so a line shared by a third of
    all documents is summed before it is shuffled. Texts are shuffled once, by id and hash of the text.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    n_lines, n_dropped, whole, th, did, dth, out, parts = fresh(
        docs, "_n_lines", "_n_dropped", "_text", "_th", "_did", "_dth", "_out", "_parts"
    )
    based = docs.withColumn(whole, text).withColumn(th, F.xxhash64(whole))
    key = lambda x: F.btrim(x, F.lit(BLANK_CHARS))
    keys = F.split(_lower_ascii(F.col(whole)), "\n")
    hashes = F.transform(keys, lambda x: F.when(
        F.length(key(x)) >= least_chars, F.struct(F.xxhash64(key(x)).alias("h"), F.hash(key(x)).alias("g"))
    ))
    lines = stored(based.select(F.col(id_col).alias("_id"), F.col(th).alias("_th"), hashes.alias("_hashes")), "lines")

    once = F.explode(F.array_distinct(F.filter("_hashes", lambda x: x.isNotNull())))
    # Written, so that the join below deals both sides anew and can split a line that very many documents hold.
    shared = stored(
        lines.select("_id", once.alias("x")).groupBy("x.h", "x.g")
        .agg(F.count("*").alias("n"), F.max("_id").alias("_keeper"))
        .filter(F.col("n") >= least_docs).drop("n"), "shared",
    )
    placed = lines.select("_id", "_th", F.posexplode("_hashes").alias("_pos", "x")).filter("x is not null")
    dropped = (
        placed.select("_id", "_th", "_pos", "x.h", "x.g").join(shared, ["h", "g"])
        .filter(~F.col("_id").eqNullSafe(F.col("_keeper")))
        .groupBy("_id", "_th").agg(F.collect_set("_pos").alias(out))
        .withColumnsRenamed({"_id": did, "_th": dth})
    )
    joined = based.join(
        dropped.hint("shuffle_hash"),
        F.col(id_col).eqNullSafe(F.col(did)) & (F.col(th) == F.col(dth)), "left",
    )
    pieces = F.split(whole, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col(out))
    joined = joined.withColumn(parts, pieces).withColumn(n_lines, F.size(parts).cast("bigint"))
    kept = F.when(F.col(out).isNull(), F.col(whole)).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")
    )
    return joined.withColumn(text_col, kept).withColumn(
        n_dropped, F.coalesce(F.size(out), F.lit(0)).cast("bigint")
    ).select(*docs.columns, n_lines, n_dropped)
