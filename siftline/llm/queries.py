"""The queries of the numbered operators on the given tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.checkpoints import new_path
from siftline.llm.alignment import align_tokenizers
from siftline.llm.bytebpe import decode_documents, encode_documents
from siftline.llm.chat import chat_digests, chat_windows
from siftline.llm.jaccard import jaccard_groups
from siftline.llm.linededup import dedup_lines
from siftline.llm.mixing import mix_sources
from siftline.llm.packing import pack_documents
from siftline.llm.pii import replace_personal_data
from siftline.llm.quality import quality_rules
from siftline.llm.sql import SQL
from siftline.llm.tables import table
from siftline.llm.toxicity import toxicity
from siftline.llm.vectors import near_vectors
from siftline.llm.warc import read_warc, write_warc
from siftline.llm.whitening import whiten

# The wanted mixture: sources alike, English held down, prose in front.
TARGETS = {
    "source": {f"src{k}": 0.05 for k in range(20)},
    "lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15},
    "topic": {"prose": 0.85, "table": 0.05, "markup": 0.05, "note": 0.05},
}
SHARE = 0.6
SURROGATE_KEY = "example-key-for-tests"


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """A tokenizer file that the queries use; operators take its path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op2_chat_windows(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    probe = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"),
    )
    return chat_digests(chat_windows(turns.unionByName(probe)))


def op3_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), vocabulary(), with_ids=False)


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    manifest = write_warc(table(spark, folder, "pages"), new_path(spark, "warc"))
    return read_warc(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return replace_personal_data(docs, SURROGATE_KEY).select("doc_id", F.col("_n_entities").alias("n_entities"), "text")


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return toxicity(docs, table(spark, folder, "labels")).select(
        "doc_id", F.col("_held_out").alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted")
    )


def op7_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_groups(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


def op10_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mix_sources(table(spark, folder, "documents"), TARGETS, SHARE)
    return mixed.select(
        "doc_id", F.col("_cell_source").alias("source"), F.col("_cell_lang").alias("lang"), F.col("_cell_topic").alias("topic"),
        F.col("_tokens").alias("tokens"), F.col("_weight").alias("weight"), F.col("_probability").alias("probability"),
        F.col("_kept").alias("kept"),
    )


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    white = whiten(table(spark, folder, "embeddings"))
    # Exact as a decimal; a long holds it up to about 10^8 distinct vectors of the given kind.
    return white.withColumn("deviation", F.col("deviation").try_cast("bigint"))


def op12_align_tokenizers(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    aligned = align_tokenizers(docs, vocabulary(), vocabulary("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return aligned.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
        digest.alias("groups_sha256"),
    )


def op13_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    ranks = vocabulary("byte_bpe_50k.tiktoken")
    encoded = encode_documents(table(spark, folder, "documents").select("doc_id", "text"), ranks)
    return decode_documents(encoded, ranks).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_chat_windows, op3_best_fit_packing, op4_warc, op5_surrogates, op6_toxicity,
    op7_near_vectors, op8_line_dedup, op9_jaccard_join, op10_mix_sources,
    op11_whitening, op12_align_tokenizers, op13_byte_bpe,
)}


def all_queries() -> dict:
    """The queries above and the pipeline."""
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def all_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express."""
    import corpus_pipeline

    return SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
