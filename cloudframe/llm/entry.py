"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudframe.llm import ann, fim, hard_negatives, langid, line_dedup, mixing, near_dups, packing, pii, quality, records, sharding, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the language of every document, learning from two thirds of them."""
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1
    model = langid.fit(docs.where(~held_out))
    return langid.identify_languages(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")


def op2_lookup_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place every document on one of 64 shards."""
    return sharding.assign_shards(_table(spark, sf_dir, "documents").select("doc_id"), [f"shard-{k:03d}" for k in range(64)])


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents sampled by rates raked to source, language and topic targets."""
    kept = mixing.mixed_sample(_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    none = F.lit("")
    return kept.select("doc_id", F.coalesce("source", none).alias("source"), F.coalesce("lang", none).alias("lang"), "topic", "n_tokens", F.round(F.col("rate") * 1_000_000).cast("bigint").alias("rate_ppm"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_dups.near_duplicate_classes(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("h1", "h2")


def op5_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id 20 divides, among all vectors."""
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the compression bands for every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.judge_quality(docs, quality.bands_of(spark, docs, sf_dir))
    return judged.select("doc_id", "quality_scores.*", "base_failed", "kept")


def op7_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and places of personal data in every document."""
    found = pii.find_personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [pii.count_kind(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(F.concat("base", "found")).alias("spans"))


def op8_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 1024 tokens."""
    return packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count the tokens of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that an equal or near line precedes."""
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id 100 divides, among all vectors."""
    vec_id, label = F.col("vec_id"), F.col("label")
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), vec_id % 100 == 0, F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))


def op12_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the token ids of every document to record files, and digest what is read back from them."""
    files = records.write_records(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    found = records.read_records(files, records.in_order(files, records.with_start(files.index(spark))), digest=True)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document reordered for filling in its middle, and restored."""
    output, form = F.col("fim.output"), F.col("fim.form")
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    done = fim.fill_in_middle(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", digest(output).alias("output_sha256"), digest(fim.restored(output, form)).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_lookup_sharding": op2_lookup_sharding,
        "op3_source_mixing": op3_source_mixing,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_collision_search": op5_collision_search,
        "op6_compression_bands": op6_compression_bands,
        "op7_contextual_pii": op7_contextual_pii,
        "op8_squares_packing": op8_squares_packing,
        "op9_token_counts": op9_token_counts,
        "op10_line_dedup": op10_line_dedup,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_record_files": op12_record_files,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_lookup_sharding": sharding.oracle([f"shard-{k:03d}" for k in range(64)]), "op3_source_mixing": mixing.oracle(), "op11_hard_negatives": hard_negatives.ORACLE_SQL, "op13_fill_in_middle": fim.ORACLE_SQL}
