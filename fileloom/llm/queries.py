"""The registered queries of the corpus operators and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fileloom.llm import language_crf, lz_fingerprint, mixing, ngram_join, oracles, packing, quality_rules, record_files, sharding, suffix_dedup, toxicity
from fileloom.llm.common import bound_batches


QUALITY_COLUMNS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_files.encode_and_read(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"), end_id=2)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(documents(spark, sf_dir))


def op4_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.fingerprints(documents(spark, sf_dir))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"), end_id=1)


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir), shards=8)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_quality(documents(spark, sf_dir)).select(*QUALITY_COLUMNS)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_crf.label_languages(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_record_files": op2_record_files,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_lz_fingerprint": op4_lz_fingerprint,
    "op5_ngram_join": op5_ngram_join,
    "op6_packing": op6_packing,
    "op7_sharding": op7_sharding,
    "op8_quality": op8_quality,
    "op9_mixing": op9_mixing,
    "op10_language": op10_language,
}

ORACLES: dict[str, str] = {"op3_suffix_dedup": oracles.REPEATS, "op5_ngram_join": oracles.LINKS, "op8_quality": oracles.QUALITY}
