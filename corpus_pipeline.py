"""A corpus pipeline of five stages: quality rules, near-duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the columns of
``documents``. Extra columns pass through, whatever their names.

Defined results: null and empty texts have fewer words than the quality rules ask for, so they go in the first stage (by the
later stages alone they stay as they are; the last gives them their end id); null ids stay, ordered after others; of rows that are equal in id
and text one stays at the second stage; texts of any length are taken whole; ties are settled by id, then by the text's hash; an
empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fileloom.llm import mixing, ngram_join, packing, quality_rules, suffix_dedup
from fileloom.llm.common import bound_batches, materialize
from fileloom.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text keeps to the quality rules."""
    bound_batches(spark)
    return quality_rules.filter_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram Jaccard links connect."""
    bound_batches(spark)
    return ngram_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; n_chars follows the text."""
    bound_batches(spark)
    cut = suffix_dedup.remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask."""
    bound_batches(spark)
    return mixing.take_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences along a space-filling curve."""
    bound_batches(spark)
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixed", mixed),
    ("packed", packed),
]

#: SQL can express neither the flight of the mix nor the packing; the tests compare the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
