"""The corpus pipeline: toxicity, quality rules, near-duplicates, decontamination, tokens.

Every stage reads what its predecessor kept. The first four return the columns of documents and drop
rows; the last returns each remaining document's tokens. SQL cannot express the fitted and the
suffix-array stages, so ORACLE_SQL is None and tests compare the stages with brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbis.llm import bpe, decontamination, near_duplicates, quality_rules, toxicity
from urbis.llm.common import persist


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without toxic content (operator 9)."""
    sample = toxicity.labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", toxicity.TRAINING_ROWS)
    return toxicity.keep_clean(docs, toxicity.train(sample, "text", "label"))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the repetition rules (operator 3)."""
    return quality_rules.keep_good(docs)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (operator 4)."""
    return near_duplicates.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark passage (operator 8)."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and ids_sha256 of each document (operator 5)."""
    encoded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", apply_quality_rules),
    ("ngram_jaccard", one_of_each_class),
    ("decontamination", drop_leaks),
    ("bpe", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another on the documents of sf_dir; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = persist(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
