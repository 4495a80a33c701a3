"""Documents to packed sequences: quality rules, line dedup, near-dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuskit.llm.line_dedup import line_dedup
from corpuskit.llm.mixing import mix
from corpuskit.llm.order_minhash import one_of_each
from corpuskit.llm.packing import best_fit_packing
from corpuskit.llm.quality_rules import quality_rules
from corpuskit.llm.workload import tokenizer_file
from corpuskit.session import fresh_path, ship_package


def _as_documents(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of documents, ``n_chars`` that of the new text."""
    return df.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and the documents that the rules reject."""
    judged = quality_rules(docs).filter("kept").withColumn("text", F.col("clean_text"))
    return _as_documents(judged, docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One occurrence of each group of like lines stays in the corpus; documents left without a word go."""
    ship_package(spark)
    return _as_documents(line_dedup(docs, radius=None), docs).filter(F.col("text").rlike(r"[^\s]"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    ship_package(spark)
    return one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated towards the sources' target weights, in random order."""
    return mix(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 2048 tokens."""
    ship_package(spark)
    return best_fit_packing(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality), ("line_dedup", lines), ("minhash_near_dedup", near), ("mixing", mixed),
    ("best_fit_packing", packed),
]

# Fingerprints, alignment and token merges have no SQL form; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is a table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
