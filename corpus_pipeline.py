"""A corpus from raw documents to tokens, stage by stage.

Every stage takes the documents that the one before kept and returns the same
columns; the last one returns what the encoding found, one row per document.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnledger.llm import bpe, decontamination, language, line_dedup, minhash
from turnledger.llm.registry import TOKENIZER
from turnledger.llm.shared import stored


def main_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents without letters."""
    return language.accepted(docs)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out later copies of three consecutive lines; a document of nothing else
    goes."""
    judged = line_dedup.dedup_lines(docs)
    kept = judged.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return kept.select(*(F.col("kept_text").alias(c) if c == "text" else f"`{c}`" for c in docs.columns))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return minhash.deduplicated(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts benchmark passages; a document that is mostly those goes."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of every document left, and the proof that they decode to its text."""
    return bpe.round_trip(docs, TOKENIZER)


STAGES = [
    ("language_id", main_language),
    ("line_dedup", fresh_lines),
    ("minhash_dedup", one_of_each),
    ("decontamination", without_benchmark),
    ("bpe", encoded),
]

#: A language model, signatures and a tokenizer are beyond SQL; a plain version in
#: tests/llm/test_pipeline.py does the same by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
