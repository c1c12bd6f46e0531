"""Corpus pipeline: quality, exact copies, near copies, mix, packing.

Each stage takes (spark, documents, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from halyard.llm.common import scratch_path
from halyard.llm.exact_dedup import drop_exact_copies
from halyard.llm.jaccard import drop_near_copies
from halyard.llm.mixing import apply_mix
from halyard.llm.packing import pack_documents
from halyard.llm.quality import keep_good
from halyard.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays."""
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by five-word shingles at 0.8 the smallest id stays."""
    return drop_near_copies(docs, n=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources drawn to their target weights; a row for each copy taken."""
    return apply_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids along the Hilbert curve."""
    return pack_documents(docs, tokenizer_path(), cache_words=CACHE_WORDS)


#: Workers serve all stages in turn, so packing keeps fewer words than on its own.
CACHE_WORDS = 250_000

STAGES = [
    ("quality", quality),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mix", mix),
    ("packing", packing),
]

#: The classifier, the mix and the packing are beyond SQL; tests/llm holds the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
