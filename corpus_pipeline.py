"""Documents to packed token sequences: quality, exact copies, near copies, benchmark passages, packing.

Stages before the last return the columns they get, extra ones and those with clashing names included. A null text
counts as empty; an empty table goes through and gives no rows; rows with equal ids are judged one by one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabforge.llm import decontaminate, exact, nearcopies, packing, quality
from tabforge.session import materialise

TOKENIZER, END_ID = "byte_bpe_50k.json", 1


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents the scorer rejects. Equal texts get equal verdicts; empty texts are scored like others."""
    return quality.keep_good(docs, quality.fit(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, empty ones included, the row with the largest id."""
    return exact.deduplicate(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class; texts without words are copies of each other only."""
    return nearcopies.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark window; texts without words hold none."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece; an empty text is its end id alone, a long one is cut."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), END_ID)


STAGES = [
    ("quality", good_quality),
    ("exact copies", without_copies),
    ("near copies", without_near_copies),
    ("benchmark", without_benchmark),
    ("packing", packed),
]
#: SQL cannot train the scorer or count a tokenizer's ids; the tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over all rows of the one before, which is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
