"""The corpus pipeline: toxicity, near duplicates, secrets and packing, one stage after the other.

Each stage is written as Parquet in the shared folder and read again as the next one's documents. Toxic documents
go, of each group of near duplicates the one with the smallest id stays, secrets are replaced in the text, and what is left
is packed into sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridloom import ship
from gridloom.llm import minhash, packing, secrets, toxicity
from gridloom.llm.base import new_table, table

#: SQL can't train the toxicity chain.
ORACLE_SQL: str | None = None


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", without_toxic), ("minhash", without_near_duplicates), ("secrets", without_secrets), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_table(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
