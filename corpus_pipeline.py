"""A pipeline over documents: quality, near-duplicates, repeats, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before
it kept; all but the last return the columns of documents. ``run`` writes each
result to the shared folder and rereads it as the next stage's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._shared import materialize
from corpusloom.llm.neardup import drop_near_duplicates
from corpusloom.llm.packing import pack_documents
from corpusloom.llm.quality import keep_good
from corpusloom.llm.repeats import PASSAGE_WORDS, without_repeats
from corpusloom.llm.secrets import redact_secrets


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE_WORDS words or more that several documents hold go from all of them."""
    return _measured(without_repeats(docs, PASSAGE_WORDS, "words", across=True))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(redact_secrets(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), added=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("secrets", secrets), ("packing", packing)]

#: Neither minima of hashes nor suffix arrays nor token ids can be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
