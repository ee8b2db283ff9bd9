"""The corpus pipeline: language ID, near-dedup, personal data, mixing, packing.

Each stage gets the documents that the one before wrote. All but the last return the columns of the
documents; the last returns the batch and slot of every row that the mixture holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkseek.llm._common import dropped, saved
from sparkseek.llm.language import identified
from sparkseek.llm.mixing import mixed
from sparkseek.llm.packing import packed
from sparkseek.llm.pii import redacted
from sparkseek.llm.simhash import deduplicated


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told, with it in ``lang``; null texts, texts without a letter and undecided ones go."""
    return identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near copies; null ids stay only where a group has no other."""
    return deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data replaced by its kind; null and empty texts stay as they are."""
    return redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of the sources takes it; empty texts weigh nothing."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row of the mixture goes: ``doc_id, n_tokens, bucket, bucket_len, batch, slot``."""
    return packed(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("personal_data", personal_data), ("mixing", mixing), ("packing", packing)]
#: The language model and the field are fitted by descent, which SQL can't express; tests hold each stage to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage wrote is deleted once the next has written; packing writes the lengths first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
        if before is not None:
            dropped(before)
        before = docs
    out = STAGES[-1][1](spark, docs, sf_dir)
    dropped(docs)
    return out
