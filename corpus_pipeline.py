"""A corpus pipeline: quality rules, one document of each near-duplicate group, decontamination, mixing, token shards.

Every stage works on all that its predecessor kept, and its decisions take effect. Between stages the documents are written as
Parquet to the shared folder and read again.

Every stage but the last returns the columns of its input, whatever further ones there are and however they are named; takes texts of any length whole; and gives
an empty table for an empty one. What it does with nulls, empty texts, ties and repeated rows stands with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hapframe.llm.common import cut, table
from hapframe.llm.decontaminate import clean
from hapframe.llm.mixing import mix_documents
from hapframe.llm.neardup import keep_one_of_each
from hapframe.llm.quality_rules import keep_documents
from hapframe.llm.tokens import token_table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects. Null and empty texts are rejected, having too few words; equal rows share their fate; null ids and sources don't matter."""
    return keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group: five-word shingles, similarity 0.8.

    Null, empty and blank texts are in no group and stay, so do documents without a near copy; of equal rows, and of a group whose ids are all null, one stays.
    """
    return keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark. Null and empty texts contain none and stay; equal rows share their fate; items without words are passed over."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it, whole each time.

    Null and empty texts have no words to take and go; a null source is a source of its own; equal keys are settled by id, size and text, so that reruns agree; of
    equal rows as many are taken as the budget holds.
    """
    return mix_documents(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a document of the mix, read back from the shards: every repeat is a document. Null and empty texts have the end id alone; null ids come first."""
    return token_table(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("source_mix", mix_sources),
    ("token_shards", token_shards),
]
#: SQL cannot express near-duplicate components and BM25 retrieval; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
