"""A corpus pipeline from documents to training sequences.

Every stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet and read again as the next
stage's ``docs``: quality rules drop documents, a near-duplicate join keeps the smallest document of each group, repeated
passages are removed from the texts, and the rest is packed into sequences.  All stages but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.ngram_join import jaccard_components
from loomwork.llm.packing import pack_documents
from loomwork.llm.quality import keep_documents
from loomwork.llm.scratch import fresh_path
from loomwork.llm.substring_dedup import deduplicated_texts


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles have a similarity of 0.8 or more: the smallest id."""
    groups = jaccard_components(docs, n=5, num=80, den=100).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(groups, "doc_id", "left_anti").select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words of 20-word windows that stand earlier; documents without repeats keep their text as it is."""
    return deduplicated_texts(docs, k=20)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return pack_documents(docs, longest=1024)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("packing", packing)]

#: The tokenizer and the hashing of the stages are not SQL: ``tests/llm/test_pipeline.py`` holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
