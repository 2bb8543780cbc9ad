"""A corpus pipeline: classify, remove exact and near copies, cut repeated passages, pack.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. In every stage a null text counts as empty, an empty table gives an empty one, texts may be of
any length, and other columns, whatever their names and nulls, are carried along unread. Rows without a
doc_id are classified, cut in no way, kept beside others and packed under a null id.
"""

from pyspark.sql import DataFrame, SparkSession

from triagelake.llm import exact_dedup, jaccard_join, packing, quality_pu, substring_dedup
from triagelake.llm.common import written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels beside the documents.

    Rows are judged alone, so repeated rows and ties share a fate. Without a positive label every row stays.
    """
    return quality_pu.accepted(docs, quality_pu.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of equal texts; of repeated rows one. Rows without an id stay."""
    return exact_dedup.one_of_each(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of similar texts. Rows without words or without an id stay."""
    return jaccard_join.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that a document with a smaller id has.

    Texts that lose nothing stay as they are, white space included; rows that repeat an id cut nothing of each other.
    """
    return substring_dedup.cleaned(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents and their places in sequences of 1,024 ids; an empty text is one piece, the id that ends it."""
    return packing.pack(docs, encode_special_tokens=False)


STAGES = [("quality classifier", quality_classifier), ("exact dedup", exact_copies), ("n-gram jaccard join", near_copies), ("substring dedup", repeated_passages), ("packing", packed)]

#: A trained classifier and a tokenizer are not SQL; tests hold the stages against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
