"""Corpus pipeline: quality rules, near-duplicates, repeated strings, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents. Rows
with a null or empty text are rejected by the first stage; a document whose text is wholly
removed as repeated goes on with an empty text and size 0, which the mix does not take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import binslack, fertility, mixing, neardup, suffix
from tidemark.llm.common import documents
from tidemark.scratch import drop, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tokeniser-fertility rules keep."""
    return fertility.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents at a similarity of 0.8 or more; rows without an id or without words stay."""
    return neardup.one_of_each(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that strings of 200 bytes repeated anywhere cover.

    A character that the removal cuts apart goes whole; n_chars is counted anew.
    """
    left = suffix.remove_repeats(docs, output="text")
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; one row a piece."""
    return binslack.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("minhash near-dedup", near_duplicates),
    ("suffix-array dedup", repeats),
    ("mixing to target weights", mix),
    ("best-fit packing", pack),
]

#: Tokenizers, suffix sorting and bin patterns are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        after = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            after = table(after, f"stage-{k}")
            drop(docs)
        docs = after
    return docs
