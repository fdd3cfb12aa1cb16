"""The corpus pipeline: quality classifier, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs.  All but the last return the columns of ``documents``, whatever they are called, and an empty table gives an
empty result in all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossa.llm import mixing, near_dedup, packing, personal, quality
from glossa.llm.base import cut, table
from glossa.llm.registry import tokenizer


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are rejected; without a labelled text nothing is.  Repeated rows share their fate.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: of its smallest doc_id, a null one only if there is no other.

    Null and empty texts are one class, as are equal texts of any length; of repeated rows one stays.
    """
    return near_dedup.drop_near_duplicates(docs)


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind.

    Null stays null; rows without personal data, repeated ones and those without a doc_id stay as they are.
    """
    return personal.mask(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out, as their source's target asks.

    A null source is a source of its own; documents without words are taken once an epoch; ties of keys, as between
    repeated rows, are broken by the order of the rows.
    """
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens, placed in sequences.

    Null and empty texts are one piece with the closing id; very long texts are cut, and repeated rows packed each.
    """
    return packing.pack_documents(docs, tokenizer())


STAGES = [("quality classifier", classify), ("near duplicates", deduplicate), ("personal data", mask), ("mixing", mix), ("packing", pack)]
#: Tokenizer and classifier cannot be expressed in SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
