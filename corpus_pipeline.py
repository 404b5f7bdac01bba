"""A corpus pipeline of five stages over `documents`.

Each stage takes all that the stage before kept; what it returns is written as Parquet and
read again. Toxic documents go, then exact repeats, then all but one of each near-duplicate
group; personal data is masked; what is left is packed into sequences.

Every stage keeps the columns of its documents, whatever they are named, and takes them in any
order. Null texts count as empty; null ids and repeated ids are rows like others: where one of
several rows stays it is that with the smallest id, a null id only among null ids, and of equal
ids one row. Labels of null ids are not learned. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.common import read, stage
from sparkloom.llm.exact_dedup import drop_repeats
from sparkloom.llm.near_copies import keep_one
from sparkloom.llm.packing import pack
from sparkloom.llm.pii import mask
from sparkloom.llm.queries import vocabulary
from sparkloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; without labels, or with labels of one side, all of them."""
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, white space aside."""
    return drop_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 5-word shingles of similarity 0.8, candidates by op7's fuzzy hash and MinHash."""
    return keep_one(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; a null text stays null."""
    return mask(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]

#: SQL has no trained model, XXH64 or tokenizer; tests/llm/test_pipeline.py compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows."""
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
