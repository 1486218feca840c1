"""A corpus pipeline of five stages: toxicity, near duplicates, personal data, source weights, packing.

Each stage takes (spark, docs, folder) and returns a DataFrame that is written before the next one reads it.  All but
the last return the columns of `documents`; the last one returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillstone.llm import mixing, packing, pii, simhash, toxicity
from rillstone.llm.common import read, stored
from rillstone.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that score below one half, by a model of the labelled documents among them that aren't held out.

    Null and empty texts stay (they score the bias); without labels of both classes every document stays.
    """
    return toxicity.keep_clean(docs, read(spark, folder, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each class of linked fingerprints: the one with the smallest id.

    Documents without words share fingerprint zero and are one class; of repeated rows one stays.
    """
    return simhash.keep_one(docs)


def redact(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, their personal data replaced by its kind, `n_chars` counted anew; null texts stay null."""
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mixture of the sources takes them, those at the edges of a shard's quota in part.

    Documents without words are never taken.
    """
    return mixing.mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every piece of the documents with its sequence and place there; repeated documents are packed each time."""
    return packing.packed(docs, tokenizer_path(), ["doc_id", "source", "lang"])


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_duplicates", drop_near_duplicates),
    ("pii", redact),
    ("mix_sources", mix),
    ("pack", pack),
]

#: Hashes of shingles, boosted trees and token ids have no SQL; the tests compare the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages in turn over `documents`."""
    docs = read(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, folder)
