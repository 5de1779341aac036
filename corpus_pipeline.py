"""Cleaning, near-duplicate removal and packing of the documents, stage by stage.

Each stage takes ``(spark, docs, sf_dir)``; what it returns is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns they
were given. Nulls, repeated rows and empty tables are each operator's, see there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from urnstat.llm import boosting, packing, quality, simhash
from urnstat.llm.common import table
from urnstat.session import materialize


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that are bad or lose too much with them."""
    return quality.clean(docs)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that trees trained on the labels score too low go."""
    return boosting.keep_good(docs, boosting.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact or near copies stays, the one with the smallest id."""
    return simhash.deduplicate(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their places in training sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", clean_lines),
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", drop_copies),
    ("best-fit packing", pack_sequences),
]

#: Trained trees and tokens are beyond SQL; the tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
