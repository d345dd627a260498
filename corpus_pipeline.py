"""Corpus pipeline over ``documents``; each stage reads what the one before has kept.

Stages: quality rules, exact dedup (of equal texts the largest doc_id stays),
n-gram Jaccard join (five words, similarity 0.8 or more; of a component the
smallest doc_id stays), sampling to target weights, packing.  All but the last
return rows with the columns of ``documents``.

Edge cases, of every stage: an empty table gives an empty table; a null text
counts as empty; rows are judged one by one, so repeated rows and rows that share
a key or have none are rows of their own (of equal rows the dedup stages keep
one); further columns are carried along whatever their names, and a clash with a
name of an operator changes nothing.  Empty texts fail the quality rules.  Null
source or language counts as ``other`` in the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowsieve.llm import common, exact_dedup, fertility, mixing, ngram_join, packing
from flowsieve.session import ship_package
from flowsieve.sources.tables import table

#: Near copies share at least this part of their distinct shingles of so many words.
SHINGLE_WORDS, LEAST_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return fertility.drop_rejected(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return ngram_join.drop_near_copies(docs, n=SHINGLE_WORDS, percent=LEAST_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return mixing.sample(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.with_crc(packing.pack(docs)).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard_join", near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: Token ids cannot be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None
