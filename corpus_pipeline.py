"""Corpus pipeline: from raw documents to the token ids of a mix without repeats.

Each stage takes (spark, docs, sf_dir), works on all that the one before it
kept, and returns a DataFrame.  All but the last return the columns of
``documents``.  Null texts fail the quality rules, so later stages only see
them when called on their own; each operator states what it does with them.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexiforge.llm import linededup, mixing, neardup, pieces, quality
from lexiforge.llm.common import staged


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines common on their source."""
    return quality.remove_common_lines(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines seen earlier; documents made only of such lines go."""
    return linededup.drop_repeated_lines(docs, min_exact=1)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8)."""
    return neardup.drop_near_duplicates(docs, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the SentencePiece ids and of the decoded text of each document."""
    return pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", rules),
    ("line dedup", lines),
    ("MinHash near-dedup", near_copies),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and read back, and its working tables removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Edit joins, MinHash candidates and SentencePiece ids have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None
