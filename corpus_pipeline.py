"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes the documents its predecessor kept and returns the documents it keeps, with the columns of
``documents``; the last returns one row per packed piece. Every stage is written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scalemetrics.llm import minhash, mixing, packing, quality_rules, toxicity
from scalemetrics.llm.common import table
from scalemetrics.llm.registry import query
from scalemetrics.workspace import settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go.

    Null and empty texts have no words, so the chain's bias decides and they stay; a table without labels rejects nothing. Repeated rows are
    judged each; columns named like results stay the documents' own. An empty table stays empty.
    """
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def within_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the fences of their language and source go.

    Null, empty and short texts fail (fewer than 50 words); a null language or source is a group of its own; ties with a fence stay.
    Repeated rows count and are judged each, and an empty table stays empty.
    """
    return quality_rules.filter_documents(docs)


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest id.

    Texts without words and rows without id link with nothing and stay. Of rows that repeat the id that stays, the one with the smallest
    checksum of its text stays, once. An empty table stays empty.
    """
    return minhash.one_of_each_group(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix of sources takes it.

    A null source is a source, the last one; texts without words have size 0 and never come in. Equal rows share their draw and
    are taken together; ties in rank are ordered by id and text. An empty table stays empty.
    """
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their places in sequences.

    Null and empty texts are one piece with the end id; null ids stay null; repeated rows are packed each. A text of any
    length is cut into pieces of a sequence's capacity. An empty table gives no rows.
    """
    return packing.packed_documents(docs, packing.word_tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("quality_rules", within_rules),
    ("minhash", one_per_group),
    ("mixing", mixed),
    ("packing", packed),
]

#: The classifier chain of the first stage is no SQL; tests run the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
