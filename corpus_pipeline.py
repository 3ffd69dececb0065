"""From documents to packed training sequences, in stages that each read what the one before wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelcast.llm import langid, mixing, packing, simhash, substring
from panelcast.llm.common import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without letters, null texts among them, go."""
    return langid.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies: the one with the smallest doc_id, a null one before all."""
    return simhash.drop_near_duplicates(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the passages that an earlier one has; those of which nothing is left go."""
    return substring.remove_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as each pass of the mix takes them; a document taken twice is there twice, with the words of each pass."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences: bin, capacity, used, and of each piece the row (doc_id, hash of its text, copy), first word and length."""
    return packing.sequences(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("mix_sources", mix),
    ("pack", pack),
]

#: The stages learn, hash and draw at random; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again; a stage's table goes when the next is written.

    Extra columns of documents are carried to the last stage; an empty table gives no rows.
    """
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    before = None
    for name, stage in STAGES:
        docs = folder.table(stage(spark, docs, sf_dir), name)
        if before:
            folder.delete(before)
        before = name
    return docs
