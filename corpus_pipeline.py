"""The corpus pipeline: language ID, line dedup, near-dedup, mixing and encoding of `documents`, each stage written as Parquet and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vexil.llm import common, langid, linededup, minhash, mixing, pieces

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null and empty texts among them. Long texts are judged whole, repeated rows alike; an empty table stays empty."""
    return langid.keep_identified(docs)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on too large a share of a source's documents go; the documents stay, repeated and null ids too. Null texts stay null; an empty table stays empty."""
    return linededup.clean_documents(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of least doc_id stays; of equal rows one stays, and documents without words or id stay."""
    return minhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate asks for, copies as rows of their own. A null source is a source; repeated ids share a draw; empty texts are taken like others."""
    return mixing.mix(docs, number=None)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the token ids of each document; copies are cut anew. Null texts have no ids, long ones all of theirs."""
    return pieces.encode(docs, ["doc_id", "lang", "source"])


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identified),
    ("line_dedup", without_boilerplate),
    ("near_dedup", one_of_each),
    ("mixing", mixed),
    ("encoding", encoded),
]

#: Language profiles, min-max hashing and merge-dropout aren't SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. A stage's result is written before the tables that it was made of, and the result before it, are removed, so shared storage holds two
    stages' documents at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    begin = common.mark()
    for name, stage in STAGES:
        docs = common.stash(stage(spark, docs, sf_dir), name)
        common.drop_since(spark, begin)
    return docs
