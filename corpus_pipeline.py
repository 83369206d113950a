"""The training-data pipeline: each stage's function takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quern.llm import language, mixing, packing, simhash, substring
from quern.llm.common import shared_dir
from quern.llm.queries import tokenizer_path
from quern.session import table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language (no text, no letter) go; a null lang is filled in.
    Profiles are learned from the documents whose lang is given."""
    return language.identified(docs, language.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least doc_id. Near copies are
    those whose SimHash fingerprints are connected over at most 3 differing bits, confirmed by a Jaccard
    similarity of 0.5 or more in shingles of five words, and those of 0.8 or more by any fingerprint."""
    return simhash.deduplicated(docs, radius=3)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of 50 words that an earlier document holds are cut from the text."""
    return substring.deduplicated(docs, window=50)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, or go, as the mix of sources takes them."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all pieces of all documents in sequences of 2048 tokens."""
    return packing.packed(docs, tokenizer_path(), length=2048, end=0)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: Learned profiles, fingerprints and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
