"""Training-data pipeline over ``documents``: rules, exact and near duplicates, mixing, tokens.

Each stage gets what its predecessor kept, as written Parquet, and its decisions take
effect.  All stages but the last return the columns of ``documents``.  A stage's result is
written before the next stage is called, which deletes the tables that the result was read
from.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from probatum.llm import bpe, exact_dedup, mixing, repetition, resemblance, simhash
from probatum.llm.queries import bpe_digests
from probatum.llm.shared import scope, sweep

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def after_the_last(stage: Stage) -> Stage:
    """The stage, after the tables that earlier stages have left are deleted."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(spark, docs)
        return stage(spark, docs, sf_dir)
    return run_stage


@after_the_last
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go."""
    return repetition.passing(docs)


@after_the_last
def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    with scope(spark) as tables:
        kept = exact_dedup.keep_first_copies(docs, exact_dedup.DigestIndex(spark, f"pipeline_digests_{uuid.uuid4().hex}", lasting=False))
        tables.keep(kept)
    return kept


@after_the_last
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more (five-word shingles) the one with the smallest id stays.

    Pairs come from SimHash fingerprints under covering masks first, and from prefixes of the
    sets where fingerprints are too far apart; every link is checked on the full sets.
    """
    return resemblance.one_of_each(docs, near=simhash.near_rows)


@after_the_last
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_rows(docs)


@after_the_last
def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the ids of each document, and digest of the text they decode to."""
    return bpe_digests(bpe.encode(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_duplicates),
    ("near dedup", near_duplicates),
    ("mixing", mix_sources),
    ("tokens", encode_tokens),
]

#: SQL has neither the similar pairs nor the tokenizer; tests compare with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scope(spark) as tables:
        for name, stage in STAGES:
            with scope(spark):
                found = stage(spark, docs, sf_dir)
                done, docs = docs, tables.written(found, name.replace(" ", "-"))
            tables.release(done)
        tables.keep(docs)
    return docs
