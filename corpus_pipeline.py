"""A corpus pipeline of five stages, from documents to token files.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps with the columns
of documents; the last returns a row for each document read back from the token files.
Every stage's result is written as Parquet and reread as the next one's input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, mixing, near_copies, quality, tokens
from tessera.llm.queries import table, tokenizer_path
from tessera.llm.shared import discard, materialize, ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    ship(spark)
    return quality.keep_accepted(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies stays."""
    ship(spark)
    return near_copies.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their source's weight asks for."""
    ship(spark)
    return mixing.mix_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids go to files; a row for each document, as read back."""
    ship(spark)
    return tokens.write_and_read(docs, tokenizer_path())


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("mixing_sources", mixing_sources),
    ("token_output", token_output),
]

#: None: SQL has neither the fingerprints nor the tokenizer; tests/llm compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        read, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(read)
    return STAGES[-1][1](spark, docs, sf_dir)
