"""Corpus cleaning in stages; every stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from techatlas.llm import minhash, packing, spaced, spans, toxicity
from techatlas.llm.queries import tokenizer_path
from techatlas.llm.shared import table
from techatlas.session import materialize


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored toxic go; all others, empty ones too, stay as they are."""
    return toxicity.clean_rows(docs, table(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies (5-word shingles, similarity 0.8) stays."""
    return minhash.one_per_group(docs, size=5, percent=80)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences of repeated passages are cut from all but the first place; every document stays."""
    return spans.cut_rows(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with a benchmark item go."""
    return spaced.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest as token sequences of power-of-two lengths."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", without_toxic),
    ("near_copies", without_near_copies),
    ("repeated_passages", without_repeated_passages),
    ("benchmark", without_benchmark),
    ("packing", packed),
]

#: The stages learn a model, merge groups of any size and run a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
