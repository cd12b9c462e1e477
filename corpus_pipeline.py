"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallymix.llm import exact_dedup, line_crf, mixing, ngram_join, packing
from tallymix.llm.common import documents
from tallymix.workspace import Workspace


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and consist mostly of content lines."""
    return line_crf.keep(docs, line_crf.train(docs, documents(spark, sf_dir, "labels")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return ngram_join.keep(docs, n=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixing.mixture(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, memo_words=500_000)  # workers of the other stages share the executors' memory


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # a fitted sequence model and a tokenizer have no SQL; tests/llm/test_pipeline.py has the brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all sequences. Every stage's result is written and read again."""
    ws, docs = Workspace(spark), documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = ws.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
