"""Corpus pipeline: from documents to the token ids of a mixed, cleaned training set.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. The result is
written as Parquet and read again as the next stage's docs. All stages but the
last return the columns of documents.

1. toxicity: documents that score 0.5 or more go.
2. line_dedup: repeated lines go from the texts; documents stay.
3. jaccard_join: of each group of near copies the smallest doc_id stays.
4. mixing: documents are repeated or left out so that sources meet their
   targets, in order of training time.
5. bpe: doc_id, n_tokens and ids of every reading of a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kvloom.llm import bpe, jaccard_join, line_dedup, mixing, toxicity
from kvloom.llm.common import materialize, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.remove_toxic(docs, table(spark, sf_dir, "labels"))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one_per_component(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_ids(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("line_dedup", remove_repeated_lines),
    ("jaccard_join", remove_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Trees, near copies and merges are beyond SQL; tests compare the pipeline with a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
