"""The training-text pipeline: documents in, token ids out.

Every stage takes (spark, docs, sf_dir) and works on all rows it is given; all but the last return the
columns of ``docs``, whatever further columns these have. Other tables are read from ``sf_dir``. An empty
table gives an empty one of the same columns at every stage, and texts may be of any length.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontaminate, ngram_join, pii, quality
from tidemark.llm.common import checkpoint, documents

TOKENIZER = "word_bpe_49k.json"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects.

    Null and empty texts are scored like others, as the empty text; rows that repeat all stay or all go; without
    labels every score is 1/2, below the cut, so nothing stays.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.only_good(docs, model)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of the document with the smallest id of each group of near duplicates.

    Rows that repeat become one. Rows without an id or without words are no near duplicates and all stay.
    """
    return ngram_join.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a benchmark item.

    Null and empty texts contain nothing and stay; rows that repeat all stay or all go; without items all stay.
    """
    return decontaminate.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by labels.

    Every row stays; null texts stay null; rows that repeat are changed alike.
    """
    return pii.sanitise(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the digests of ids and decoded text: a row for each row, no tokens for null and empty texts."""
    # Executors have grown by the last stage, so it remembers a quarter of the usual runs and takes half of the usual text at once.
    return bpe.encode(docs, public_tokenizers.path(TOKENIZER), ids=True, remember=1 << 15, most=1 << 20)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("n-gram jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("pii", hide_personal_data),
    ("bpe encoding and decoding", to_tokens),
]

#: SQL can express neither a fitted classifier nor BPE; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written before the next one reads it several times."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
