"""The registered queries of this subpackage, one for each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.bpe import encode
from tidemark.llm.chosen_path import deduplicate
from tidemark.llm.common import documents
from tidemark.llm.decontaminate import contained_items
from tidemark.llm.filter_audit import audit_filters
from tidemark.llm.fingerprints import fingerprint_documents
from tidemark.llm.language import identify_languages
from tidemark.llm.language_model import score_texts
from tidemark.llm.ngram_join import near_duplicates
from tidemark.llm.oracles import ORACLES
from tidemark.llm.pii import find_pii
from tidemark.llm.quality import classify_quality
from tidemark.llm.resample import resample
from tidemark.llm.secrets import find_secrets
from tidemark.llm.sharding import assign_shards

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(documents(spark, sf_dir), 8)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(documents(spark, sf_dir))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(documents(spark, sf_dir))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(documents(spark, sf_dir), public_tokenizers.path(PIECES))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(documents(spark, sf_dir))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op11_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(documents(spark, sf_dir))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = (
    op1_quality, op2_sharding, op3_fingerprints, op4_secrets, op5_ngram_join,
    op6_language_model, op7_language, op8_bpe, op9_pii, op10_decontamination,
    op11_chosen_path, op12_resampling, op13_filter_audit,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
