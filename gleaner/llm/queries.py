"""The queries of this folder's operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gleaner.llm.bpe import bpe_round_trip
from gleaner.llm.common import documents, table
from gleaner.llm.conversations import damage, repair_digests
from gleaner.llm.decontaminate import contamination, judge
from gleaner.llm.line_dedup import line_digests
from gleaner.llm.lm import language_scores
from gleaner.llm.mih import nearest
from gleaner.llm.near_dedup import near_components
from gleaner.llm.quality import quality_classifier
from gleaner.llm.quality_rules import quality_rules
from gleaner.llm.substring_dedup import substring_dedup
from gleaner.llm.surrogates import with_surrogates
from gleaner.llm.token_counts import token_counts

#: A stand-in; a production run passes a secret of its own, kept outside the code.
SURROGATE_KEY = "gleaner surrogate key"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(contamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_surrogates(documents(spark, sf_dir), SURROGATE_KEY)


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digests(documents(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digests(damage(table(spark, sf_dir, "conversations")))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_bpe, op3_lm_score, op4_quality, op5_surrogates, op6_nearest, op7_near_dedup, op8_token_counts, op9_substring_dedup, op10_line_dedup, op11_conversation_repair, op12_quality_rules)}
