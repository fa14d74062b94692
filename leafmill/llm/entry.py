"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import bpe, counting, langid, media, minhash, packing, quality, sharding, store, toxicity
from leafmill.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_read(table(spark, sf_dir, "documents"))


def op4_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op5_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op7_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.learn_and_judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = store.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return store.read_sums(spark, at)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_byte_bpe, op2_minhash_dedup, op3_progressive_jpeg, op4_byte_network, op5_best_two_fit, op6_bounded_ring, op7_unigram_counts, op8_quality_rules, op9_toxicity, op10_content_store)}


def oracle_sql() -> dict[str, str]:
    return {}
