"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from odflux.llm import bpe, chat, kneser_ney, langid, negatives, ngram_join, packing, pii, quality_rules, sharding, spotsigs, trie, warc
from odflux.llm._common import table


def op1_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), shards=8)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents"))


def op4_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_tool_call_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_all(table(spark, sf_dir, "conversations"))


def op6_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


def op7_length_bucket_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = warc.round_trip(table(spark, sf_dir, "pages"))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured", "place")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_vantage_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.trie(table(spark, sf_dir, "conversations"))


def op13_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_feistel_sharding, op2_quality_rules, op3_ngram_jaccard_join, op4_kneser_ney_quality, op5_tool_call_chats, op6_spot_signatures, op7_length_bucket_packing, op8_warc_index, op9_byte_bpe, op10_language_id, op11_vantage_negatives, op12_prefix_trie, op13_skip_chain_pii)}


def oracle_sql() -> dict[str, str]:
    return {"op1_feistel_sharding": sharding.oracle(), "op3_ngram_jaccard_join": ngram_join.oracle(), "op5_tool_call_chats": chat.oracle(), "op8_warc_index": warc.oracle(), "op11_vantage_negatives": negatives.oracle(), "op12_prefix_trie": trie.oracle()}
