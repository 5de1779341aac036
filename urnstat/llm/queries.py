"""Registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from urnstat.llm import boosting, byte_bpe, chat_tree, context_tree, embeddings, main_text, packing, prefix_trie, quality, repair, simhash, url_filter, warc
from urnstat.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.digest(table(spark, sf_dir, "pages"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(table(spark, sf_dir, "documents"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boosting.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_tree.digest(table(spark, sf_dir, "conversations"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damaged_digests(table(spark, sf_dir, "conversations"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_main_text": op2_main_text,
    "op3_simhash": op3_simhash,
    "op4_url_filter": op4_url_filter,
    "op5_packing": op5_packing,
    "op6_context_tree": op6_context_tree,
    "op7_embeddings": op7_embeddings,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_warc": op9_warc,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_chat_tree": op11_chat_tree,
    "op12_repair": op12_repair,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality.oracle_sql(),
    "op4_url_filter": url_filter.oracle_sql(),
    "op7_embeddings": embeddings.oracle_sql(),
    "op9_warc": warc.oracle_sql(),
    "op11_chat_tree": chat_tree.oracle_sql(),
    "op13_prefix_trie": prefix_trie.oracle_sql(),
}
