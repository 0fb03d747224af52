"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from groundwork.llm import ann, bpe, chat, katz, lines, mixing, quality, repeats, simhash, urls
from groundwork.llm.common import Workspace, table
from groundwork.llm.oracle import ORACLE

RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.find(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=lines.MIN_WORDS)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "role", "text")
    return chat.digests(chat.format_turns(rows.unionByName(extra)))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 20 = 0"), 20, "vec_id", "embedding")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = Workspace(spark, "mixing").write(mixing.sizes(table(spark, sf_dir, "documents")), "sizes")
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", "taken", "source")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of the mix: sizes and targets. Which words are taken depends on the hash that orders them."""
    return op7_mixing(spark, sf_dir).selectExpr("doc_id", "source", "size", "source_size", "round(target, 3) target")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    base = ~quality.keeps(rows.failed_mask, "base")
    return rows.withColumn("base_failed", base).withColumn("kept", quality.keeps(rows.failed_mask, "v1"))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of policy v1 does, from the masks alone."""
    return quality.ablations(quality.ledger(table(spark, sf_dir, "documents")), "v1")


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_suffix_dedup, op3_line_dedup, op4_chat, op5_ann, op6_url_filter, op7_mixing, op8_simhash, op9_quality, op10_katz, mixing_targets, quality_ablations)}
__all__ = ["ORACLE", "QUERIES"]
