"""A corpus pipeline of the training-data operators: quality rules, line dedup, near-dedup, mixing, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from groundwork.llm import bpe, lines, mixing, quality, simhash
from groundwork.llm.common import Workspace


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.kept_documents(docs, "v1")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are deleted from the texts; n_chars follows. A document of which no visible character is left goes."""
    out, removed = lines.dedup_lines(docs, min_words=lines.MIN_WORDS), lines.names_for(docs)["n_removed"]
    out = out.where(f"{removed} = 0 or text rlike '[^\\\\x20\\\\x09-\\\\x0D]'")
    return out.selectExpr(*(f"if({removed} = 0, n_chars, cast(length(text) as long)) n_chars" if c == "n_chars" else f"`{c}`" for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8) stays: that with the smallest doc_id."""
    return simhash.one_of_each(docs, words=5, similarity=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken up to their budgets; a second epoch repeats rows, and the document at a cut is shortened to its budget."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text."""
    return bpe.encode(spark, docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("SimHash near-dedup", near_dedup), ("mixing", mix_sources), ("encoding", encode)]

#: SQL has no byte-level BPE; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work, docs = Workspace(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = work.write(stage(spark, docs, sf_dir), str(i))
        if i:
            work.drop(str(i - 1))
    return STAGES[-1][1](spark, docs, sf_dir)
