"""From records to passages: search, ordered dedupe, fetch, parse, and a cache by key.

A key is a gene, an rs number and a number of pages; records share it. Keys that the cache lacks go through one task, since
the service allows so many requests a second and no more, whatever the cluster's size; payloads are parsed in the JVM, by all
tasks. A key whose requests fail becomes a row with `error`, is not cached, and is tried again next time.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundwork.functions.text import cache_key, not_blank_or
from groundwork.operators import entities
from groundwork.sources import artifacts
from groundwork.sources.rest import GAP_S, Client

PASSAGES = "passage_id string, pmid string, section string, text string, `order` int, year int, journal string, genes array<string>, gene_ids array<string>, rsids array<string>, hgvs array<string>, diseases array<string>, position long"


def keyed(records: DataFrame, pages: int) -> DataFrame:
    return records.withColumn("key", cache_key("gene", F.coalesce("rsid", F.lit("")), pages))


def requested(keys: DataFrame, transport: str, pages: int, gap_s: float = GAP_S) -> DataFrame:
    """key, payload_no, payload, error of (key, gene, rsid): the papers of the rs number, then those of the gene, each once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        module, _, name = transport.partition(":")
        client = Client(getattr(importlib.import_module(module), name), gap_s)
        for pdf in frames:
            out = []
            for key, gene, rsid in pdf.itertuples(index=False):
                try:
                    queries = [*([rsid] if rsid else []), f"@GENE_{gene}"]
                    ids = list(dict.fromkeys(x for q in queries for x in client.search(q, pages)))
                    got = list(client.fetch(ids))
                    out += [(key, i, x, None) for i, x in enumerate(got or [""])]  # a key without papers is an answer as well
                except Exception as e:  # a row of its own, with its key
                    out.append((key, 0, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["key", "payload_no", "payload", "error"])

    return keys.select("key", "gene", not_blank_or("rsid", "").alias("rsid")).coalesce(1).sortWithinPartitions("key").mapInPandas(run, "key string, payload_no int, payload string, error string")


def parsed(answers: DataFrame) -> DataFrame:
    """key and the passages of its payloads, with their position in it."""
    rows = entities.passages(entities.documents(answers.where("payload is not null"), keep=["key", "payload_no"]), keep=["key", "payload_no", "doc_no"])
    place = F.col("payload_no").cast("long") * 2**40 + F.col("doc_no").cast("long") * 2**20 + F.col("order")
    return rows.withColumn("position", place).drop("payload_no", "doc_no")


def corpus(spark: SparkSession, records: DataFrame, cache: str, transport: str | None, pages: int = 1, gap_s: float = GAP_S) -> dict[str, DataFrame]:
    """passages: variation_id and the unfiltered passages of its key, in order `position`; errors: variation_id, error.
    Without a transport, only what is cached counts, and `missing` has the records of other keys."""
    records = keyed(records, pages)
    keys = records.groupBy("key").agg(F.first("gene").alias("gene"), F.first("rsid").alias("rsid"))
    have = artifacts.cached_keys(spark, cache)
    errors = spark.createDataFrame([], "key string, error string")
    if transport is not None:
        # written before it is used, so that the requests are made once
        artifacts.write_parquet(requested(keys.join(have, "key", "left_anti"), transport, pages, gap_s), f"{cache}/answers")
        answers = artifacts.read_parquet(spark, f"{cache}/answers")
        artifacts.append_cache(parsed(answers), answers.where("error is null").select("key").distinct(), cache)
        errors, have = answers.where("error is not null").select("key", "error"), artifacts.cached_keys(spark, cache)
    found = artifacts.read_cached(spark, cache, PASSAGES)
    own = records.select("variation_id", "key")
    return {"passages": own.join(found, "key").drop("key"), "errors": own.join(errors, "key").select("variation_id", "error"), "missing": own.join(have, "key", "left_anti").select("variation_id")}

