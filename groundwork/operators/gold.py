"""Known-relevant papers and two-stage recall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.functions.text import cited_papers


def build_gold(comments: DataFrame, record: str, text: str, **patterns: str) -> DataFrame:
    """record, pmid: the distinct papers that any of its comments cites. Records that cite none have no row."""
    return comments.select(record, F.explode(cited_papers(text, **patterns)).alias("pmid")).distinct()


def score(gold: DataFrame, ranked: DataFrame, record: str = "record", paper: str = "pmid", rank: str = "rank", ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row: records with gold, gold and reachable papers, pool recall, and for each k the recall at k of what is
    reachable. Sums over all records; NaN where there is nothing to divide by. k counts passages."""
    records = gold.select(record).distinct()
    best = ranked.join(records, record, "left_semi").groupBy(record, paper).agg(F.min(rank).alias("best"))
    hits = gold.join(best, [record, paper], "left")
    ratio = lambda a, b: F.when(b == 0, float("nan")).otherwise(a / F.greatest(b, F.lit(1)))
    total, reach = F.count("*"), F.count("best")
    at = [ratio(F.count_if(F.col("best") <= k), reach).alias(f"recall_at_{k}") for k in ks]
    return hits.agg(F.countDistinct(record).alias("records"), total.alias("gold_papers"), reach.alias("reachable_papers"), ratio(reach, total).alias("pool_recall"), *at)


def recall_at_k(retrieved: DataFrame, relevant: DataFrame, key: list[str], doc: str, k: int | None = None, rank: str = "rank") -> DataFrame:
    """key, recall: relevant documents among the first k (0 or none: all); NaN without relevant ones is left to the caller's join."""
    top = retrieved.where(F.col(rank) <= k) if k else retrieved
    found = relevant.select(*key, doc).distinct().join(top.select(*key, doc, F.lit(1).alias("hit")).distinct(), [*key, doc], "left")
    return found.groupBy(*key).agg((F.count("hit") / F.count("*")).alias("recall"))
