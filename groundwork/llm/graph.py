"""Connected components by alternating large and small stars, in DataFrame operations only.

A large star hangs every greater neighbour of a node on the least node around it, a small star does the same for the
lesser ones. Minima are combined before they move, and written, so that their join to the links is one that the planner
broadcasts or whose large partitions it splits: a hub costs as much as its links, and not in one task. Every round is
written to the shared folder, which cuts the lineage.

Defined cases: links from a node to itself, and links with a null end, are ignored; repeated links count once;
without links there are no components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import Workspace


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """links: a, b of one orderable type. Returns node, root: the least node of its component, for all linked nodes."""
    work = Workspace(links.sparkSession, name)
    stars = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    stars, turn, seen = work.write(stars, "0"), 0, None
    while True:
        both = stars.select("a", "b").union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = work.write(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{turn}-large")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = work.write(large, f"{turn}-links")
        least = work.write(large.groupBy("a").agg(F.min("b").alias("m")), f"{turn}-small")
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        turn += 1
        stars = work.write(small, str(turn))
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        work.drop(*(f"{turn - 1}{x}" for x in ("", "-large", "-links", "-small")))
        if now == seen:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = now
