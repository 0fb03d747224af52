"""Balanced samples in a reproducible random order, which any SQL engine can repeat: by digests of seed and id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions.text import mixed_key


class TooFew(ValueError):
    """Not enough rows of a label for the sample asked for."""


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.withColumn("shuffle_key", mixed_key(seed, key))


def _enough(counts: DataFrame, labels: tuple[str, ...], wanted: int, what: str) -> None:
    found = {r[0]: r[1] for r in counts.collect()}  # a row for each label
    for x in labels:
        if found.get(x, 0) < wanted:
            raise TooFew(f"only {found.get(x, 0)} {x} {what}; {wanted} are needed")


def balance(df: DataFrame, target: int, labels: tuple[str, ...], cap: int | None = 5, seed: int = 0, key: str = "variation_id", group: str = "gene", label: str = "label", check: bool = True) -> DataFrame:
    """target // 2 rows of each label, with up to `cap` of a group and label. The planner limits ranks before rows move."""
    rows = shuffled(df.where(F.col(label).isin(*labels)), key, seed)
    if cap:
        rows = rows.withColumn("in_group", F.row_number().over(Window.partitionBy(group, label).orderBy("shuffle_key", key))).where(F.col("in_group") <= cap).drop("in_group")
    each = target // 2
    if check:
        _enough(rows.groupBy(label).count(), labels, each, "rows are left")
    ranked = rows.withColumn("in_label", F.row_number().over(Window.partitionBy(label).orderBy("shuffle_key", key)))
    return ranked.where(F.col("in_label") <= each).drop("in_label", "shuffle_key")


def balance_paired(df: DataFrame, target: int, labels: tuple[str, ...], seed: int = 0, key: str = "variation_id", group: str = "gene", label: str = "label", check: bool = True) -> DataFrame:
    """Two rows of each of (target // 2) // 2 groups for each label: the groups come in the order of their first row."""
    rows = shuffled(df.where(F.col(label).isin(*labels)), key, seed)
    w = Window.partitionBy(group, label)
    pairs = rows.withColumns({"in_group": F.row_number().over(w.orderBy("shuffle_key", key)), "of_group": F.count("*").over(w)}).where("of_group >= 2 and in_group <= 2")
    wanted = (target // 2) // 2
    if check:
        _enough(pairs.where("in_group = 1").groupBy(label).count(), labels, wanted, "groups have two rows")
    firsts = pairs.where("in_group = 1").withColumn("place", F.row_number().over(Window.partitionBy(label).orderBy("shuffle_key", key))).where(F.col("place") <= wanted)
    return pairs.join(firsts.select(group, label), [group, label], "left_semi").drop("in_group", "of_group", "shuffle_key")


def head(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The first n rows in a stated order; 0 is all."""
    return df.orderBy(*order).limit(n) if n else df


def sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    return shuffled(df, key, seed).orderBy("shuffle_key", key).limit(n).drop("shuffle_key")
