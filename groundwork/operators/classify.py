"""Classification and filtering of records, and ordered first-wins dedupe."""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions import fixed
from groundwork.functions.text import blank, canonical_rs, col, trim


@dataclass(frozen=True)
class RecordFilter:
    min_stars: int = 2
    types: tuple[str, ...] = ("single nucleotide variant",)
    drop_somatic: bool = True
    assembly: str = "GRCh38"


def ordinal(c: Column | str, table: dict[str, int] = fixed.REVIEW_STARS, unknown: int = -1) -> Column:
    """A status as a number, whatever its case and the blanks around it."""
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, F.lower(trim(c))), F.lit(unknown)).cast("int")


def significance(c: Column | str, names: tuple[str, str, str] = ("pathogenic", "benign", "vus")) -> Column:
    """vus where the text says so, even if it is conflicting as well; else one of two labels if it reads as just that one; else other."""
    s = F.lower(trim(F.coalesce(col(c), F.lit(""))))
    vus = s.contains("uncertain significance") | s.contains("uncertain risk")
    plain = ~s.contains("conflicting")
    first, second = plain & s.contains("pathogenic"), plain & s.contains("benign")
    return F.when(vus, names[2]).when(first & ~second, names[0]).when(second & ~first, names[1]).otherwise("other")


def precedence(c: Column | str, last_word: tuple[str, ...], veto: tuple[str, ...], first: str, second: str, names: tuple[str, str, str]) -> Column:
    """The same rule over other words: any of last_word wins; unless vetoed, first or second if not both."""
    s = F.lower(trim(F.coalesce(col(c), F.lit(""))))
    has = lambda xs: F.exists(F.array(*map(F.lit, xs)), lambda x: s.contains(x))
    one, two = ~has(veto) & s.contains(first), ~has(veto) & s.contains(second)
    return F.when(has(last_word), names[2]).when(one & ~two, names[0]).when(two & ~one, names[1]).otherwise("other")


def alleles(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit("")).rlike(r"\A[ACGT]+\z")


def one_gene(c: Column | str) -> Column:
    gene = F.coalesce(col(c), F.lit(""))
    return ~gene.contains(";") & ~gene.isin("", "-")


def usable_text(c: Column | str, least: int = 100) -> Column:
    text = trim(F.coalesce(col(c), F.lit("")))
    return ~text.isin("", "-") & (F.length(text) >= least)


def timestamps(c: Column | str) -> Column:
    formats = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MMM dd, yyyy", "MMM d, yyyy", "yyyy/MM/dd", "MM/dd/yyyy")
    return F.coalesce(*(F.try_to_timestamp(col(c), F.lit(f)) for f in formats))


def after(c: Column | str, cutoff: datetime.date | str) -> Column:
    """Strictly after the cutoff; a missing date is not."""
    return F.coalesce(col(c) > F.lit(str(cutoff)).cast("timestamp_ntz"), F.lit(False))


def first_wins(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row for each key: the first in a stated order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("first_wins_rank", rank).where("first_wins_rank = 1").drop("first_wins_rank")


def filter_records(raw: DataFrame, spec: RecordFilter = RecordFilter(), order: str = "ordinal") -> DataFrame:
    """Records of the wanted assembly, type, stars, label and alleles, renamed and typed, the first of each id in file
    order (column `order`), then those of one gene. Twenty-two columns, whether rows are left or not."""
    rows = raw.where((F.col("Assembly") == spec.assembly) & F.lower("Type").isin(*spec.types))
    rows = rows.withColumn("review_stars", ordinal("ReviewStatus")).where(F.col("review_stars") >= spec.min_stars)
    rows = rows.withColumn("label", significance("ClinicalSignificance")).where(F.col("label") != "other")
    if spec.drop_somatic:
        rows = rows.where(~F.lower(F.coalesce("Origin", F.lit(""))).contains("somatic"))
    rows = rows.where(alleles("ReferenceAlleleVCF") & alleles("AlternateAlleleVCF"))
    rows = rows.withColumnsRenamed(fixed.RECORD_NAMES)
    rows = rows.withColumns({"rsid": canonical_rs("rsid"), "last_evaluated": timestamps("last_evaluated"), "pos": F.col("pos").try_cast("long")})
    names = [fixed.RECORD_NAMES.get(c, c) for c in fixed.RECORD_COLUMNS]
    return first_wins(rows, ["variation_id"], [order]).where(one_gene("gene")).select(*names, "review_stars", "label")


def with_comment(records: DataFrame, comments: DataFrame, key: str = "variation_id", comment_key: str = "VariationID", text: str = "sanitized") -> DataFrame:
    """The evidence gate: records with a comment of which something is left."""
    return records.join(comments.where(~blank(text)).select(F.col(comment_key).alias(key)), key, "left_semi")


def gate_counts(before: DataFrame, after_gate: DataFrame, label: str = "label") -> DataFrame:
    """label, n_before, n_after."""
    tagged = before.select(label, F.lit(1).alias("b"), F.lit(0).alias("a")).unionAll(after_gate.select(label, F.lit(0), F.lit(1)))
    return tagged.groupBy(label).agg(F.sum("b").alias("n_before"), F.sum("a").alias("n_after"))
