"""Delimited dumps: two tab-separated formats that differ in quoting, and an ordinal for their file order.

The ordinal is the file order within one dump file. A gzip file is one split, so with `parts` its rows are dealt out anew as
soon as they are numbered.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from groundwork.functions import fixed
from groundwork.functions.text import nulls, trim
from groundwork.operators.classify import timestamps, usable_text


class MissingColumns(KeyError):
    """The dump has changed."""


def download(fetch: Callable[[], Iterable[bytes]], dest: str, force: bool = False) -> str:
    """Stages chunks of bytes as a file, unless it is there; it gets its name when it is whole."""
    if force or not os.path.exists(dest):
        os.makedirs(os.path.dirname(dest) or ".", exist_ok=True)
        with open(f"{dest}.part", "wb") as f:
            for chunk in fetch():
                f.write(chunk)
        os.replace(f"{dest}.part", dest)
    return dest


def strings(names: Iterable[str]) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def read_records(spark: SparkSession, path: str, required: tuple[str, ...] = fixed.RECORD_COLUMNS, ordinal: str = "ordinal", parts: int | None = None) -> DataFrame:
    """All columns as strings, selected by name (an error names what is missing), null tokens as nulls, file order as `ordinal`."""
    raw = spark.read.csv(path, sep="\t", header=True, inferSchema=False, quote='"', escape='"', encoding="UTF-8")
    if missing := [c for c in required if c not in raw.columns]:
        raise MissingColumns(f"missing columns: {missing}")
    rows = raw.select(F.monotonically_increasing_id().alias(ordinal), *(nulls(F.col(f"`{c}`")).alias(c) for c in required))
    return rows.repartition(parts) if parts else rows


def comment_columns(spark: SparkSession, path: str, header: str = fixed.COMMENT_HEADER) -> list[str]:
    """Names from the first line that begins like the header, tab included: a line of prose begins alike."""
    line = spark.read.text(path).where(F.col("value").startswith(header)).first()
    if line is None:
        raise ValueError(f"no header line in {path}")
    return line[0].lstrip("#").split("\t")


def read_comments(spark: SparkSession, path: str, ids: DataFrame | None = None, least: int = 100, ordinal: str = "ordinal", parts: int | None = None) -> DataFrame:
    """Usable comments, of the given ids (column VariationID) if any: no quoting, comment lines and header skipped, kept columns as far as there are any."""
    names = comment_columns(spark, path)
    raw = spark.read.csv(path, sep="\t", schema=strings(names), comment="#", quote="", encoding="UTF-8").withColumn(ordinal, F.monotonically_increasing_id())
    raw = raw.repartition(parts) if parts else raw
    kept = [c for c in fixed.COMMENT_COLUMNS if c in names]
    rows = raw.select(ordinal, *(nulls(F.col(c)).alias(c) for c in kept)).withColumn("VariationID", trim("VariationID"))
    if ids is not None:
        rows = rows.join(ids.select(F.col("VariationID").cast("string")), "VariationID", "left_semi")
    rows = rows.where(usable_text("Description", least))
    return rows.withColumn("DateLastEvaluated", timestamps("DateLastEvaluated")) if "DateLastEvaluated" in kept else rows
