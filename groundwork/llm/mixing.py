"""Mixing sources to target weights.

Every document gets a hash-random key. The keys' range is cut into equal buckets, as many per source as its rows
need, so a source with a third of all rows is sorted by many tasks. Token counts are summed per bucket, bucket sums
are accumulated within each source, and inside a bucket a running sum completes the prefix; the mix takes every
source's documents in key order up to its exact budget, running through the source again where the budget exceeds it.

The tables of sources (one row each) and of buckets (one row per BUCKET_ROWS documents) are all that is ever sorted
in one task; neither is sent to the driver. Keys are a function of doc_id and text, so reruns agree, and rows that share
an id (or have none) are spread like others.

Defined cases: a null or blank text has size zero, is taken zero words, and never moves a cut; a null source is a
source of its own, after all others; rows that repeat doc_id, source and text count and are taken as separate rows, in any order among themselves; an empty table gives an
empty mix; extra columns pass through, and working columns take names that none of them has.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from groundwork.llm.common import Workspace, map_batches, text_bytes

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2
BUCKET_ROWS = 2_000


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_key, size (words in the text): the text is read once and does not travel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "source": b.column("source"), "text_key": b.column("text_key"), "size": pa.array([len(x.split()) for x in text_bytes(b)], pa.int64())})

    plain = docs.selectExpr("cast(doc_id as long) doc_id", "cast(source as string) source", "xxhash64(cast(text as string)) text_key", "cast(text as string) text")
    return map_batches(plain, run, "doc_id long, source string, text_key long, size long")


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source_key, source_size, n_rows, target: shares of the whole by weight, none above `most` times its source.

    With the sources in order of size per weight, those below some point stop at their bound and the rest share what
    is left by weight; the point is the first source that its share of what is left does not fill.
    """
    by_source = sized.groupBy(source_key(F.col("source")).alias("source_key")).agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    i = F.row_number().over(Window.orderBy("source_key")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (i % len(weights) + 1).cast("int"))
    w = Window.orderBy(F.col("bound") / F.col("weight"), "source_key")
    t = by_source.withColumn("weight", weight).withColumn("bound", F.col("source_size") * most)
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(Window.partitionBy()) * share - F.coalesce(F.sum("bound").over(before), F.lit(0))
    t = t.withColumn("rate", left / F.sum("weight").over(after)).withColumn("open", F.col("rate") <= F.col("bound") / F.col("weight"))
    rate = F.min(F.when(F.col("open"), F.struct(F.col("bound") / F.col("weight"), "source_key", "rate"))).over(Window.partitionBy())["rate"]
    full = F.col("bound").cast("double")
    return t.select("source_key", "source_size", "n_rows", F.coalesce(F.least(F.col("weight") * rate, full), full).alias("target"))


def source_key(source: Column) -> Column:
    """A non-null key in the sources' order: by code point, null last."""
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source))


def random_key(seed: int) -> Column:
    return F.expr(f"shiftrightunsigned(xxhash64({seed}L, doc_id, text_key), 1)")


def mix(sized: DataFrame, rows: DataFrame | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 7) -> DataFrame:
    """`rows` (by default `sized`) with source_size, target and taken: words the mix takes of a row, repeats counted.

    `rows` has doc_id, source, text_key and size, and may carry texts; the sums are formed from `sized` alone, without texts.
    The tables of sources and of buckets are written, so that the planner knows their real sizes: it broadcasts them up
    to its limit, and does not shuffle the rows by source, only by bucket.
    """
    rows, work = sized if rows is None else rows, Workspace(sized.sparkSession, "mix-sums")
    t = work.write(targets(sized, weights, share, most).withColumn("n_buckets", F.ceil(F.col("n_rows") / BUCKET_ROWS)), "sources")
    bucket = F.least(F.floor(F.col("mix_key") / F.lit(float(2**63)) * F.col("n_buckets")), F.col("n_buckets") - 1)

    def dealt(df: DataFrame) -> DataFrame:
        keyed = df.withColumns({"mix_source": source_key(F.col("source")), "mix_key": random_key(seed)})
        return keyed.join(t, keyed.mix_source == t.source_key).drop("source_key").withColumn("mix_bucket", bucket)

    in_buckets = dealt(sized).groupBy("mix_source", "mix_bucket").agg(F.sum("size").alias("bucket_size"))
    so_far = Window.partitionBy("mix_source").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = work.write(in_buckets.select("mix_source", "mix_bucket", F.coalesce(F.sum("bucket_size").over(so_far), F.lit(0)).alias("bucket_start")), "buckets")
    within = Window.partitionBy("mix_source", "mix_bucket").orderBy("mix_key", "doc_id", "text_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt(rows).join(starts, ["mix_source", "mix_bucket"]).withColumn("before", F.col("bucket_start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(0)
    rest = budget - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return placed.withColumn("taken", taken.cast("long")).drop("mix_source", "mix_bucket", "mix_key", "n_rows", "n_buckets", "bucket_start", "before", "text_key")


def first_words(text: bytes, n: int) -> bytes:
    """The first n words, with what stands before and between them."""
    at = 0
    for m in re.finditer(rb"[^\x20\x09-\x0D]+", text):
        if n == 0:
            break
        at, n = m.end(), n - 1
    return text[:at]


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 7) -> DataFrame:
    """The mix itself: rows of docs, once for each epoch that takes them whole; a row that a cut divides comes once more,
    with the first words up to the budget (and n_chars, if docs has it, of that text). Rows taken zero words go."""
    work = Workspace(docs.sparkSession, "mix")
    fields = docs.schema.fields
    at = {f.name: i for i, f in enumerate(fields)}

    def with_size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at["text"]).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len((x or b"").split()) for x in texts], pa.int64())], names=[*b.schema.names, "size"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, taken = b.column(len(fields)).to_pylist(), b.column(len(fields) + 1).to_pylist()
            whole = [i for i, (s, t) in enumerate(zip(size, taken, strict=True)) if s for _ in range(t // s)]
            rows = pa.RecordBatch.from_arrays(b.columns[: len(fields)], names=b.schema.names[: len(fields)])
            yield rows.take(pa.array(whole, pa.int64()))
            if part := [(i, t % s) for i, (s, t) in enumerate(zip(size, taken, strict=True)) if s and t % s]:
                some = rows.take(pa.array([i for i, _ in part], pa.int64()))
                columns = list(some.columns)
                texts = [first_words(x, n).decode() for x, (_, n) in zip(some.column(at["text"]).cast(pa.binary()).to_pylist(), part, strict=True)]
                columns[at["text"]] = pa.array(texts, some.schema.field(at["text"]).type)
                if "n_chars" in at:
                    columns[at["n_chars"]] = pa.array([len(x) for x in texts], some.schema.field(at["n_chars"]).type)
                yield pa.RecordBatch.from_arrays(columns, names=some.schema.names)

    sized = work.write(sizes(docs), "sizes")
    names = [f"c{i}" for i in range(len(fields))]  # no clash with working columns
    rows = map_batches(docs, with_size, StructType([*fields, StructField("size", LongType())])).toDF(*names, "size")
    rows = rows.withColumns({"doc_id": F.col(names[at["doc_id"]]).cast("long"), "source": F.col(names[at["source"]]).cast("string"), "text_key": F.xxhash64(F.col(names[at["text"]]).cast("string"))})
    taken = mix(sized, rows, weights, share, most, seed).where("taken > 0").select(*names, "size", "taken")
    return map_batches(taken, cut, docs.schema)
