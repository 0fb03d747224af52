"""Line dedup [native]: later copies of repeated line runs are deleted.

A document is the sequence of its line-feed separated lines. Line ids are 128 bits of hash. Distributed prefix doubling
ranks the suffixes of all sequences together: by 1 line, then by 2, 4, ... lines from pairs of ranks, until every prefix
is unique; what is unique is discarded at once, since nothing can equal it. The ranks of each width are kept: together they
are the suffix array of all that repeats, and tell the longest common prefix of any two places by halving.

Ordered by the ranks, places with a common prefix of `min_lines` are an interval. With `min_words`, so are places with a
common prefix of fewer lines that have that many words. The first place of an interval, by doc_id and line number, stays. Every later one names a pair of places; pairs that only continue another one by a line are left out,
and the longest common prefix of the others is the maximal run that they begin. The later copies of the runs are deleted.

So a line goes exactly if it lies in `min_lines` consecutive lines, or in lines of `min_words` words, that stand at an earlier
place as well. Ranks come from counts of key ranges: no sort of all rows, no group collected in one task; frequent lines are
combined before they move, and joined by joins whose large partitions the planner splits.

Defined cases: a null text has no lines, stays null and removes nothing; an empty text is one empty line; rows with equal
doc_id and text are one document, and are returned alike; a null doc_id comes after all others; a document that loses all
its lines gets an empty text; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.llm.common import WORD, Workspace, free_name

MIN_LINES, MIN_WORDS = 3, 50
PLACE = ["line_doc", "line_text", "line_pos"]
DOC = PLACE[:2]
LAST = 2**63 - 1
#: Rows of a key range that one task orders, and ranges whose counts one task adds up.
RANGE_ROWS, BLOCK_RANGES = 50_000, 4096


def place_of(df: DataFrame) -> DataFrame:
    return df.withColumns({"line_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "line_text": F.xxhash64(F.lit(1), F.col("text").cast("string"))})


def line_rows(docs: DataFrame, depths: int) -> DataFrame:
    """PLACE, x, y (the line's id) and words: of the first 1, 2, ... lines from there on."""
    each = place_of(docs).where("text is not null").select(*DOC, F.posexplode(F.split("text", "\n")).alias("line_pos", "line"))
    rows = each.select(*PLACE, F.xxhash64("line").alias("x"), F.xxhash64(F.lit(2), "line").alias("y"), F.regexp_count("line", F.lit(WORD)).cast("long").alias("n_words")).distinct()
    if depths == 0:
        return rows.select(*PLACE, "x", "y", F.array().cast("array<bigint>").alias("words"))
    by_place = Window.partitionBy(*DOC).orderBy("line_pos")
    return rows.select(*PLACE, "x", "y", F.array(*(F.sum("n_words").over(by_place.rowsBetween(0, i)) for i in range(depths))).alias("words"))


def ranked(rows: DataFrame, work: Workspace, name: str, spread: Callable[[Column], Column]) -> tuple[DataFrame, int]:
    """PLACE, words and rank, from 1: of the keys (x, y) that occur twice or more, in order. spread: a half key as a fraction of its range."""
    keys = work.write(rows.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").select("x", "y"), f"{name}-keys")
    n = keys.count()
    part = lambda key, parts: F.least(F.floor(spread(F.col(key)) * parts), F.lit(parts - 1))
    cut = keys.withColumns({"part": part("x", max(1, -(-n // RANGE_ROWS))), "sub": part("y", 64)})
    so_far = lambda w, of: F.coalesce(F.sum(of).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = cut.groupBy("part", "sub").agg(F.count("*").alias("n_keys"))
    of_part = sums.groupBy("part").agg(F.sum("n_keys").alias("n_part")).withColumn("block", F.floor(F.col("part") / BLOCK_RANGES))
    of_block = of_part.groupBy("block").agg(F.sum("n_part").alias("n_block")).withColumn("block_start", so_far(Window.orderBy("block"), "n_block"))  # a row for RANGE_ROWS * BLOCK_RANGES keys
    of_part = of_part.withColumn("in_block", so_far(Window.partitionBy("block").orderBy("part"), "n_part")).join(of_block, "block").select("part", (F.col("block_start") + F.col("in_block")).alias("part_start"))
    start = sums.withColumn("sub_start", so_far(Window.partitionBy("part").orderBy("sub"), "n_keys")).join(of_part, "part").select("part", "sub", (F.col("part_start") + F.col("sub_start")).alias("start"))
    in_part = F.row_number().over(Window.partitionBy("part", "sub").orderBy("x", "y"))
    numbers = cut.join(start, ["part", "sub"]).select("x", "y", (F.col("start") + in_part).alias("rank"))
    out = work.write(rows.join(numbers, ["x", "y"]).select(*PLACE, "words", "rank"), name)
    work.drop(f"{name}-keys")
    return out, n


def ahead(ranks: DataFrame, step: int) -> DataFrame:
    """x: the rank, y: the rank `step` lines on; places without such a rank go."""
    then = Window.partitionBy(*DOC).orderBy("line_pos").rangeBetween(step, step)
    return ranks.withColumn("y", F.first("rank").over(then)).where("y is not null").withColumnRenamed("rank", "x")


def suffix_ranks(docs: DataFrame, depths: int, work: Workspace) -> list[DataFrame]:
    """The ranks of all repeated prefixes of 1, 2, 4, ... lines."""
    lines = work.write(line_rows(docs, depths), "lines")
    ranks, n = ranked(lines, work, "ranks-0", lambda h: h.cast("double") / F.lit(2.0**64) + F.lit(0.5))
    work.drop("lines")
    out = []
    while n:
        out.append(ranks)
        ranks, n = ranked(ahead(ranks, 1 << len(out) - 1), work, f"ranks-{len(out)}", lambda r, high=n: (r - 1) / F.lit(float(high)))
    return out


def prefixes(levels: list[DataFrame], depth: int) -> DataFrame | None:
    """PLACE, words, x, y: a key for each repeated prefix of `depth` lines, from one or two overlapping ranks."""
    k = depth.bit_length() - 1
    if k >= len(levels):
        return None
    return levels[k].withColumnRenamed("rank", "x").withColumn("y", F.lit(0).cast("long")) if depth == 1 << k else ahead(levels[k], depth - (1 << k))


def later_places(levels: list[DataFrame], min_lines: int, min_words: int | None, work: Workspace) -> DataFrame:
    """PLACE and, as first_doc, first_text, first_pos, the first place of its interval: for every place that isn't first."""
    found = []
    for depth in range(1 if min_words is not None else min_lines, min_lines + 1):
        rows = prefixes(levels, depth)
        if rows is None:
            break
        if depth < min_lines:
            rows = rows.where(F.get(F.col("words"), depth - 1) >= min_words)
        # minima are combined before they move; written, they are no part of the plan that joins the rows
        first = work.write(rows.groupBy("x", "y").agg(F.min(F.struct(*PLACE)).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), f"first-{depth}")
        later = rows.join(first, ["x", "y"]).where(F.struct(*PLACE) > F.col("first"))
        found.append(later.select(*PLACE, F.col("first.line_doc").alias("first_doc"), F.col("first.line_text").alias("first_text"), F.col("first.line_pos").alias("first_pos")))
    none = work.spark.createDataFrame([], "line_doc long, line_text long, line_pos int, first_doc long, first_text long, first_pos int")
    for x in found:
        none = none.union(x)
    return none


def maximal_runs(levels: list[DataFrame], later: DataFrame) -> DataFrame:
    """DOC, line_pos, last: the run that each pair of places begins which doesn't continue another pair by a line."""
    alignment = [*DOC, "first_doc", "first_text", F.col("line_pos") - F.col("first_pos")]
    before = F.lag("line_pos").over(Window.partitionBy(*alignment).orderBy("line_pos"))
    pairs = later.withColumn("before", before).where("before is null or before < line_pos - 1").drop("before").withColumn("common", F.lit(0))
    for k in reversed(range(len(levels))):  # the longest common prefix, by halves
        at = lambda s, k=k: levels[k].select(*(F.col(c).alias(f"{c}_{s}") for c in (*PLACE, "rank")))
        a, b = at("a"), at("b")
        pairs = pairs.join(a, (F.col("line_doc") == a.line_doc_a) & (F.col("line_text") == a.line_text_a) & (F.col("line_pos") + F.col("common") == a.line_pos_a), "left")
        pairs = pairs.join(b, (F.col("first_doc") == b.line_doc_b) & (F.col("first_text") == b.line_text_b) & (F.col("first_pos") + F.col("common") == b.line_pos_b), "left")
        pairs = pairs.select(*PLACE, "first_doc", "first_text", "first_pos", (F.col("common") + F.when(F.col("rank_a") == F.col("rank_b"), 1 << k).otherwise(0)).alias("common"))
    return pairs.select(*PLACE, (F.col("line_pos") + F.col("common") - 1).alias("last"))


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """line_doc, line_text, runs: the runs of lines, as (start, end), that are later copies; runs that touch are one."""
    work = Workspace(docs.sparkSession, "lines")
    levels = suffix_ranks(docs, min_lines - 1 if min_words is not None else 0, work)
    found = work.write(maximal_runs(levels, work.write(later_places(levels, min_lines, min_words, work), "later")), "maximal")
    by_place = Window.partitionBy(*DOC).orderBy("line_pos", "last")
    reached = F.max("last").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    joined = found.withColumn("new", F.coalesce(F.col("line_pos") > reached + 1, F.lit(True)).cast("int"))
    runs = joined.withColumn("run", F.sum("new").over(by_place.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*DOC, "run").agg(F.min("line_pos").alias("start"), F.max("last").alias("end"))
    out = work.write(runs.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("runs")), "runs")
    work.drop("later", "maximal", *(f"first-{i}" for i in range(1, min_lines + 1)), *(f"ranks-{i}" for i in range(len(levels) + 1)))
    return out


def names_for(docs: DataFrame) -> dict[str, str]:
    """The names that dedup_lines gives its own columns: with underscores before a name that docs has."""
    return {n: free_name(docs, n) for n in ("n_lines", "n_removed", "n_runs")}


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """docs with text replaced by the kept lines, and n_lines, n_removed, n_runs (with underscores before a name that docs has)."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # no clash with working columns
    given = dict(zip([c.lower() for c in docs.columns], names, strict=True))
    runs = repeated_runs(docs.select("doc_id", "text"), min_lines, min_words)
    rows = docs.toDF(*names).withColumns({"doc_id": F.col(given["doc_id"]), "text": F.col(given["text"]).cast("string")})
    rows = place_of(rows).join(runs.hint("shuffle_hash"), ["line_doc", "line_text"], "left")
    lines = F.split("text", "\n")
    # what stands between the runs is cut out whole, so a text takes time in proportion to its lines, however many runs it has
    after = lambda i: F.coalesce(F.get(F.col("runs"), i - 1)["end"] + 1, F.lit(0))
    until = lambda i, x: F.coalesce(F.get(F.col("runs"), i)["start"], F.size(x))
    between = lambda x: F.transform(F.sequence(F.lit(0), F.size("runs")), lambda i: F.slice(x, after(i) + 1, until(i, x) - after(i)))
    kept = F.when(F.col("runs").isNull(), F.col("text")).otherwise(F.transform(F.array(lines), lambda x: F.array_join(F.flatten(between(x)), "\n"))[0])
    removed = F.coalesce(F.aggregate("runs", F.lit(0), lambda s, r: s + r["end"] - r["start"] + 1), F.lit(0))
    counts = {
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"),
        "n_removed": removed.cast("long"),
        "n_runs": F.when(F.col("runs").isNull(), 0).otherwise(F.size("runs")).cast("long"),
    }
    own = [(kept if c == given["text"] else F.col(c)).alias(name) for c, name in zip(names, docs.columns, strict=True)]
    return rows.select(*own, *(x.alias(names_for(docs)[n]) for n, x in counts.items()))
