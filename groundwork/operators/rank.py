"""BM25 over many small pools at once.

Statistics belong to the pool. Only document frequencies and lengths are shuffled (combined per task before that, in one
pass); term frequencies are counted inside each row, for the query's terms alone. What is sorted by pool is ids, scores and
lengths: texts that a caller doesn't read from the result never move. Scores are rounded before they are compared, so a
sum's order never decides a tie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwork.functions import fixed
from groundwork.functions.text import col, tokens

PLACES = 9


def query_of(*parts: Column | str) -> Column:
    """The parts that are not empty, by blanks."""
    return F.concat_ws(" ", *(F.nullif(col(p).cast("string"), F.lit("")) for p in parts))


def pool_counts(docs: DataFrame, pool: str, terms: str) -> DataFrame:
    """pool, term, n (documents with it), n_terms; the row without a term counts the pool's documents and all their terms."""
    each = F.concat(F.transform(F.array_distinct(terms), lambda t: F.struct(t.alias("term"), F.lit(0).alias("n_terms"))), F.array(F.struct(F.lit(None).cast("string").alias("term"), F.size(terms).alias("n_terms"))))
    return docs.select(pool, F.explode(each).alias("e")).groupBy(pool, F.col("e.term").alias("term")).agg(F.count("*").alias("n"), F.sum("e.n_terms").alias("n_terms"))


def with_idf(counts: DataFrame, pool: str) -> DataFrame:
    """pool, term, n, idf of pool_counts; a negative idf becomes a share of the pool's mean idf."""
    sizes = counts.where("term is null").select(pool, F.col("n").alias("n_docs"))
    raw = counts.where("term is not null").join(sizes, pool).withColumn("raw", F.log(F.col("n_docs") - F.col("n") + 0.5) - F.log(F.col("n") + 0.5))
    mean = raw.groupBy(pool).agg(F.avg("raw").alias("mean_idf"))
    return raw.join(mean, pool).select(pool, "term", "n", F.when(F.col("raw") < 0, fixed.EPSILON * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))


def term_statistics(docs: DataFrame, pool: str, terms: str) -> DataFrame:
    """pool, term, n (documents with it), idf."""
    return with_idf(pool_counts(docs, pool, terms), pool)


def bm25(docs: DataFrame, queries: DataFrame, pool: str, doc: str, text: str, level: str | None = None, query: str = "query") -> DataFrame:
    """docs with score, bm25_chars (the text's length) and rank (from 1) in their pool: by score, level (nearest first), then doc. queries: pool, query.

    A query term counts as often as it is repeated. A pool whose texts have no tokens scores 0 throughout.
    """
    t = docs.withColumn("bm25_terms", tokens(F.coalesce(col(text), F.lit(""))))
    counts = pool_counts(t, pool, "bm25_terms")
    stats = with_idf(counts, pool)
    lengths = counts.where("term is null").select(pool, (F.col("n_terms") / F.col("n")).alias("bm25_mean_length"))
    asked = queries.select(pool, F.explode(tokens(query)).alias("term")).groupBy(pool, "term").agg(F.count("*").alias("times"))
    terms = asked.join(stats, [pool, "term"]).groupBy(pool).agg(F.array_sort(F.collect_list(F.struct("term", "times", "idf"))).alias("bm25_query"))
    rows = t.join(lengths, pool).join(terms, pool, "left")
    size, mean = F.size("bm25_terms"), F.col("bm25_mean_length")

    def part(q: Column) -> Column:
        tf = F.size(F.filter("bm25_terms", lambda x: x == q["term"]))
        return F.when(tf > 0, q["times"] * q["idf"] * tf * (fixed.K1 + 1) / (tf + fixed.K1 * (1 - fixed.B + fixed.B * size / mean))).otherwise(0.0)

    score = F.coalesce(F.aggregate(F.transform("bm25_query", part), F.lit(0.0), lambda s, x: s + x), F.lit(0.0))
    near = level_order(level) if level else F.lit(0)
    order = Window.partitionBy(pool).orderBy(F.desc(F.round("score", PLACES)), near, doc)
    return rows.withColumns({"score": score, "bm25_chars": F.length(col(text))}).withColumn("rank", F.row_number().over(order)).drop("bm25_terms", "bm25_query", "bm25_mean_length")


def level_order(level: Column | str) -> Column:
    """0 for the nearest level; unknown ones come last."""
    out = F.when(F.lit(False), 0)
    for i, name in enumerate(fixed.LEVELS):
        out = out.when(col(level) == name, i)
    return out.otherwise(len(fixed.LEVELS))
