"""Approximate nearest neighbours by inner product: robust-pruned directed graphs in each shard, searched by beam.

Equal vectors are one node, which carries the smallest ids that any result list can need. Nodes are dealt into shards by
hash. A shard's nodes are cut into bands of nearly equal length, the longest first, and each band gets a graph: points are
inserted in batches, a greedy beam search proposes neighbours, and robust pruning keeps a neighbour unless a kept one is
closer to it by the factor ALPHA; reverse edges are pruned alike. Within a band the order by inner product is nearly that
by distance, which graphs can follow; over all lengths it isn't. What no edge reaches is chained to the entry.

How wide a beam a graph needs depends on the vectors. So each graph is tried with a sample of its shard's vectors against
brute force, and the beam is doubled until it finds TARGET of the neighbours. Where a beam of an eighth of the band doesn't,
as among thousands of near copies, the band is scanned: that is exact, and cheaper than so wide a beam.

Queries go to every shard in blocks, from band to band, and leave out bands whose longest vector can't reach what they
have found. The beam's nodes are scored in double precision on the original vectors, and the shards' best are merged.
Shards hold SHARD_ROWS vectors; more, up to MOST_ROWS, as soon as there are more shards than shuffle partitions, since each
query goes to each shard.

Style: Arrow groups for shards and (shard, block of queries) pairs, DataFrame operations for ids and for merging.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component take no part, and neither do
rows with a null id; vectors of other lengths are not compared; repeated rows count once; ties go to the smaller id; with
fewer candidates than asked for all are returned; an empty table gives an empty result; only the two columns are read;
float vectors stay float, all others are compared as double.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from groundwork.llm.common import Workspace, bounded_batches, partitions

SHARD_ROWS, MOST_ROWS, QUERY_GROUP = 8192, 1 << 17, 1 << 16
DEGREE, BEAM, ALPHA, BATCH = 32, 64, 1.2, 256
#: Open nodes of a beam that are expanded at once.
WIDTH = 4
#: Lengths in a band differ by this factor at most, unless it would have fewer nodes.
RATIO, LEAST_BAND = 1.2, 64
#: The share of the neighbours that a beam must find, and vectors that it is tried with.
TARGET, TRIED, SCAN = 0.95, 64, 8


def nearest_first(d: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k least of each row, in order."""
    if d.shape[1] > k:
        some = np.argpartition(d, k - 1, axis=1)[:, :k]
        return np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1)
    return np.argsort(d, axis=1, kind="stable")


def beam_search(points: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int, bias: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (-1: none) and -inner products of each query's beam, nearest first. bias: half the squared lengths, for an order by distance."""
    q, bias = len(queries), np.zeros(len(points), np.float32) if bias is None else bias
    seen = np.zeros((q, len(points) + 1), bool)
    seen[:, -1] = True  # where -1 points
    seen[:, entry] = True
    nodes = np.full((q, beam), -1, np.int32)
    dist = np.full((q, beam), np.inf, np.float32)
    nodes[:, 0], dist[:, 0] = entry, bias[entry] - queries @ points[entry]
    done = np.zeros((q, beam), bool)
    live = np.arange(q)
    wide = min(WIDTH, beam)
    while True:
        open_ = np.where(done[live] | (nodes[live] < 0), np.inf, dist[live])
        at = np.argpartition(open_, wide - 1, axis=1)[:, :wide]
        can = np.take_along_axis(open_, at, 1) < np.inf
        go = can.any(1)
        live, at, can = live[go], at[go], can[go]
        if not len(live):
            return nodes, dist
        done[live[:, None], at] |= can
        found = np.where(can[:, :, None], graph[nodes[live[:, None], at]], -1).reshape(len(live), -1)
        found.sort(axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        fresh = ~seen[live[:, None], found]
        seen[live[:, None], found] = True
        d = np.where(fresh, bias[found] - np.matmul(points[found], queries[live][:, :, None])[:, :, 0], np.inf).astype(np.float32)
        all_d, all_n = np.concatenate((dist[live], d), 1), np.concatenate((nodes[live], np.where(fresh, found, -1)), 1)
        all_done = np.concatenate((done[live], np.zeros(found.shape, bool)), 1)
        keep = nearest_first(all_d, beam)
        dist[live], nodes[live], done[live] = (np.take_along_axis(x, keep, 1) for x in (all_d, all_n, all_done))


def robust_prune(points: np.ndarray, of: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each row of candidates (-1: none) up to `degree` neighbours of the point `of`. Distances are formed from
    differences to that point, so they hold in a dense cluster as well."""
    candidates = np.where(candidates == of[:, None], -1, candidates)
    ordered = np.sort(candidates, axis=1)
    ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1  # repeats
    near = np.where(ordered < 0, np.inf, ((points[ordered] - points[of][:, None, :]) ** 2).sum(2))
    keep = np.argsort(near, axis=1, kind="stable")
    ordered, near = np.take_along_axis(ordered, keep, 1), np.take_along_axis(near, keep, 1)
    x = points[ordered] - points[of][:, None, :]
    square = (x**2).sum(2)
    between = square[:, :, None] + square[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
    out = np.full((len(of), degree), -1, np.int32)
    rows = np.arange(len(of))
    alive = np.isfinite(near)
    for k in range(degree):
        at = np.argmax(alive, axis=1)  # nearest first
        some = alive[rows, at]
        if not some.any():
            break
        out[some, k] = ordered[rows, at][some]
        alive &= ~(alpha * alpha * np.maximum(between[rows, at], 0) <= np.maximum(near, 0)) | ~some[:, None]
        alive[rows, at] = False
    return out


def build_graph(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, batch: int = BATCH) -> tuple[np.ndarray, int]:
    """Neighbours of each node (-1: none; the last column chains what is not reached otherwise) and the entry point."""
    n = len(vectors)
    points = (vectors / np.sqrt((vectors.astype(np.float64) ** 2).sum(1).max())).astype(np.float32)
    bias = (points**2).sum(1) / 2
    graph = np.full((n, degree + 1), -1, np.int32)
    entry = int(np.argmax(points @ points.mean(0)))
    order = np.concatenate(([entry], np.delete(np.arange(n), entry)))
    at = 1
    while at < n:
        new = order[at : at + max(1, min(batch, at // 2))]
        at += len(new)
        near, _ = beam_search(points, graph[:, :degree], entry, points[new], beam, bias)
        graph[new, :degree] = robust_prune(points, new, near, degree, alpha)
        to, by = graph[new, :degree].ravel(), np.repeat(new, degree)
        to, by = to[to >= 0], by[to >= 0]
        order_to = np.argsort(to, kind="stable")
        to, by = to[order_to], by[order_to]
        begin = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        much = np.diff(np.append(begin, len(to)))
        lo = 0
        while lo < len(begin):
            # as many heads at once as keep the matrices between their candidates small
            widest = degree + np.maximum.accumulate(much[lo : lo + 1024])
            hi = lo + max(1, int(np.searchsorted(np.arange(1, len(widest) + 1) * widest**2, 1 << 23)))
            heads, own = to[begin[lo:hi]], much[lo:hi]
            wide = np.full((len(heads), degree + int(own.max())), -1, np.int32)
            wide[:, :degree] = graph[heads, :degree]
            a, b = begin[lo], begin[hi] if hi < len(begin) else len(to)
            wide[np.repeat(np.arange(len(heads)), own), degree + np.arange(b - a) - np.repeat(begin[lo:hi] - a, own)] = by[a:b]
            room = (wide >= 0).sum(1) <= degree
            graph[heads[room], :degree] = -np.sort(-wide[room], axis=1)[:, :degree]
            if (~room).any():
                graph[heads[~room], :degree] = robust_prune(points, heads[~room], wide[~room], degree, alpha)
            lo = hi
    reached = np.zeros(n, bool)
    reached[entry] = True
    front = np.array([entry])
    while len(front):
        front = np.unique(graph[front])
        front = front[front >= 0]
        front = front[~reached[front]]
        reached[front] = True
    rest = np.flatnonzero(~reached)
    if len(rest):
        graph[np.concatenate(([entry], rest[:-1])), degree] = rest
    return graph, entry


def beam_for(points: np.ndarray, graph: np.ndarray, entry: int, tried: np.ndarray, k: int, target: float = TARGET) -> int:
    """The beam with which `tried` find `target` of their k largest inner products among points; 0 if none up to 1 / SCAN of them does."""
    k = min(k, len(points))
    scores = tried @ points.T
    least = np.partition(scores, len(points) - k, axis=1)[:, len(points) - k]
    beam = max(BEAM, k)
    while True:
        _, dist = beam_search(points, graph, entry, tried, min(beam, len(points)))
        if (-dist[:, :k] >= least[:, None] - 1e-6 * np.abs(least[:, None])).mean() >= target:
            return min(beam, len(points))
        beam *= 2
        if beam * SCAN > len(points):
            return 0


def scan(points: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """Nodes of each query's k largest inner products, and as many more, since these are in single precision."""
    scores, some = queries @ points.T, min(2 * k, len(points))
    return np.argpartition(scores, len(points) - some, axis=1)[:, len(points) - some :]


def bands_of(lengths: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of nearly equal lengths; these fall."""
    out, a, n = [], 0, len(lengths)
    while a < n:
        b = max(int(np.searchsorted(-lengths, -lengths[a] / RATIO, side="right")), a + LEAST_BAND)
        b = n if n - b < LEAST_BAND else b
        out.append((a, b))
        a = b
    return out


def build_bands(vectors: np.ndarray, k: int) -> tuple[np.ndarray, list[dict]]:
    """The order of the vectors by length, and for each band its range in it, longest length, graph, entry and beam."""
    lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
    order = np.argsort(-lengths, kind="stable")
    x, lengths = vectors[order].astype(np.float32), lengths[order]
    tried = vectors[:: max(1, len(vectors) // TRIED)][:TRIED].astype(np.float32)
    bands = []
    for a, b in bands_of(lengths):
        graph, entry = build_graph(x[a:b])
        bands.append({"from": a, "to": b, "longest": float(lengths[a]), "graph": graph.tobytes(), "entry": entry, "beam": beam_for(x[a:b], graph, entry, tried, k)})
    return order, bands


def search_bands(vectors: np.ndarray, bands: list[dict], queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (-1: none) and inner products, in double precision, of what each query finds; more than its k best."""
    x, y = vectors.astype(np.float32), queries.astype(np.float32)
    lengths = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
    nodes, scores = np.full((len(y), k), -1, np.int64), np.full((len(y), k), -np.inf)
    for band in bands:
        a, b = band["from"], band["to"]
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        ask = np.flatnonzero(lengths * band["longest"] * (1 + 1e-6) >= least)
        if not len(ask):
            continue
        graph = np.frombuffer(band["graph"], np.int32).reshape(-1, DEGREE + 1)
        found = beam_search(x[a:b], graph, band["entry"], y[ask], band["beam"])[0] if band["beam"] else scan(x[a:b], y[ask], k)
        exact = np.where(found < 0, -np.inf, np.matmul(vectors[a:b][found].astype(np.float64), queries[ask].astype(np.float64)[:, :, None])[:, :, 0])
        more_n, more_s = np.full((len(y), found.shape[1]), -1, np.int64), np.full((len(y), found.shape[1]), -np.inf)
        more_n[ask], more_s[ask] = np.where(found < 0, -1, found + a), exact
        nodes, scores = np.concatenate((nodes, more_n), 1), np.concatenate((scores, more_s), 1)
    return nodes, scores


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and x of the rows that take part, repeated rows once."""
    kind = df.schema[vector_col].dataType
    to = "array<float>" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "array<double>"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(to).alias("x")).where("id is not null and x is not null and size(x) > 0")
    sound = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return rows.where(sound & F.exists("x", lambda v: v != 0)).distinct()


def numbers(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def nodes_of(rows: DataFrame, most: int) -> DataFrame:
    """Distinct vectors with their `most` smallest ids: of equal vectors no list can hold more. The planner limits each group before it moves."""
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy("id"))).where(F.col("r") <= most)
    return first.groupBy("x").agg(F.sort_array(F.collect_set("id")).alias("ids"))


BANDS = "array<struct<`from`: int, `to`: int, longest: double, graph: binary, entry: int, beam: int>>"


def build_index(nodes: DataFrame, work: Workspace, k: int, shard_rows: int | None = None) -> DataFrame:
    """A row for each shard: dim, shard, its nodes (vectors and ids, by length) and bands."""
    n = nodes.count()
    shard_rows = shard_rows or min(MOST_ROWS, max(SHARD_ROWS, n // partitions(nodes.sparkSession)))
    shards = max(1, -(-n // shard_rows))
    kind = nodes.schema["x"].dataType.simpleString()

    def build(group: pa.Table) -> pa.Table:
        dim = group.column("dim")[0].as_py()
        x = numbers(group.column("x"), dim)
        order, bands = build_bands(x, k)
        ids = group.column("ids").combine_chunks().take(pa.array(order))
        band = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("longest", pa.float64()), ("graph", pa.binary()), ("entry", pa.int32()), ("beam", pa.int32())]))
        return pa.table({
            "dim": pa.array([dim], pa.int32()), "shard": pa.array([group.column("shard")[0].as_py()], pa.int64()), "vectors": pa.array([x[order].tobytes()], pa.binary()),
            "bands": pa.array([bands], band), "ids": pa.array([ids.to_pylist()], pa.list_(pa.list_(pa.int64()))),
        })

    dealt = nodes.select(F.size("x").alias("dim"), F.pmod(F.xxhash64("x"), F.lit(shards)).alias("shard"), F.col("x").cast(kind).alias("x"), "ids")
    return work.write(dealt.groupBy("dim", "shard").applyInArrow(build, f"dim int, shard long, vectors binary, bands {BANDS}, ids array<array<long>>"), "index")


def search(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query (a number of the distinct query vector), ids and score of the k best nodes of each shard. queries: query, x."""
    groups = max(1, -(-queries.count() // QUERY_GROUP))
    asked = queries.select("query", "x", F.size("x").alias("dim"), F.pmod("query", F.lit(groups)).alias("block"))
    shards = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    last = index.agg(F.max("shard")).first()[0] or 0
    to = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(last))))  # each query to each shard: the stated query set, in blocks

    def run(shard: pa.Table, block: pa.Table) -> pa.Table:
        empty = {"query": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "score": pa.array([], pa.float64())}
        if not shard.num_rows or not block.num_rows:
            return pa.table(empty)
        own = shard.to_pylist()[0]
        y = numbers(block.column("x"), own["dim"])
        x = np.frombuffer(own["vectors"], y.dtype).reshape(-1, own["dim"])
        numbered = block.column("query").to_numpy()
        least = np.array([i[0] for i in own["ids"]])
        of, ids, scores = [], [], []
        for a in range(0, len(y), BATCH):
            found, exact = search_bands(x, own["bands"], y[a : a + BATCH], k)
            for j, (f, s) in enumerate(zip(found, exact, strict=True)):
                best = [i for i in np.lexsort((least[f], -s))[:k].tolist() if f[i] >= 0]
                of += [int(numbered[a + j])] * len(best)
                ids += [own["ids"][f[i]] for i in best]
                scores += s[best].tolist()
        return pa.table({"query": pa.array(of, pa.int64()), "ids": pa.array(ids, pa.list_(pa.int64())), "score": pa.array(scores, pa.float64())})

    to = to.select(F.col("dim").alias("to_dim"), F.col("shard").cast("long").alias("to_shard"), F.col("block").cast("long").alias("to_block"), "query", "x")
    shards = shards.withColumn("block", F.col("block").cast("long"))
    return shards.groupBy("dim", "shard", "block").cogroup(to.groupBy("to_dim", "to_shard", "to_block")).applyInArrow(run, "query long, ids array<long>, score double")


def nearest(candidates: DataFrame, queries: DataFrame, k: int, id_col: str, vector_col: str, shard_rows: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries (of the same columns) its k nearest candidates of other ids."""
    work = Workspace(candidates.sparkSession, "ann")
    bounded_batches(candidates.sparkSession)
    nodes = work.write(nodes_of(usable(candidates, id_col, vector_col), k + 1), "nodes")
    index = build_index(nodes, work, k + 1, shard_rows)
    rows = work.write(usable(queries, id_col, vector_col).withColumn("query", F.xxhash64("x")), "queries")
    distinct = rows.select("query", "x").distinct()
    found = work.write(search(index, distinct, k + 1), "found")
    by_query = Window.partitionBy("query").orderBy(F.desc("score"), F.element_at("ids", 1))
    best = found.withColumn("r", F.row_number().over(by_query)).where(F.col("r") <= k + 1).drop("r")
    pairs = rows.select(F.col("id").alias("query_id"), "query").join(best, "query").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
