"""Near-dedup of whole word-shingle sets: SimHash proposes, exact Jaccard similarity decides, and no link is lost.

Three bits of a fingerprint find copies with few edits; similarity 0.8 allows for about ten bits, more than any chain of
segments could single out. So `simhash`'s pigeonring search gives the first candidates, and those it can't see meet by
prefix filtering: with shingles ordered from rare to frequent, two sets of similarity >= t share one of the first
|x| - ceil(t |x|) + 1. Frequencies are exact (of 48 bits of hash: a collision adds candidates, it loses none); shingles of one text
are no keys, since nobody shares them.

Two bounds prune candidates before sets are compared, both on the symmetric difference, which may be (1 - t) / (1 + t) of
both sizes together: unshared shingles are in it, and so are the bits in which two odd sketches (a bit flips with each
shingle that hashes to it) differ. The first splits into a slack of each item, so a group's items without a possible
partner go before any pair is formed.

Equal sets are one item. Of a shingle's group, the least item and the one with most slack are compared with all others;
components are formed, and only what is left in different components is compared in pairs that pass both bounds.

Style: Arrow batches for shingles, over chunks that are written once, so texts are never shuffled; DataFrame operations for the rest.

Defined cases: words and case as in `simhash`; with fewer words than a shingle the whole sequence is the one shingle;
null and blank texts have the empty set and are alike, and a null text is the same row as an empty one of its doc_id;
shingles are 64 bits of hash; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import Workspace, map_batches, release
from groundwork.llm.exchange import Chunks, Table, added, part_of, received
from groundwork.llm.graph import connected_components
from groundwork.llm.simhash import KEY_LIMIT, SEED, in_slices, links_within, majority, shingle_hashes, signed

WORDS, THRESHOLD = 5, 0.8
LAST = 2**63 - 1
#: Longs of an odd sketch: a power of two, with about two bits for each shingle.
LEAST_LONGS, MOST_LONGS = 4, 64
TYPES = {"doc_ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64()), "data": pa.binary()}
SCHEMA = "doc_ids array<long>, lengths array<long>, data binary"


def build(ids: list, texts: list[bytes]) -> dict[str, object]:
    return {"doc_ids": ids, "lengths": [len(x) for x in texts], "data": b"".join(texts)}


def texts_of(row: dict, which: list[int] | None = None) -> list[bytes]:
    ends = np.cumsum(row["lengths"]).tolist()
    return [row["data"][ends[i] - row["lengths"][i] : ends[i]] for i in (range(len(ends)) if which is None else which)]


def shingles_of(texts: list[bytes], words: int) -> Iterator[tuple[np.ndarray, int]]:
    """The distinct shingles of each text, sorted, and its fingerprint."""
    for group in in_slices(texts):
        hashes, cuts = shingle_hashes(group, words, SEED)
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield np.unique(hashes[a:b]), majority(hashes[a:b]) if b > a else 0


def short(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(16)


def question_of(row: dict, words: int, parts: int) -> Table:
    """How many texts of a chunk have a shingle; equal sets count once."""
    sets = {x.tobytes(): x for x, _ in shingles_of(texts_of(row), words)}
    keys, n = np.unique(np.concatenate([short(x) for x in sets.values()]), return_counts=True)
    return {"part": part_of(keys << np.uint64(16), parts), "key": keys, "n": n}


def odd_sketch(x: np.ndarray) -> np.ndarray:
    """Each shingle flips a bit. The first half of a sketch, xor the second, is that of half the size."""
    longs = min(MOST_LONGS, max(LEAST_LONGS, 1 << (len(x) // 32).bit_length()))
    flips = np.bincount((x & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.uint64)


def lists(parts: list[np.ndarray], kind: type) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).view(kind) if parts else np.empty(0, kind)))


def apart(a: Column, b: Column) -> Column:
    """Bits in which two odd sketches differ, at the smaller one's size; none where that is less than half of the other's."""
    half = lambda x: F.zip_with(F.slice(x, F.lit(1), F.floor(F.size(x) / 2).cast("int")), F.slice(x, F.floor(F.size(x) / 2).cast("int") + 1, F.floor(F.size(x) / 2).cast("int")), lambda p, q: p.bitwiseXOR(q))
    a, b = F.when(F.size(a) > F.size(b), half(a)).otherwise(a), F.when(F.size(b) > F.size(a), half(b)).otherwise(b)
    return F.coalesce(F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, n: s + n), F.lit(0))


def classes_of(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, limit: int = KEY_LIMIT) -> DataFrame:
    """doc_id, text_key, component_id for every row of docs."""
    work = Workspace(docs.sparkSession, "jaccard")
    with Chunks(docs, work, build, TYPES, SCHEMA) as chunks:
        return _classes(work, chunks, words, threshold, limit)


def _classes(work: Workspace, chunks: Chunks, words: int, threshold: float, limit: int) -> DataFrame:
    spark, parts = work.spark, chunks.parts
    often = chunks.ask(None, lambda row, _: question_of(row, words, parts), added(("key",), ("n",)), lambda _, rows, __: {"answer": {"n": rows["n"]}}, "often").answers
    share = (1 - threshold) / (1 + threshold)

    def described(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        n_of, key = received(right.to_pylist(), "often")["n"], question_of(row, words, parts)["key"]
        out: dict[str, list] = {k: [] for k in ("text_key", "item", "n", "slack", "fp", "prefix", "odd")}
        for text, (x, fp) in zip(texts := texts_of(row), shingles_of(texts, words), strict=True):
            n = n_of[np.searchsorted(key, short(x))].astype(np.int64)
            head = np.lexsort((x, n))[: len(x) - math.ceil(threshold * len(x) - 1e-9) + 1 if len(x) else 0]
            own = int((n == 1).sum())
            for k, v in zip(out, (xxhash.xxh64_intdigest(text, 42), xxhash.xxh64_intdigest(x.tobytes()), len(x), share * len(x) - own, fp, x[head[n[head] > 1]], odd_sketch(x)), strict=True):
                out[k].append(v)
        longs = {k: pa.array(signed(np.array(out[k], np.uint64)), pa.int64()) for k in ("text_key", "item", "fp")}
        return pa.table({
            "chunk": pa.array([row["chunk"]] * len(texts), pa.int64()), "place": pa.array(range(len(texts)), pa.int32()), "doc_id": pa.array(row["doc_ids"], pa.int64()), **longs,
            "n": pa.array(out["n"], pa.int32()), "slack": pa.array(out["slack"], pa.float64()), "prefix": lists(out["prefix"], np.int64), "odd": lists(out["odd"], np.int64),
        })

    schema = "chunk long, place int, doc_id long, text_key long, item long, fp long, n int, slack double, prefix array<long>, odd array<long>"
    rows = work.write(chunks.with_answers(often, described, schema), "rows")
    work.drop("often")
    place = F.struct("chunk", "place")
    items = work.write(rows.groupBy("item").agg(F.min(place).alias("at"), *(F.first(c).alias(c) for c in ("n", "slack", "fp", "prefix", "odd")), F.min("doc_id").alias("first")), "items")
    release(spark)

    def named(s: str) -> DataFrame:
        return items.select(F.col("item").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n", "slack", "odd", "at")))

    alike = F.col("slack_a") + F.col("slack_b") >= F.abs((F.col("n_a") - share * F.col("n_a") + F.col("slack_a")) - (F.col("n_b") - share * F.col("n_b") + F.col("slack_b"))) - 1e-6
    near = apart(F.col("odd_a"), F.col("odd_b")) <= share * (F.col("n_a") + F.col("n_b")) + 1e-6

    def sets(left: pa.Table, right: pa.Table) -> pa.Table:
        asked = sorted((r["place"], r["item"]) for r in right.to_pylist())
        found = [x for r in left.to_pylist() for x, _ in shingles_of(texts_of(r, [p for p, _ in asked]), words)] if asked else []
        return pa.table({"item": pa.array([i for _, i in asked], pa.int64()), "set": lists(found, np.int64)})

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """Links a, b among pairs a, b: the sets of their items are made again where the texts are."""
        pairs = work.write(pairs, f"{name}-pairs")
        needed = pairs.select(F.col("a").alias("item")).union(pairs.select("b")).distinct().join(items.select("item", "at"), "item").select("at.chunk", "at.place", "item")
        of = work.write(chunks.with_answers(needed, sets, "item long, set array<long>"), f"{name}-sets")
        for s in "ab":
            pairs = pairs.join(of.select(F.col("item").alias(s), F.col("set").alias(f"set_{s}")), s)
        common = F.size(F.array_intersect("set_a", "set_b"))
        out = work.write(pairs.where(common / (F.size("set_a") + F.size("set_b") - common) >= threshold).select("a", "b"), name)
        work.drop(f"{name}-pairs", f"{name}-sets")
        release(spark)
        return out

    # candidates by fingerprint: links between fingerprints, and between the items of one fingerprint
    of_fp = work.write(items.groupBy("fp").agg(F.min("item").alias("item")), "fingerprints")
    by_fp = links_within(of_fp.select("fp"), work, limit)
    for s in "ab":
        by_fp = by_fp.join(of_fp.select(F.col("fp").alias(s), F.col("item").alias(f"item_{s}")), s)
    same_fp = items.select("item", "fp").join(of_fp.withColumnRenamed("item", "other"), "fp").where("item <> other").select("item", "other")
    # candidates by shared rare shingles: stars
    shared = work.write(items.select("item", "n", "slack", "odd", F.explode("prefix").alias("h")), "shared")
    groups = shared.groupBy("h").agg(F.count("*").alias("size"), F.max("slack").alias("most"), F.min("item").alias("lo"), F.max_by("item", "slack").alias("hi")).where("size > 1 and most > -1e-6").drop("size")
    groups = work.write(groups, "groups")
    viable = work.write(shared.join(groups, "h").where("slack + most > -1e-6"), "viable")
    work.drop("shared")
    stars = viable.select("item", F.explode(F.array("lo", "hi")).alias("hub")).where("item <> hub")
    every = same_fp.union(by_fp.select("item_a", "item_b")).union(stars).select(F.least("item", "other").alias("a"), F.greatest("item", "other").alias("b")).distinct()
    every = every.join(named("a"), "a").join(named("b"), "b").where(alike & near).select("a", "b")
    links = verified(every, "first")

    nodes = connected_components(links, "jaccard-first")
    rooted = work.write(viable.select("h", "item", "n", "slack", "odd").join(nodes, viable.item == nodes.node, "left").select("h", "item", "n", "slack", "odd", F.coalesce("root", "item").alias("root")), "rooted")
    work.drop("viable")
    open_ = work.write(rooted.groupBy("h").agg(F.min("root").alias("least"), F.max("root").alias("greatest")).where("least <> greatest").select("h"), "open")
    left = work.write(rooted.join(open_, "h", "left_semi"), "left")
    x, y = (left.select("h", F.col("item").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n", "slack", "odd", "root"))) for s in "ab")
    pairs = x.join(y, "h").where((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & alike & near).select("a", "b").distinct()
    links = links.union(verified(pairs, "rest"))

    nodes = connected_components(links, "jaccard-components")
    of_item = work.write(items.join(nodes, F.col("item") == F.col("node"), "left").select("item", "first", F.coalesce("root", "item").alias("root")), "roots")
    least = of_item.groupBy("root").agg(F.min("first").alias("component_id"))
    out = work.write(rows.select("doc_id", "text_key", "item").join(of_item.join(least, "root").select("item", "component_id"), "item"), "classes")
    work.drop("rows", "items", "rooted", "left", "open", "groups", "fingerprints", "first", "rest", "roots")
    return out
