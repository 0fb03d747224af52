"""SimHash near-dedup with pigeonring filtering.

Fingerprints are seen as a ring of eight byte segments. If two differ in at most 3 bits, some segment starts a chain
whose first l segments differ in at most 3 * l / 8 bits in all, for every l: two equal segments, then at most one bit in
the next three, two in the next five, three in all. Keys of 32 equal bits follow from the chain's start (the two
segments, and two of the next three), so candidates meet by an equi-join key; the rest of the chain prunes them before
the full Hamming check. Nothing is lost, and no key collects what only shares a short prefix.

Within a key each fingerprint is visited once, as in a search over what is not yet reached: it yields a spanning forest,
not all pairs. Keys that more than KEY_LIMIT distinct fingerprints share are dealt out again by keys with more equal
bits (the remaining bits in four segments, one of which must be equal), without loss, until none is left.

With `similarity`, fingerprints only propose: exact Jaccard similarity of the shingles' sets decides, and pairs that no
three bits can show are found by `jaccard`, whose bounds prune what is compared.

Style: Arrow batches for fingerprints and candidate keys, DataFrame operations for all else. Only fingerprints, never
texts, are shuffled, and copies are combined before that.

Defined cases: a null or blank text has fingerprint zero and is linked like any other; with fewer words than a shingle
the whole sequence is the one shingle; repeated rows share their component, and of rows that repeat an id and a text (null and empty are one) one stays; a null doc_id never names a component unless
no other is in it (then null); an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.llm.common import Workspace, free_name, map_batches, text_bytes
from groundwork.llm.graph import connected_components

WORDS, SEED, MOST_BITS, KEY_LIMIT = 3, 42, 3, 20_000
SEGMENTS = 8
FULL = 2**64 - 1


#: The primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def xxh64(data: bytes, starts: np.ndarray, lengths: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of many slices of data at once: by array up to 31 bytes, by the library above that."""
    padded = data + bytes(8)
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,)).copy()
    out = np.full(len(starts), np.uint64(seed) + P5) + lengths.astype(np.uint64)
    at, left = starts.copy(), lengths.copy()
    short = lengths < 32
    for _ in range(3):
        i = np.flatnonzero(short & (left >= 8))
        out[i] = rotated(out[i] ^ rotated(eights[at[i]] * P2, 31) * P1, 27) * P1 + P4
        at[i] += 8
        left[i] -= 8
    i = np.flatnonzero(short & (left >= 4))
    out[i] = rotated(out[i] ^ (eights[at[i]] & np.uint64(0xFFFFFFFF)) * P1, 23) * P2 + P3
    at[i] += 4
    left[i] -= 4
    for _ in range(3):
        i = np.flatnonzero(short & (left >= 1))
        out[i] = rotated(out[i] ^ (eights[at[i]] & np.uint64(0xFF)) * P5, 11) * P1
        at[i] += 1
        left[i] -= 1
    out = (out ^ out >> np.uint64(33)) * P2
    out = (out ^ out >> np.uint64(29)) * P3
    out ^= out >> np.uint64(32)
    for i in np.flatnonzero(~short).tolist():
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + lengths[i]], seed)
    return out


def majority(hashes: np.ndarray) -> int:
    """A bit is set if more than half of the hashes have it set."""
    rows = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).view(np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(rows), 255):  # eight counts in a word, none of which overflows
        counts += np.add.reduce(rows[at : at + 255], axis=0).view(np.uint8)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def shingle_hashes(texts: list[bytes], words: int, seed: int) -> tuple[np.ndarray, list[int]]:
    """Hashes of the shingles of all texts, repeats included, and where each text's begin (and the last one's end)."""
    lines = [b" ".join(x.lower().split()) for x in texts]  # bytes.lower() changes A-Z only
    data = b" ".join(lines) + b" "
    spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    ends = np.cumsum([len(x) + 1 for x in lines]) - 1  # where each line's closing blank stands
    last = np.searchsorted(spaces, ends)
    starts, lengths, counts, first = [], [], [], 0
    for line, stop in zip(lines, last.tolist(), strict=True):
        if line:
            n = stop - first + 1
            begin = np.concatenate((spaces[first - 1 : first] + 1 if first else [0], spaces[first:stop] + 1))
            k = min(words, n)
            starts.append(begin[: n - k + 1])
            lengths.append(spaces[first + k - 1 : stop + 1] - starts[-1])
        counts.append(len(starts[-1]) if line else 0)
        first = stop + 1
    if not starts:
        return np.empty(0, np.uint64), [0] * (len(texts) + 1)
    hashes = xxh64(data, np.concatenate(starts).astype(np.int64), np.concatenate(lengths).astype(np.int64), seed)
    return hashes, np.concatenate(([0], np.cumsum(counts))).tolist()


def fingerprints(texts: list[bytes], words: int = WORDS, seed: int = SEED) -> list[int]:
    """64 bits for each text: the majority over the hashes of its shingles, repeats included."""
    hashes, cuts = shingle_hashes(texts, words, seed)
    return [majority(hashes[a:b]) if b > a else 0 for a, b in zip(cuts, cuts[1:], strict=False)]


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    return fingerprints([text], words, seed)[0]


def in_slices(texts: list[bytes], most: int = 1 << 20) -> Iterator[list[bytes]]:
    """Texts in groups of about `most` bytes, one text at least: arrays stay small."""
    group, held = [], 0
    for x in texts:
        group.append(x)
        held += len(x)
        if held >= most:
            yield group
            group, held = [], 0
    if group:
        yield group


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def segment(i: int) -> int:
    return 0xFF << (8 * (i % SEGMENTS))


def first_keys() -> list[tuple[int, int]]:
    """(rotation, mask of the bits that are equal): the start of a chain, with one of its third to fifth segments open."""
    return [(i, segment(i) | segment(i + 1) | sum(segment(i + 2 + j) for j in range(3) if j != free)) for i in range(SEGMENTS) for free in range(3)]


def finer_masks(mask: int) -> list[int]:
    """mask with one more of four segments of the bits it leaves open: at most 3 bits differ, so one segment is equal."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [free[len(free) * i // 4 : len(free) * (i + 1) // 4] for i in range(4)]
    return [mask | sum(1 << b for b in cut) for cut in cuts if cut]


def chain_masks(rotation: int) -> tuple[int, int]:
    upto = lambda n: sum(segment(rotation + j) for j in range(n))
    return upto(5), upto(7)


def forest(fps: np.ndarray, rotation: int, most: int = MOST_BITS) -> list[tuple[int, int]]:
    """Links that join what is linked among distinct fingerprints of one key. rotation < 0: no chain to check."""
    links: list[tuple[int, int]] = []
    left = np.arange(len(fps))
    five, seven = (np.uint64(x) for x in chain_masks(max(rotation, 0)))
    queue: list[int] = []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
        at = queue.pop()
        diff = fps[left] ^ fps[at]
        if rotation >= 0:
            viable = np.flatnonzero((np.bitwise_count(diff & five) <= 1) & (np.bitwise_count(diff & seven) <= 2))
            viable = viable[np.bitwise_count(diff[viable]) <= most]
        else:
            viable = np.flatnonzero(np.bitwise_count(diff) <= most)
        if len(viable):
            found = left[viable].tolist()
            links += [(int(fps[at]), int(fps[x])) for x in found]
            queue += found
            left = np.delete(left, viable)
    return links


def keyed(fps: DataFrame) -> DataFrame:
    """rotation, mask, value, fp for every first key of the distinct fingerprints fp."""
    keys = first_keys()
    masks = F.array(*(F.struct(F.lit(r).alias("rotation"), F.lit(m - 2**64 if m >> 63 else m).alias("mask")) for r, m in keys))
    return fps.select("fp", F.explode(masks).alias("k")).select("k.rotation", "k.mask", F.col("fp").bitwiseAND(F.col("k.mask")).alias("value"), "fp")


def search(rows: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by mask, value, fp. Gives links (kind 0: a, b), and keys above the limit dealt out again (kind 1: rotation, a mask, b value, fp)."""

    def finer(mask: int, fps: np.ndarray) -> Iterator[tuple]:
        for m in finer_masks(mask & FULL):
            yield signed(np.full(len(fps), m, np.uint64)), signed(fps & np.uint64(m)), signed(fps)

    def out(kind: int, a, b, fp) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(a), kind, np.int32)), "a": pa.array(a), "b": pa.array(b), "fp": pa.array(fp)})

    key, parts, held, over = None, [], 0, False

    def close() -> Iterator[pa.RecordBatch]:
        if held < 2 and not over:
            return
        fps = np.concatenate(parts)
        if over:
            for x in finer(key[1], fps):
                yield out(1, *x)
        elif links := forest(fps, key[0]):
            a, b = signed(np.array([x[0] for x in links], np.uint64)), signed(np.array([x[1] for x in links], np.uint64))
            yield out(0, a, b, a)

    for batch in rows:
        rotation, mask, value, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        if not len(fp):
            continue
        fp = fp.view(np.uint64)
        cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(fp)]))
        # a key of one row inside the batch has no partner
        busy = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(fp)))
        for s, e in zip(starts[busy].tolist(), ends[busy].tolist(), strict=True):
            now = (int(rotation[s]), int(mask[s]), int(value[s]))
            if now != key:
                if key is not None:
                    yield from close()
                key, parts, held, over = now, [], 0, False
            parts.append(fp[s:e])
            held += e - s
            if held > limit:
                over = True
                for x in finer(key[1], np.concatenate(parts)):
                    yield out(1, *x)
                parts = [np.empty(0, np.uint64)]
    if key is not None:
        yield from close()


def links_within(fps: DataFrame, work: Workspace, limit: int = KEY_LIMIT) -> DataFrame:
    """a, b: links that join all distinct fingerprints (column fp) within MOST_BITS of each other."""
    rows, level, links = keyed(fps), 0, None
    while True:
        dealt = rows.repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")
        found = work.write(map_batches(dealt.select("rotation", "mask", "value", "fp"), lambda batches: search(batches, limit), "kind int, a long, b long, fp long"), f"links-{level}")
        new = found.where("kind = 0").select("a", "b")
        links = new if links is None else links.union(new)
        again = found.where("kind = 1")
        if again.isEmpty():
            return links
        rows, level = again.selectExpr("-1 rotation", "a mask", "b value", "fp"), level + 1


def classes_of(docs: DataFrame, words: int, seed: int, limit: int) -> DataFrame:
    """doc_id, text_key, fp, component_id for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([f for group in in_slices(text_bytes(b)) for f in fingerprints(group, words, seed)], np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "text_key": b.column("text_key"), "fp": pa.array(signed(fps), pa.int64())})

    work = Workspace(docs.sparkSession, "simhash")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key_of_text().alias("text_key"), F.col("text").cast("string").alias("text"))
    rows = work.write(map_batches(plain, run, "doc_id long, text_key long, fp long"), "fingerprints")
    fps = work.write(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    nodes = connected_components(links_within(fps.select("fp"), work, limit), "simhash-components")
    of_root = fps.join(nodes, fps.fp == nodes.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = of_root.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(of_root.join(least, "root").select("fp", "component_id"), "fp")


def near_duplicates(docs: DataFrame, words: int = WORDS, seed: int = SEED, limit: int = KEY_LIMIT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links, itself included)."""
    return classes_of(docs, words, seed, limit).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = WORDS, seed: int = SEED, limit: int = KEY_LIMIT, similarity: float | None = None) -> DataFrame:
    """docs without those that have a near-duplicate with a smaller doc_id, directly or over others: within MOST_BITS of each
    other or, if similarity is given, with shingle sets of that Jaccard similarity or more."""
    if similarity is None:
        return keep_first(docs, classes_of(docs, words, seed, limit))
    from groundwork.llm import jaccard  # it builds on this module

    return keep_first(docs, jaccard.classes_of(docs, words, similarity, limit))


def key_of_text() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def keep_first(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of docs that give their component (doc_id, text_key, component_id) its name; of rows that repeat an id and a text one stays."""
    kept = classes.where("doc_id <=> component_id").groupBy("doc_id", "text_key").agg(F.count("*").alias("n"))
    kept = Workspace(docs.sparkSession, "one-of-each").write(kept, "kept")
    own_id, own_key = free_name(docs, "kept_id"), free_name(docs, "kept_key")
    named = kept.select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key))
    same = docs.join(named, F.col("doc_id").eqNullSafe(F.col(own_id)) & (key_of_text() == F.col(own_key)), "left_semi")
    if kept.where("n > 1").isEmpty():
        return same
    key = free_name(docs, "text_key")
    return same.withColumn(key, key_of_text()).dropDuplicates(["doc_id", key]).drop(key)
