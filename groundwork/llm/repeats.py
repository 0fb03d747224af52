"""Suffix-array dedup: bytes covered by a LENGTH-byte string that also starts anywhere else are removed.

Every LENGTH-byte string has one anchor, the least of its GRAM-byte grams by hash, so equal strings have equal anchors,
and the starts that share an anchor form one window of text. Windows whose anchor occurs once hold no repeat. All others
meet by anchor in shards, where identical windows are repeats as they stand, and the rest is put into suffix arrays by
induced sorting (`sais`); permuted common prefixes with the neighbours in the array tell which starts are repeats. A
window is in one shard, whose arrays are built from batches of whole anchors, so their memory is bounded.

An anchor with more than HOT distinct windows (a passage in very many places) is refined first: its starts are dealt into
classes by their distance to the anchor, and windows meet by all the bytes that the starts of a class have in common, in
classes of 48, 12, 4 and at last 1 starts, where the key is the string itself and whatever has a key twice is compared
byte by byte. No start is dropped on the way; hashes decide what is compared, bytes decide what is a repeat.

Style: packed arrays between chunks and shards (`exchange`); texts are written once and never shuffled, only windows are.

Defined cases: a null text is the empty text (no bytes, nothing removed); shorter texts than LENGTH lose nothing; matches
don't cross documents; repeated rows are documents of their own, hence repeats of each other; an empty table gives an
empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from groundwork.llm.common import Workspace
from groundwork.llm.exchange import Chunks, Table, added, mixed, objects, pack, part_of, received, runs, small, unpack
from groundwork.llm.sais import permuted_lcp, suffix_array

LENGTH, GRAM, HOT = 200, 32, 4096
REACH = LENGTH - GRAM + 1  # grams in a string
CLASSES = (REACH, 48, 12, 4, 1)
#: Starts that are winnowed at once, and bytes of windows in one suffix array.
SEGMENT, ARRAY_BYTES = 1 << 18, 1 << 21
PLACE_BITS = np.uint64(2**24 - 1)
ONCE, SOME, MANY = 0, 1, 2


def gram_hashes(data: bytes) -> np.ndarray:
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    n = len(data) - GRAM + 1
    factors = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
    h = sum(eights[8 * i : 8 * i + n] * f for i, f in enumerate(factors))
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    w = 1
    while 2 * w <= width:
        x, w = np.minimum(x[:-w], x[w:]), 2 * w
    return np.minimum(x[: len(x) - (width - w)], x[width - w :]) if width > w else x


def windows_of(data: bytes, lengths: list[int]) -> dict[str, np.ndarray]:
    """Of documents that stand one after the other: hash of the anchor, first start, number of starts, and how far the anchor is from the first start."""
    ends = np.cumsum(lengths)
    docs = [(e - n, e - LENGTH + 1) for n, e in zip(lengths, ends.tolist(), strict=True) if n >= LENGTH]
    found: dict[str, list[np.ndarray]] = {k: [] for k in ("key", "start", "many", "off")}
    first = 0
    for a in range(0, len(data) - LENGTH + 1, SEGMENT):
        b = min(a + SEGMENT, len(data) - LENGTH + 1)
        h = gram_hashes(data[a : b + LENGTH - 1])
        least = sliding_min(h & ~PLACE_BITS | np.arange(len(h), dtype=np.uint64), REACH)
        place = (least & PLACE_BITS).astype(np.int64)
        cuts = [np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))]
        valid = np.zeros(len(place), bool)
        while first < len(docs) and docs[first][1] <= a:
            first += 1
        i = first
        while i < len(docs) and docs[i][0] < b:
            lo, hi = max(docs[i][0], a) - a, min(docs[i][1], b) - a
            valid[lo:hi] = True
            cuts.append(np.array([lo, hi]))
            i += 1
        cut = np.unique(np.concatenate(cuts))
        cut = cut[cut < len(place)]
        n = np.diff(np.append(cut, len(place)))
        good = valid[cut]
        cut, n = cut[good], n[good]
        for k, v in (("key", h[place[cut]]), ("start", cut + a), ("many", n), ("off", place[cut] - cut)):
            found[k].append(v)
    return {k: np.concatenate(v) if v else np.empty(0, np.uint64 if k == "key" else np.int64) for k, v in found.items()}


def build(ids: list, texts: list[bytes]) -> dict[str, object]:
    data, lengths = b"".join(texts), [len(x) for x in texts]
    w = windows_of(data, lengths)
    steps = np.diff(w["start"], prepend=0)
    return {"doc_ids": ids, "lengths": lengths, "data": data, "keys": pack(w["key"]), "steps": pack(small(steps)), "many": pack(small(w["many"])), "offs": pack(small(w["off"]))}


TYPES = {"doc_ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64())} | {k: pa.binary() for k in ("data", "keys", "steps", "many", "offs")}
SCHEMA = "doc_ids array<long>, lengths array<long>, data binary, keys binary, steps binary, many binary, offs binary"


class Items:
    """Windows of a chunk at one level: key, start, many (starts), off (from the first start to the anchor)."""

    def __init__(self, key: np.ndarray, start: np.ndarray, many: np.ndarray, off: np.ndarray):
        self.key, self.start, self.many, self.off = key, start.astype(np.int64), many.astype(np.int64), off.astype(np.int64)

    def take(self, which: np.ndarray) -> Items:
        return Items(self.key[which], self.start[which], self.many[which], self.off[which])

    def text(self, data: bytes, i: int) -> bytes:
        return data[self.start[i] : self.start[i] + self.many[i] + LENGTH - 1]

    def finer(self, data: bytes, width: int) -> Items:
        """The same starts in classes of distance to the anchor; keys are of all bytes that the starts of a class share."""
        key, start, many, off = [], [], [], []
        for s, m, o in zip(self.start.tolist(), self.many.tolist(), self.off.tolist(), strict=True):
            anchor = s + o
            for c in range((o - m + 1) // width, o // width + 1):
                far, near = min(o, c * width + width - 1), max(o - m + 1, c * width)
                core = data[anchor - c * width : anchor - c * width - width + 1 + LENGTH]
                key.append(xxhash.xxh64_intdigest(core, c * len(CLASSES) + CLASSES.index(width)))
                start.append(anchor - far)
                many.append(far - near + 1)
                off.append(far)
        return Items(np.array(key, np.uint64), np.array(start, np.int64), np.array(many, np.int64), np.array(off, np.int64))

    def by_key(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in order, the order of the windows by key, and where each key begins in it."""
        order = np.argsort(self.key, kind="stable")
        sorted_keys = self.key[order]
        begin = np.flatnonzero(np.concatenate((sorted_keys[:1] == sorted_keys[:1], sorted_keys[1:] != sorted_keys[:-1])))
        return sorted_keys[begin], order, begin


class Loaded:
    """A chunk, with what the answers so far say about its windows: to be compared (in levels), or still to be asked about."""

    def __init__(self, row: dict, answers: list[dict], parts: int):
        self.ids, self.lengths, self.data = row["doc_ids"], row["lengths"], row["data"]
        self.parts = parts
        self.open = Items(unpack(row["keys"]), np.cumsum(unpack(row["steps"]).astype(np.int64)), unpack(row["many"]), unpack(row["offs"]))
        self.compare: list[Items] = []
        names, level = {r["name"] for r in answers}, 0
        while f"level-{level}" in names and len(self.open.key):
            keys, order, begin, sent = self.keys()
            said = np.empty(len(keys), np.uint8)
            said[sent] = received(answers, f"level-{level}")["said"]
            state = np.empty(len(order), np.uint8)
            state[order] = np.repeat(said, np.diff(np.append(begin, len(order))))
            # where a key is the string itself there is nothing finer: whatever occurs twice is compared, byte by byte
            last = CLASSES[level] == 1
            self.compare.append(self.open.take(state != ONCE if last else state == SOME))
            again = self.open.take(state == MANY)
            self.open = again.take(np.empty(0, np.int64)) if last else again.finer(self.data, CLASSES[level + 1])
            level += 1

    def keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys of the open windows, the order of the windows by key, where each key begins in it, and the order in which keys are sent."""
        keys, order, begin = self.open.by_key()
        return keys, order, begin, np.lexsort((keys, part_of(mixed(keys), self.parts)))

    def level_question(self) -> Table:
        keys, order, begin, sent = self.keys()
        occurs = np.diff(np.append(begin, len(order)))
        windows = np.ones(len(begin), np.int64)
        for g in np.flatnonzero(occurs > 1).tolist():
            windows[g] = len({(self.open.off[i], self.open.text(self.data, i)) for i in order[begin[g] : begin[g] + occurs[g]].tolist()})
        return {"part": part_of(mixed(keys), self.parts)[sent], "key": keys[sent], "n": np.minimum(occurs, 2)[sent], "x": windows[sent]}

    def to_compare(self) -> list[list[tuple[Items, int]]]:
        """Windows in groups of equal key, distance and text, (items, index) of their members, in the order in which they are sent."""
        groups: dict[tuple, list[tuple[Items, int]]] = {}
        for level, items in enumerate(self.compare):
            for i, (key, off) in enumerate(zip(items.key.tolist(), items.off.tolist(), strict=True)):
                groups.setdefault((level, key, off, items.text(self.data, i)), []).append((items, i))
        members = list(groups.values())
        order = np.argsort(part_of(mixed(np.array([k[1] for k in groups], np.uint64)), self.parts), kind="stable")
        return [members[g] for g in order.tolist()]

    def windows_question(self) -> Table:
        groups = self.to_compare()
        one = [g[0] for g in groups]
        of = lambda name, kind: np.array([getattr(items, name)[i] for items, i in one], kind)
        key = of("key", np.uint64)
        return {
            "part": part_of(mixed(key), self.parts), "key": key, "many": of("many", np.int64), "off": of("off", np.int64), "times": np.array([min(2, len(g)) for g in groups], np.int64),
            "text": objects([items.text(self.data, i) for items, i in one]),
        }


def said_of(rows: Table, hot: int) -> dict[str, Table]:
    """Whether a key occurs once, with some windows, or with too many to be compared at this level."""
    said = np.where(rows["n"] < 2, ONCE, np.where(rows["x"] > hot, MANY, SOME)).astype(np.uint8)
    return {"answer": {"said": said}, "totals": {"many": np.array([(said == MANY).sum()], np.int64)}}


def merge_windows(tables: list[Table]) -> tuple[Table, list[np.ndarray]]:
    """Windows of equal key, distance and text become one, which occurs as often as all of them."""
    place: dict[tuple, int] = {}
    index = [np.array([place.setdefault(k, len(place)) for k in zip(t["key"].tolist(), t["off"].tolist(), t["text"].tolist(), strict=True)], np.int64) for t in tables]
    every = np.concatenate(index)
    first = np.empty(len(place), np.int64)
    first[every[::-1]] = np.arange(len(every))[::-1]
    columns = {k: np.concatenate([t[k] for t in tables]) for k in tables[0]}
    order = np.argsort(columns["part"][first], kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    times = np.bincount(every, weights=columns["times"], minlength=len(place)).astype(np.int64)
    return {k: times[order] if k == "times" else v[first[order]] for k, v in columns.items()}, [rank[i] for i in index]


def repeated_starts(windows: list[bytes]) -> list[np.ndarray]:
    """For distinct windows: which of their starts (all but the last LENGTH - 1 bytes) begin a string that also starts elsewhere in them."""
    gap = b"\x00"
    text = gap.join(windows) + gap
    t = np.frombuffer(text, np.uint8)
    sizes = np.array([len(w) + 1 for w in windows])
    begin = np.cumsum(sizes) - sizes
    shifted = t.astype(np.uint16) + 2
    shifted[begin + sizes - 1] = 1  # between windows
    if shifted.max() < 256:
        shifted = shifted.astype(np.uint8)
    order = suffix_array(np.append(shifted, 0).astype(shifted.dtype), int(shifted.max()) + 1, LENGTH)
    starts = np.zeros(len(text) + 1, bool)
    marks = np.zeros(len(text) + 2, np.int32)
    np.add.at(marks, begin, 1)
    np.add.at(marks, begin + sizes - LENGTH, -1)
    starts[:] = np.cumsum(marks)[:-1] > 0
    order = order[starts[order]]
    prefix = permuted_lcp(text, order, LENGTH)
    again = prefix[order] >= LENGTH
    again[:1] = False
    hit = np.zeros(len(text), bool)
    hit[order[again]] = True
    hit[order[np.flatnonzero(again) - 1]] = True
    return [hit[b : b + n - LENGTH] for b, n in zip(begin.tolist(), sizes.tolist(), strict=True)]


def repeats_in(rows: Table) -> dict[str, Table]:
    """Which starts of the windows are repeats, as bits."""
    texts, times = rows["text"].tolist(), rows["times"]
    found: list[np.ndarray | None] = [None] * len(texts)
    batch: list[int] = []
    held = 0

    def close() -> None:
        for i, hits in zip(batch, repeated_starts([texts[i] for i in batch]) if batch else [], strict=True):
            found[i] = hits
        batch.clear()

    order = np.argsort(rows["key"], kind="stable")
    keys = rows["key"][order]
    begin = runs(keys).tolist()
    for a, b in zip(begin, [*begin[1:], len(keys)][: len(begin)], strict=True):
        if b - a > 1:  # else all its windows are one text
            batch += order[a:b].tolist()
            held += sum(len(texts[i]) + 1 for i in batch[a - b :])
            if held >= ARRAY_BYTES:
                close()
                held = 0
    close()
    for i, n in enumerate(times.tolist()):
        if n > 1 or found[i] is None:
            found[i] = np.full(len(texts[i]) - LENGTH + 1, n > 1)
    return {"answer": {"bits": objects([np.packbits(x).tobytes() for x in found])}}


def removed(row: dict, answers: list[dict], parts: int) -> Iterator[tuple[int | None, bytes, list[tuple[int, int]]]]:
    """doc_id, text and removed (start, end) of each document of a chunk."""
    x = Loaded(row, answers, parts)
    edges = np.zeros(len(x.data) + LENGTH + 1, np.int32)

    def mark(start: int, hits: np.ndarray) -> None:
        if hits.all():
            edges[start] += 1
            edges[start + len(hits) - 1 + LENGTH] -= 1
        elif hits.any():
            step = np.diff(np.concatenate(([0], hits, [0])).astype(np.int8))
            np.add.at(edges, start + np.flatnonzero(step > 0), 1)
            np.add.at(edges, start + np.flatnonzero(step < 0) - 1 + LENGTH, -1)

    bits = received(answers, "windows").get("bits", [])
    for group, own in zip(x.to_compare(), bits, strict=True):
        many = int(group[0][0].many[group[0][1]])
        hits = np.unpackbits(np.frombuffer(own, np.uint8))[:many].astype(bool)
        for items, i in group:
            mark(int(items.start[i]), hits)
    covered = np.cumsum(edges, dtype=np.int32) > 0
    at = 0
    for i, n in zip(x.ids, x.lengths, strict=True):
        own = covered[at : at + n]
        spans = []
        if own.any():
            step = np.diff(np.concatenate(([0], own, [0])).astype(np.int8))
            spans = list(zip(np.flatnonzero(step > 0).tolist(), np.flatnonzero(step < 0).tolist(), strict=True))
        yield i, x.data[at : at + n], spans
        at += n


def find(docs: DataFrame, hot: int = HOT, with_spans: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, on request, the removed spans in bytes."""
    work = Workspace(docs.sparkSession, "repeats")
    with Chunks(docs, work, build, TYPES, SCHEMA) as chunks:
        return _find(work, chunks, hot, with_spans)


def _find(work: Workspace, chunks: Chunks, hot: int, with_spans: bool) -> DataFrame:
    parts, answers = chunks.parts, None
    for level in range(len(CLASSES)):
        asked = chunks.ask(answers, lambda row, got: Loaded(row, got, parts).level_question(), added(("key",), ("n", "x")), lambda _, rows, __: said_of(rows, hot), f"level-{level}")
        answers = asked.answers if answers is None else answers.union(asked.answers)
        if not sum(int(x["many"][0]) for x in asked.totals()):
            break
    answers = answers.union(chunks.ask(answers, lambda row, got: Loaded(row, got, parts).windows_question(), merge_windows, lambda _, rows, __: repeats_in(rows), "windows").answers)

    def digest(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
        for i, text, spans in removed(left.to_pylist()[0], right.to_pylist(), parts):
            kept, at = hashlib.sha256(), 0
            for a, b in [*spans, (len(text), len(text))]:
                kept.update(text[at:a])
                at = b
            for k, v in zip(out, (i, len(text), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [{"start": a, "end": b} for a, b in spans]), strict=True):
                out[k].append(v)
        types = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
        return pa.table({k: pa.array(v, types[k]) for k, v in out.items() if k != "spans" or with_spans})

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", spans array<struct<start: long, end: long>>" * with_spans
    out = work.write(chunks.with_answers(answers, digest, schema), "result")
    work.drop("windows", *(f"level-{i}" for i in range(len(CLASSES))))
    return out
