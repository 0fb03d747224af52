"""Chunks that ask a partitioned table, and are answered in the order of their own questions.

Documents are dealt into chunks, whose rows are written once, bucketed by chunk. A chunk's question is a table of
distinct keys, sorted by the part of the key space they belong to; a part adds up what is asked of it, and answers with
values in the order in which the keys were sent. So a frequent key is one item per chunk, keys travel once, answers
without keys, and the chunks' own contents never.

No chunk sends more than FAN rows. Where there are more parts than that, rows go to relays: a relay gets one range of
parts from up to FAN chunks, adds them up as a part would, asks on in their place, at finer ranges, and hands the answers
back. So the rows that move grow with the input, not with its square, in as many hops as the logarithm of the parts.

Rows are packed arrays; parts and relays hold about as many keys as a chunk.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from groundwork.llm.common import Workspace, map_batches, partitions, release

#: Bytes of text after which a chunk is full.
CHUNK_BYTES = 8 << 20
#: Rows that a chunk or relay sends at most, and chunks of keys in a part.
FAN, PART_CHUNKS = 128, 1

Table = dict[str, np.ndarray]
Merge = Callable[[list[Table]], tuple[Table, list[np.ndarray]]]


def pack(values: np.ndarray) -> bytes:
    """An array, byte by byte of all its values, compressed: small numbers and sorted keys take few bytes."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes() if len(values) else b""
    return values.dtype.char.encode() + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(blob: bytes) -> np.ndarray:
    kind = np.dtype(blob[:1].decode())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).reshape(-1) if len(planes) else np.empty(0, kind)


def small(values: np.ndarray) -> np.ndarray:
    """The same whole numbers, none of which is negative, in the least unsigned type."""
    return values.astype(np.min_scalar_type(int(values.max())) if len(values) else np.uint8)


def packed(table: Table) -> bytes:
    """Columns of numbers or (as objects) of bytes."""
    kinds = {k: (pack(small(np.array([len(x) for x in v], np.int64))), zstandard.ZstdCompressor(level=1).compress(b"".join(v))) if v.dtype == object else pack(small(v) if v.dtype.kind in "iu" else v) for k, v in table.items()}
    return pickle.dumps(kinds)


def unpacked(blob: bytes) -> Table:
    return {k: strings(unpack(v[0]), zstandard.ZstdDecompressor().decompress(v[1])) if isinstance(v, tuple) else unpack(v) for k, v in pickle.loads(blob).items()}  # noqa: S301  (written by this job)


def strings(lengths: np.ndarray, joined: bytes) -> np.ndarray:
    ends = np.cumsum(lengths, dtype=np.int64)
    return objects([joined[b - n : b] for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)])


def objects(values: list) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values
    return out


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Equal ranges of 64-bit keys."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def mixed(*keys: np.ndarray) -> np.ndarray:
    """One well spread 64-bit key of several numbers."""
    out = np.uint64(0x2545F4914F6CDD1D)
    for k in keys:
        out = (out ^ k.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out = (out ^ out >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        out = out ^ out >> np.uint64(32)
    return out


def runs(*sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values (of equal rows, for several arrays) begin."""
    if not len(sorted_values[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(sorted_values[0]), bool)
    new[0] = True
    for x in sorted_values:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def ordered(keys: list[np.ndarray]) -> np.ndarray:
    """The order of rows by several keys, whole numbers from 0 on: keys are joined as long as they fit into 64 bits, then replaced by their ranks."""
    joined, bits = np.zeros(len(keys[0]), np.uint64), 0
    for k in keys:
        more = int(k.max()).bit_length() if len(k) else 0
        if bits + more > 64:
            order = np.argsort(joined)
            begin = runs(joined[order])
            joined = np.empty_like(joined)
            joined[order] = np.repeat(np.arange(len(begin), dtype=np.uint64), np.diff(np.append(begin, len(order))))
            bits = len(begin).bit_length()
            if bits + more > 64:
                return np.lexsort(keys[::-1])
        joined = (joined << np.uint64(more) if more < 64 else np.zeros_like(joined)) | k.astype(np.uint64)
        bits += more
    return np.argsort(joined)


def added(keys: tuple[str, ...], sums: tuple[str, ...]) -> Merge:
    """Puts tables together: rows of equal keys become one, `sums` are added up, other columns are equal where the keys are.
    Gives the merged table, sorted by part and keys, and for each table the places of its rows in it."""

    def merge(tables: list[Table]) -> tuple[Table, list[np.ndarray]]:
        columns = {k: np.concatenate([t[k] for t in tables]) for k in tables[0]}
        order = ordered([columns[k] for k in ("part", *keys)])
        begin = runs(*(columns[k][order] for k in keys))
        index = np.empty(len(order), np.int64)
        index[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(order))))
        out = {k: np.bincount(index, weights=v, minlength=len(begin)).astype(np.int64) if k in sums else v[order[begin]] for k, v in columns.items()}
        return out, np.split(index, np.cumsum([len(t["part"]) for t in tables])[:-1])

    return merge


def rows_of(table: Table, which: np.ndarray | slice) -> Table:
    return {k: v[which] for k, v in table.items()}


def spans_of(parts: int) -> list[int]:
    """Parts in a range, hop by hop; one part in the end."""
    out = [-(-parts // FAN)]
    while out[-1] > 1:
        out.append(-(-out[-1] // FAN))
    return out


SENT = "asker long, squad long, at long, blob binary"


def sent(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(("asker", "squad", "at", "blob"), kinds, strict=True))})


def dealt(asker: int, squad: int, table: Table, span: int) -> list[tuple[int, int, int, bytes]]:
    """A row for each range of `span` parts that a table, sorted by part, has rows for."""
    at = table["part"].astype(np.int64) // span
    begin = runs(at).tolist()
    return [(asker, squad, int(at[a]), packed(rows_of(table, slice(a, b)))) for a, b in zip(begin, [*begin[1:], len(at)][: len(begin)], strict=True)]


class Asked:
    """What became of a question: answers (chunk, name, at, blob), and what the parts keep as tables or tell the driver (at, blob)."""

    def __init__(self, answers: DataFrame, said: DataFrame):
        self.answers, self.said = answers, said

    def kept(self, kind: str) -> DataFrame:
        return self.said.where(self.said.kind == kind).select("at", "blob")

    def totals(self) -> Iterator[Table]:
        """A few numbers for each part, one part after the other."""
        for r in self.kept("totals").toLocalIterator():
            yield unpacked(bytes(r["blob"]))


class Chunks:
    """The chunks of docs, written bucketed by chunk: joins with their answers leave them where they are. The table goes when the block ends, however it ends."""

    def __init__(self, docs: DataFrame, work: Workspace, build: Callable[[list, list[bytes]], dict[str, object]], types: dict[str, pa.DataType], schema: str, chunk_bytes: int | None = None):
        """build: from doc_ids and UTF-8 texts of one chunk its columns."""
        spark, chunk_bytes = docs.sparkSession, chunk_bytes or CHUNK_BYTES

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, texts, held, n = [], [], 0, 0
            at = TaskContext.get().partitionId() << 32

            def close() -> pa.RecordBatch:
                own = build(ids, texts)
                return pa.RecordBatch.from_pydict({"chunk": pa.array([at + n], pa.int64())} | {k: pa.array([own[k]], t) for k, t in types.items()})

            for b in batches:
                for i, x in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    ids.append(i)
                    texts.append(x or b"")
                    held += len(texts[-1]) + 64
                    if held >= chunk_bytes:
                        yield close()
                        ids, texts, held, n = [], [], 0, n + 1
            if ids:
                yield close()

        self.spark, self.work, self.name = spark, work, f"groundwork_chunks_{uuid.uuid4().hex}"
        plain = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
        rows = map_batches(plain, run, f"chunk long, {schema}")
        self._save(rows, self.name)
        self.count = self.table.select("chunk").count()
        self.parts = max(1, -(-self.count // PART_CHUNKS))

    def _save(self, rows: DataFrame, name: str) -> None:
        try:
            rows.write.format("parquet").option("compression", "zstd").bucketBy(partitions(self.spark), "chunk").saveAsTable(name)
        except BaseException:
            self.spark.sql(f"drop table if exists {name}")
            raise
        self.name, self.table = name, self.spark.table(name)

    def replace(self, answers: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> None:
        """The chunks become f of each chunk's row and of the answers to it; what they were goes."""
        old = self.name
        self._save(self.with_answers(answers, f, schema), f"groundwork_chunks_{uuid.uuid4().hex}")
        self.spark.sql(f"drop table if exists {old}")
        release(self.spark)

    def __enter__(self) -> Chunks:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop()

    def drop(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")

    def ask(self, answers: DataFrame | None, question: Callable[[dict, list[dict]], Table], merge: Merge, resolve: Callable[[int, Table, list[Table]], dict[str, Table]], name: str, stored: DataFrame | None = None, tidy: Callable[[Table, Table], Table] | None = None) -> Asked:
        """question: of a chunk's row and its answers so far, a table of distinct keys sorted by `part` and, within it, as
        `merge` sorts. resolve: of a part, all that is asked of it, and what `stored` (at, blob) has for it, the `answer`
        in the order of the merged rows, and, if it likes, tables that are kept and `totals` for the driver. tidy: of a
        question and its answer, the answer without what the asker can do without."""
        spans, squads = spans_of(self.parts), max(1, -(-self.count // FAN))

        def asked(left: pa.Table, right: pa.Table) -> pa.Table:
            return sent([x for row in left.to_pylist() for x in dealt(row["chunk"], row["chunk"] % squads, question(row, right.to_pylist()), spans[0])])

        said: list[DataFrame] = []
        answered = self._hop(self.with_answers(answers, asked, SENT), spans, 0, merge, resolve, name, stored, tidy, said)
        release(self.spark)
        return Asked(answered.selectExpr("asker chunk", f"'{name}' name", "at", "blob"), said[0])

    def _hop(self, rows: DataFrame, spans: list[int], level: int, merge: Merge, resolve: Callable, name: str, stored: DataFrame | None, tidy: Callable | None, said: list[DataFrame]) -> DataFrame:
        """asker, at, blob: the answers to the rows sent."""
        if spans[level] == 1:
            return self._parts(rows, merge, resolve, name, stored, tidy, said)
        finer = spans[level + 1]

        def relayed(rows: pa.Table) -> pa.Table:
            rows = sorted(rows.to_pylist(), key=lambda r: r["asker"])
            merged, index = merge([unpacked(r["blob"]) for r in rows])
            places = pickle.dumps([pack(small(np.diff(i, prepend=0))) if (np.diff(i) >= 0).all() else pack(i) for i in index])
            return pa.table({
                "relay": pa.array([rows[0]["squad"] << 31 | rows[0]["at"]], pa.int64()), "squad": pa.array([rows[0]["squad"]], pa.int64()), "at": pa.array([rows[0]["at"]], pa.int64()),
                "askers": pa.array([[r["asker"] for r in rows]], pa.list_(pa.int64())), "places": pa.array([places], pa.binary()), "merged": pa.array([packed(merged)], pa.binary()),
            })

        def on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    yield from sent(dealt(r["relay"], r["squad"] // FAN, unpacked(r["merged"]), finer)).to_batches()

        def back(relay: pa.Table, got: pa.Table) -> pa.Table:
            out = []
            for r in relay.to_pylist():
                whole = received(got.to_pylist(), None)
                for asker, blob in zip(r["askers"], pickle.loads(r["places"]), strict=True):  # noqa: S301
                    i = unpack(blob)
                    out.append((asker, 0, r["at"], packed(rows_of(whole, i if i.dtype == np.int64 else np.cumsum(i, dtype=np.int64)))))
            return sent(out)

        relays = self.work.write(rows.groupBy("squad", "at").applyInArrow(relayed, "relay long, squad long, at long, askers array<long>, places binary, merged binary"), f"{name}-relays-{level}", "uncompressed")
        got = self._hop(map_batches(relays.select("relay", "squad", "merged"), on, SENT), spans, level + 1, merge, resolve, name, stored, None, said)
        out = relays.select("relay", "at", "askers", "places").groupBy("relay").cogroup(got.withColumnRenamed("asker", "relay").groupBy("relay")).applyInArrow(back, SENT)
        return self.work.write(out, f"{name}-answers-{level}", "uncompressed").select("asker", "at", "blob")

    def _parts(self, rows: DataFrame, merge: Merge, resolve: Callable, name: str, stored: DataFrame | None, tidy: Callable | None, said: list[DataFrame]) -> DataFrame:
        def answered(asked: pa.Table, have: list[Table]) -> pa.Table:
            asked = sorted(asked.to_pylist(), key=lambda r: r["asker"])
            if not asked:
                return pa.table({"asker": pa.array([], pa.int64()), "at": pa.array([], pa.int64()), "kind": pa.array([], pa.string()), "blob": pa.array([], pa.binary())})
            at = asked[0]["at"]
            tables = [unpacked(r["blob"]) for r in asked]
            merged, index = merge(tables)
            got = resolve(at, merged, have)
            own = (rows_of(got["answer"], i) for i in index)
            out = [(r["asker"], "answer", packed(tidy(t, x) if tidy else x)) for r, t, x in zip(asked, tables, own, strict=True)] + [(-1, k, packed(v)) for k, v in got.items() if k != "answer"]
            return pa.table({"asker": pa.array([x[0] for x in out], pa.int64()), "at": pa.array([at] * len(out), pa.int64()), "kind": pa.array([x[1] for x in out], pa.string()), "blob": pa.array([x[2] for x in out], pa.binary())})

        schema, by = "asker long, at long, kind string, blob binary", rows.groupBy("at")
        if stored is None:
            out = by.applyInArrow(lambda asked: answered(asked, []), schema)
        else:
            out = by.cogroup(stored.groupBy("at")).applyInArrow(lambda asked, have: answered(asked, [unpacked(x) for x in have.column("blob").to_pylist()]), schema)
        said.append(self.work.write(out, name, "uncompressed", "kind"))
        return said[0].where("kind = 'answer'").select("asker", "at", "blob")

    def with_answers(self, answers: DataFrame | None, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        """f of each chunk's row and of the answers to it."""
        if answers is None:
            empty = pa.table({"chunk": pa.array([], pa.int64())})

            def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    for i in range(b.num_rows):
                        yield from f(pa.Table.from_batches([b.slice(i, 1)]), empty).to_batches()

            return map_batches(self.table, alone, schema)
        return self.table.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(f, schema)


def received(rows: list[dict], name: str | None) -> Table:
    """The answers of one name to one asker, in the order of its question; without any, an empty table."""
    own = [unpacked(r["blob"]) for r in sorted((r for r in rows if name is None or r["name"] == name), key=lambda r: r["at"])]
    return {k: np.concatenate([t[k] for t in own]) for k in own[0]} if own else {}
