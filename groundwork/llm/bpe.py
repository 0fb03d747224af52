"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Style: Arrow batches. A document is encoded on its own, so there is no shuffle; memory is bounded by the
Arrow batch and one document. A lost executor costs its unfinished splits.

Defined cases: a null text is the empty text (no tokens, empty decoding); special-token strings inside a text
are ordinary text; repeated rows give repeated rows; an empty table gives an empty table; other columns are
not read, so names that clash cannot matter.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from groundwork.llm.common import map_batches

#: Characters after which a long text is cut at the next safe boundary.
PIECE_CHARS = 1 << 16
#: A visible character followed by a blank or a line feed, and the pattern for which that is safe: it never joins the two in
#: one match, its white-space alternatives look ahead only, and what stands before the boundary ends on a visible
#: character. Texts are not cut under any other pattern.
BOUNDARY, CUT_PATTERN = re.compile(r"\S(?=[ \n])"), public_tokenizers.PATTERN


def read_ranks(path: str) -> bytes:
    """The rank file's bytes: a vocabulary, of a size that does not grow with the data."""
    with open(path, "rb") as f:
        return f.read()


@functools.lru_cache(maxsize=4)
def build(ranks: bytes, pattern: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    pairs = [line.split() for line in ranks.splitlines() if line]
    merge = {base64.b64decode(token): int(rank) for token, rank in pairs}
    table = [b""] * (max(merge.values(), default=-1) + 1)
    for token, rank in merge.items():
        table[rank] = token
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=merge, special_tokens={}), table


def safe_pieces(text: str, limit: int = PIECE_CHARS) -> Iterator[str]:
    """Cuts a text where the pre-splitting pattern has a boundary in any case; a text without one stays whole."""
    start = 0
    while len(text) - start > limit and (m := BOUNDARY.search(text, start + limit)):
        yield text[start : m.end()]
        start = m.end()
    yield text[start:]


def encode_text(encoding: tiktoken.Encoding, text: str | None, pattern: str) -> list[int]:
    if not text:
        return []
    if len(text) <= PIECE_CHARS or pattern != CUT_PATTERN:
        return encoding.encode_ordinary(text)
    return [i for piece in safe_pieces(text) for i in encoding.encode_ordinary(piece)]


def decode_ids(table: list[bytes], ids: list[int]) -> bytes:
    """Raw bytes: ids may end inside a character."""
    return b"".join(map(table.__getitem__, ids))


def encode(spark: SparkSession, docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, on request, the ids themselves."""
    shared = spark.sparkContext.broadcast((read_ranks(path), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, table = build(*shared.value)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            counts, of_ids, of_bytes, kept = [], [], [], []
            for text in batch.column("text").to_pylist():
                ids = encode_text(encoding, text, shared.value[1])
                counts.append(len(ids))
                packed = np.array(ids, "<u4")
                of_ids.append(sha(packed.tobytes()))
                of_bytes.append(sha(decode_ids(table, ids)))
                if with_ids:
                    kept.append(packed.astype(np.int32))
            out = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_bytes, pa.string())}
            if with_ids:
                out["ids"] = pa.array(kept, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), run, schema)


def decode(spark: SparkSession, encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the decoded bytes of the column ids (null: none)."""
    shared = spark.sparkContext.broadcast((read_ranks(path), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, table = build(*shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "decoded": pa.array([decode_ids(table, x or []) for x in batch.column("ids").to_pylist()], pa.binary())})

    return map_batches(encoded.selectExpr("cast(doc_id as long) doc_id", "cast(ids as array<int>) ids"), run, "doc_id long, decoded binary")
