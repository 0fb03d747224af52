"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger holds the measurements and one bit per rule that failed;
a policy is a named version of (fatal bits, tolerated number of softer bits) and is applied to the ledger alone.
Ablations come from counting documents by mask, so no text is read again.

Style: Arrow batches for the one pass over the texts, DataFrame operations for policies and ablations. No shuffle
before the ablation's, which is over masks: at most 2 ** number of rules groups, combined before they move.

Defined cases: a null or blank text has no words, zero for every measurement, and fails `few_words`; a text of any
length is measured whole, over numbers of its words; repeated rows give repeated ledger rows; an empty table gives an empty ledger; only
doc_id and text are read, so extra columns and clashing names do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from groundwork.llm.common import free_name, map_batches, text_bytes

#: The symbols that are counted, and the rules in the order of their bits.
SYMBOLS = b"#*$%&|<>"
RULES = ("few_words", "repeated_words", "many_symbols", "repeated_lines", "word_length")
#: Versions of the policy: bits that reject on their own, bits that only count, and how many of these are tolerated.
POLICIES = {
    "base": {"fatal": ("few_words", "repeated_words"), "soft": (), "tolerated": 0},
    "v1": {"fatal": ("few_words", "repeated_words", "many_symbols", "repeated_lines"), "soft": ("word_length",), "tolerated": 0},
    "v2": {"fatal": ("few_words", "repeated_words"), "soft": ("many_symbols", "repeated_lines", "word_length"), "tolerated": 1},
}
#: What is no beginning of a character in a word: white space, and continuation bytes.
NOT_CHARS = bytes([0x20, *range(0x09, 0x0E), *range(0x80, 0xC0)])
#: Bytes of a text whose words are numbered at a time.
SLICE = 1 << 20

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def word_numbers(text: bytes) -> np.ndarray:
    """A number for each word, equal for equal words; words are taken slice by slice, so that only distinct ones are held."""
    numbers: dict[bytes, int] = {}
    parts, at = [], 0
    while at < len(text):
        end = at + SLICE
        if end < len(text) and (m := re.compile(rb"[\x20\x09-\x0D]").search(text, end)):
            end = m.start()
        elif end < len(text):
            end = len(text)
        parts.append(np.array([numbers.setdefault(w, len(numbers)) for w in text[at:end].split()], np.int32))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.int32)


def repeated_words(words: np.ndarray) -> int:
    """Words in three-word windows that are found twice or more."""
    n = len(words)
    if n < 4:  # two windows at least
        return 0
    window = words[:-2].astype(np.int64)
    for shift in (1, 2):  # windows by two words, then by three, as numbers
        window = window * (int(words.max()) + 1) + words[shift : n - 2 + shift]
        if shift == 1:
            window = np.unique(window, return_inverse=True)[1]
    order = np.argsort(window)
    same = window[order[1:]] == window[order[:-1]]
    often = np.zeros(n - 2, bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    for shift in range(3):
        inside[shift : n - 2 + shift] |= often
    return int(inside.sum())


def lines_of(text: bytes) -> Iterator[bytes]:
    at = 0
    while (end := text.find(b"\n", at)) >= 0:
        yield text[at:end]
        at = end + 1
    yield text[at:]


def measure(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (lines with a word) of UTF-8 bytes."""
    words = word_numbers(text)
    n_lines, distinct = 0, set()
    for line in lines_of(text):
        if line.strip():
            n_lines += 1
            distinct.add(line)
    return len(words), len(text.translate(None, NOT_CHARS)), len(text) - len(text.translate(None, SYMBOLS)), n_lines - len(distinct), repeated_words(words), n_lines


def failed_bits(names: list[str] | None = None) -> Column:
    """The ledger's mask from its measurements (under other names: in their order), in whole numbers, so that every engine agrees."""
    own = re.findall(r"(\w+) long", MEASURES)
    c = lambda x: F.col(dict(zip(own, names or own, strict=True))[x])
    tests = {
        "few_words": c("n_words") < 50,
        "repeated_words": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "many_symbols": 10 * c("n_symbols") > c("n_words"),
        "repeated_lines": (c("n_dup_lines") >= 3) & (10 * c("n_dup_lines") > 3 * c("n_lines")),
        "word_length": (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words")),
    }
    mask = F.lit(0)
    for bit, rule in enumerate(RULES):
        mask = mask.bitwiseOR(F.when(tests[rule], 1 << bit).otherwise(0))
    return mask.cast("long")


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, the measurements and failed_mask: every rule once per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*map(measure, text_bytes(batch)), strict=True)) or [()] * 6
            names = re.findall(r"(\w+) long", MEASURES)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | {k: pa.array(v, pa.int64()) for k, v in zip(names, columns, strict=True)})

    rows = map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), run, f"doc_id long, {MEASURES}")
    return rows.withColumn("failed_mask", failed_bits())


def bits(rules: tuple[str, ...]) -> int:
    return sum(1 << RULES.index(x) for x in rules)


def keeps(mask: Column, policy: str) -> Column:
    """Whether a version of the policy keeps a document with this mask."""
    p = POLICIES[policy]
    return (mask.bitwiseAND(F.lit(bits(p["fatal"]))) == 0) & (F.bit_count(mask.bitwiseAND(F.lit(bits(p["soft"])))) <= p["tolerated"])


def kept_documents(docs: DataFrame, policy: str) -> DataFrame:
    """docs that the policy keeps. The rules are measured beside the rows, so the texts are not joined, nor shuffled."""
    fields = docs.schema.fields
    text = next(i for i, f in enumerate(fields) if f.name == "text")
    names = [free_name(docs, x) for x in re.findall(r"(\w+) long", MEASURES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]
            columns = list(zip(*map(measure, texts), strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, pa.int64()) for v in columns)], names=[*batch.schema.names, *names])

    schema = StructType([*fields, *(StructField(n, LongType()) for n in names)])
    rows = map_batches(docs, run, schema)
    return rows.where(keeps(failed_bits(names), policy)).select(*docs.columns)


def ablations(rows: DataFrame, policy: str) -> DataFrame:
    """For each rule: documents that fail it, and documents that the policy would keep without it but not with it."""
    masks = rows.groupBy("failed_mask").agg(F.count("*").alias("n"))
    each = masks.withColumn("rule", F.explode(F.array(*(F.struct(F.lit(i).alias("bit"), F.lit(x).alias("name")) for i, x in enumerate(RULES))))).select("failed_mask", "n", "rule.bit", F.col("rule.name").alias("rule"))
    one = F.expr("shiftleft(1L, bit)")
    fails = F.col("failed_mask").bitwiseAND(one) != 0
    without = keeps(F.col("failed_mask").bitwiseAND(F.bitwise_not(one)), policy) & ~keeps(F.col("failed_mask"), policy)
    total = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    return each.groupBy("rule").agg(total(fails).alias("n_failed"), total(without).alias("n_kept_without"))
