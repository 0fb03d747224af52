"""Chat formatting with a grammar round trip.

A turn is rendered as  opening, role (where the opening doesn't name it), text, closing;  a conversation is its turns in
order. Every rendered turn is read back by a deterministic parser: it ends at the first closing that no backslash
breaks, and a backslash stands for the character after it. If what is recovered differs from the source, the text is
escaped further, until the two are identical: nothing, then control strings and backslashes, then every character that
may start one. A turn's rendering ends itself, so conversations are parsed turn by turn, whatever their length.

Style: Arrow batches. Turns are rendered where they are read; rows then meet by conversation, sorted by turn, and are
digested as a stream, so that a conversation of any length needs the memory of one turn. One conversation is one sequence
for its digests, hence one task.

Defined cases: a null text or role is empty; a null conv_id is a conversation of its own, and a null turn comes first in
its conversation; ties of turn are ordered by role, then text; repeated rows are turns of their own; an empty table gives
an empty result (plus what the caller adds); only the four named columns are read.
"""

from __future__ import annotations

import contextlib
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from groundwork.llm.common import map_batches

#: Role, opening, closing. The last stands for all other roles and names them.
USER, ASSISTANT, OTHER = ("user", "[INST] ", " [/INST]"), ("assistant", "<s>", "</s>"), (None, "<<SYS>>", "<</SYS>>")
CONTROL = re.compile(r"\\|\[/?INST\]|</?s>|<</?SYS>>")
STARTS = re.compile(r"[\\\[<\] ]")


class GrammarError(ValueError):
    """The text doesn't follow the grammar."""


def escaped(text: str, level: int) -> str:
    if level == 0:
        return text
    if level == 1:
        return CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)
    return STARTS.sub(lambda m: f"\\{m[0]}", text)


def unescaped(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text) if "\\" in text else text


def render(role: str, text: str) -> str:
    """One turn, with the least escaping that the parser undoes."""
    name, opening, closing = next((x for x in (USER, ASSISTANT) if x[0] == role), OTHER)
    for level in range(3):
        body = escaped(text, level)
        turn = opening + ("" if name else f"{escaped(role, 2).replace(chr(10), chr(92) + chr(10))}\n") + body + closing
        with contextlib.suppress(GrammarError):
            if list(parse(turn)) == [(role, text)]:
                return turn
    raise ValueError("a turn can't be rendered")


def end_of(text: str, mark: str, at: int) -> int:
    """Where mark first stands with no odd number of backslashes before it; -1 if nowhere."""
    while (at := text.find(mark, at)) >= 0:
        before = text[:at] if at < 64 else text[at - 64 : at]
        slashes = len(before) - len(before.rstrip("\\"))
        if slashes == len(before):  # a long run
            slashes = at - len(text[:at].rstrip("\\"))
        if slashes % 2 == 0:
            return at
        at += 1
    return -1


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn; an error where the text doesn't follow the grammar."""
    at = 0
    while at < len(formatted):
        name, opening, closing = next((x for x in (USER, ASSISTANT, OTHER) if formatted.startswith(x[1], at)), (None, None, None))
        if opening is None:
            raise GrammarError(f"no turn opens at {at}")
        at += len(opening)
        if name is None:
            stop = end_of(formatted, "\n", at)
            if stop < 0:
                raise GrammarError("a role doesn't end")
            name, at = unescaped(formatted[at:stop]), stop + 1
        stop = end_of(formatted, closing, at)
        if stop < 0:
            raise GrammarError("a turn doesn't close")
        yield name, unescaped(formatted[at:stop])
        at = stop + len(closing)


def format_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, formatted: the conversations' text is `formatted` in the order of turn, role, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roles, texts = b.column("role").to_pylist(), b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(map(render, roles, texts), pa.string())], names=["conv_id", "turn", "role", "text", "formatted"])

    plain = rows.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "coalesce(cast(role as string), '') role", "coalesce(cast(text as string), '') text")
    return map_batches(plain, run, "conv_id long, turn long, role string, text string, formatted string")


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation, read back from `formatted`: turns, what is under the loss mask (assistant texts), and lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, conv, rows = False, None, []
        n = chars = loss = 0
        whole = masked = hashlib.sha256()

        def row() -> tuple:
            return conv, n, whole.hexdigest(), loss, masked.hexdigest(), chars

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            for c, formatted in zip(b.column("conv_id").to_pylist(), b.column("formatted").to_pylist(), strict=True):
                if not started or c != conv:
                    if started:
                        rows.append(row())
                    started, conv, n, chars, loss, whole, masked = True, c, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                chars += len(formatted)
                for role, text in parse(formatted):
                    n += 1
                    whole.update(f"{role}\n{text}\n".encode())
                    if role == ASSISTANT[0]:
                        loss += len(text)
                        masked.update(text.encode())
            yield flush()
            rows = []
        if started:
            rows.append(row())
            yield flush()

    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "formatted")
    return map_batches(dealt, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
