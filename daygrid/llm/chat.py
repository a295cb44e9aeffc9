"""Chat formatting from event logs.

A log says how messages came about: whole messages, streamed deltas, edits and regenerations. Logs are dealt out by
conversation and sorted by turn and sequence; each task folds its events in one pass into final messages and renders
them, one row per message. Only the message at hand is held in memory, so a conversation may be as long as it likes.

Events: ``message`` starts a message of its own; ``delta`` appends to the turn's message and starts it where there is
none; ``edit`` replaces the text of the turn's message (and its role, where the event has one); ``regenerate`` drops
the text so far, deltas after it build the new one. Any other kind raises an error.

Template: ``<s>`` role newline text ``</s>`` newline. Control strings and backslashes in texts get a backslash (after
the first character of a control string), so no text can forge a turn, and dropping backslashes restores the text. The
loss mask covers the text of assistant turns.

Defined cases: null texts and roles are empty; a null conversation id is a conversation of its own; equal turns are
ordered by sequence, role and text; repeated ``message`` rows are messages each; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Control strings of common chat templates (fixed values).
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_ESCAPED = re.compile("|".join(["\\\\", *map(re.escape, CONTROL)]))
_ESCAPED_ROLE = re.compile("|".join(["\\\\", "\n", *map(re.escape, CONTROL)]))
_TURN = re.compile(r"<s>((?:[^\\\n]|\\.)*)\n(.*?)</s>\n", re.DOTALL)
_BACKSLASH = re.compile(r"\\(.)", re.DOTALL)


def _slashed(m: re.Match) -> str:
    x = m.group()
    return "\\" + x if len(x) == 1 else x[0] + "\\" + x[1:]


def escape(text: str) -> str:
    return _ESCAPED.sub(_slashed, text)


def unescape(text: str) -> str:
    return _BACKSLASH.sub(r"\1", text)


def render(role: str, text: str) -> str:
    return f"<s>{_ESCAPED_ROLE.sub(_slashed, role)}\n{escape(text)}</s>\n"


def parse(formatted: str) -> tuple[list[tuple[str, str, int, int]], int]:
    """Complete turns in ``formatted``: (role, text, start and end of the escaped text); how much was read."""
    turns, at = [], 0
    while m := _TURN.match(formatted, at):
        turns.append((unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)))
        at = m.end()
    return turns, at


def fold(events: Iterator[tuple]) -> Iterator[tuple]:
    """Final messages (conv_id, role, text) from sorted events (conv_id, turn, kind, role, text)."""
    key, role, parts = None, "", None
    for conv, turn, kind, who, text in events:
        if parts is not None and ((conv, turn) != key or kind == "message"):
            yield key[0], role, "".join(parts)
            parts = None
        if parts is None:
            key, role, parts = (conv, turn), who or "", []
        if kind in ("message", "delta"):
            parts.append(text or "")
        elif kind == "edit":
            role, parts = who or role, [text or ""]
        elif kind == "regenerate":
            role, parts = who or role, []
        else:
            raise ValueError(f"unknown kind of event: {kind}")
    if parts is not None:
        yield key[0], role, "".join(parts)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def formatted(events: DataFrame) -> DataFrame:
    """Rendered messages in order within each task: conv_id, message (from 0), role, output, loss.

    ``loss`` is true where the output's text is under the loss mask. Events: conv_id, turn, seq, kind, role, text.
    """
    sortable = events.select("conv_id", "turn", "kind", "role", "text", "seq")
    dealt = sortable.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "seq", "role", "text").drop("seq")
    id_type = events.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_field, out, size, last, n = None, [], 0, object(), 0

        def batch() -> pa.RecordBatch:
            names = ["conv_id", "message", "role", "output", "loss"]
            kinds = [id_field, pa.int64(), pa.string(), pa.string(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

        def noted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal id_field
            for b in batches:
                id_field = b.schema.field(0).type
                yield b

        for conv, role, text in fold(_rows(noted(batches))):
            n = n + 1 if conv == last else 0
            last = conv
            out.append((conv, n, role, render(role, text), role == "assistant"))
            size += len(text)
            if len(out) >= 2000 or size > 4_000_000:
                yield batch()
                out, size = [], 0
        if out:
            yield batch()

    return dealt.mapInArrow(run, f"conv_id {id_type.simpleString()}, message long, role string, output string, loss boolean")


def digests(messages: DataFrame) -> DataFrame:
    """What a reader gets back from the output of ``formatted``: one row per conversation; reads it as one stream."""
    id_type = messages.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, id_field = [], None
        conv, started = None, False

        def closed() -> tuple:
            if rest:
                raise ValueError(f"conversation {conv}: output ends inside a turn")
            return conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

        for batch in batches:
            id_field = batch.schema.field(0).type
            for who, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not started or who != conv:
                    if started:
                        out.append(closed())
                    conv, started, rest = who, True, ""
                    n_turns, turns, loss_chars, loss, chars = 0, hashlib.sha256(), 0, hashlib.sha256(), 0
                rest += text
                chars += len(text)
                found, at = parse(rest)
                for role, said, a, b in found:
                    n_turns += 1
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    if role == "assistant":
                        masked = unescape(rest[a:b])
                        loss_chars += len(masked)
                        loss.update(masked.encode("utf-8", "surrogatepass"))
                rest = rest[at:]
        if started:
            out.append(closed())
        if out:
            kinds = [id_field, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    schema = (
        f"conv_id {id_type.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
    return messages.select("conv_id", "output").mapInArrow(run, schema)


def message_events(conversations: DataFrame) -> DataFrame:
    """Rows of whole messages (conv_id, turn, role, text) as an event log."""
    return conversations.select(
        "conv_id", "turn", F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), "role", F.col("text").cast("string").alias("text")
    )
