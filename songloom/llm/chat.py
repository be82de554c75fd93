"""Conversations as training texts with a loss mask, assembled as bytes in columns.

The template: ``<s>``, role, newline, text, ``</s>`` per turn. A control string inside a role
or text gets a backslash after its first character, and one that already has backslashes
there gets one more, so that none survives and reading back takes exactly one away:
``</s>`` becomes ``<\\/s>``. In roles, backslashes and newlines are escaped before that.

A batch of turns is never joined as strings. Lengths of headers, texts and ends give
offsets by running sums; a scatter index per segment copies all of them into one buffer,
which becomes the Arrow column with one offset per conversation.

Turns come to a task by conversation, sorted, and stream through it. A conversation is one
row, or, beyond ``PART_BYTES``, several rows with ``part`` 0, 1, .. cut between turns, so
that memory does not grow with it. (Its digest is a chain over its turns, so one task reads
all turns of a conversation, in bounded memory.)

Defined cases: a null text or role is empty; turns are in order of turn (null last), role,
text; equal rows are turns of their own; a null conversation id is one conversation; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from songloom.llm.common import text_of
from songloom.llm.hashing import buffer_of

# The template's marks and the control strings of common chat templates.
START, END = "<s>", "</s>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
LEARNED = "assistant"

PART_BYTES = 8 << 20
# Segments from this length on are copied as slices; shorter ones share a scatter index.
LONG_BYTES = 1 << 14

FORMATTED = "conv_id long, part int, n_turns long, formatted string, loss array<struct<start:long,length:long>>"


def _rests() -> dict[str, str]:
    """Pattern of what follows the first character of control strings, by that character."""
    by_first: dict[str, list[str]] = {}
    for control in CONTROL:
        escaped = "".join("\\" + c if c in "[]|<>/.^$*+?(){}\\" else c for c in control[1:])
        by_first.setdefault(control[0], []).append(escaped)
    return {first: "|".join(rests) for first, rests in by_first.items()}


def escape(texts: pa.Array) -> pa.Array:
    for first, rests in _rests().items():
        texts = pc.replace_substring_regex(texts, rf"(\{first}\\*)({rests})", r"\1\\\2")
    return texts


def unescape(texts: pa.Array) -> pa.Array:
    for first, rests in _rests().items():
        texts = pc.replace_substring_regex(texts, rf"(\{first}\\*)\\({rests})", r"\1\2")
    return texts


def escape_role(roles: pa.Array) -> pa.Array:
    return escape(pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n"))


def unescape_role(role: str) -> str:
    plain = unescape(pa.array([role]))[0].as_py()
    return "\n".join(p.replace("\\\\", "\\") for p in _unescaped_newlines(plain))


def _unescaped_newlines(role: str) -> list[str]:
    """Pieces between ``\\n`` whose backslash is not itself escaped."""
    pieces, at, i = [], 0, 0
    while i < len(role) - 1:
        if role[i] == "\\":
            if role[i + 1] == "n":
                pieces.append(role[at:i])
                at = i + 2
            i += 2
        else:
            i += 1
    return [*pieces, role[at:]]


def _copy(out: np.ndarray, to: np.ndarray, data: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> None:
    """Copy segments of ``data`` into ``out``: one scatter index for all short ones."""
    long = lengths >= LONG_BYTES
    for t, a, n in zip(to[long].tolist(), at[long].tolist(), lengths[long].tolist()):
        out[t : t + n] = data[a : a + n]
    to, at, lengths = to[~long], at[~long], lengths[~long]
    step = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(to, lengths) + step] = data[np.repeat(at, lengths) + step]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Turns as bytes: the buffer, each turn's end, and where its text starts and its length."""
    kinds = pc.fill_null(roles, "").dictionary_encode()
    heads = pc.binary_join_element_wise(START, escape_role(kinds.dictionary), "\n", "")
    head_data, head_at = buffer_of(heads)
    kind = kinds.indices.to_numpy()
    data, at = buffer_of(escape(pc.fill_null(texts, "")))
    end = np.frombuffer(END.encode(), np.uint8)

    head_lengths, lengths = np.diff(head_at)[kind], np.diff(at)
    ends = np.cumsum(head_lengths + lengths + len(end))
    starts = ends - head_lengths - lengths - len(end)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    _copy(out, starts, head_data, head_at[:-1][kind], head_lengths)
    _copy(out, starts + head_lengths, data, at[:-1], lengths)
    _copy(out, ends - len(end), end, np.zeros(len(ends), np.int64), np.full(len(ends), len(end)))
    return out, ends, starts + head_lengths, lengths


def _rows(keys: list, part: int, table: pa.Table) -> pa.RecordBatch:
    """Output rows of whole turns; ``keys`` has (conversation, first turn, last turn + 1)."""
    out, ends, at, lengths = assemble(table["role"].combine_chunks(), table["text"].combine_chunks())
    cuts = np.array([0, *[ends[last - 1] for _, _, last in keys]], np.int64)
    formatted = pa.LargeStringArray.from_buffers(len(keys), pa.py_buffer(cuts), pa.py_buffer(out)).cast(pa.string())
    learned = pc.equal(pc.fill_null(table["role"].combine_chunks(), ""), LEARNED).to_numpy(zero_copy_only=False)
    places = np.flatnonzero(learned)
    begins = np.array([first for _, first, _ in keys])
    row = np.searchsorted(begins, places, side="right") - 1
    spans = pa.StructArray.from_arrays([pa.array(at[places] - cuts[row]), pa.array(lengths[places])], ["start", "length"])
    per_row = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(keys)))]).astype("int32")
    parts = np.zeros(len(keys), "int32")
    parts[0] = part
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k for k, _, _ in keys], pa.int64()), pa.array(parts), pa.array([b - a for _, a, b in keys], pa.int64()),
            formatted, pa.ListArray.from_arrays(pa.array(per_row), spans),
        ],
        ["conv_id", "part", "n_turns", "formatted", "loss"],
    )


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns in; a row per conversation, or per part of a very long one, out."""
    held: list[pa.Table] = []
    part, parted = 0, None

    def size(tables: list[pa.Table]) -> int:
        return sum(t["text"].nbytes for t in tables)

    def emit(table: pa.Table, part: int) -> pa.RecordBatch:
        ids = table["conv_id"].to_pylist()
        starts = [i for i, x in enumerate(ids) if i == 0 or x != ids[i - 1]]
        return _rows([(ids[a], a, b) for a, b in zip(starts, [*starts[1:], len(ids)])], part, table)

    for batch in batches:
        # Slices keep what is assembled at once small; the open conversation waits.
        whole = pa.Table.from_batches([batch])
        for at in range(0, len(whole), 512):
            table = pa.concat_tables([*held, whole.slice(at, 512)])
            last = table["conv_id"][-1].as_py()
            ids = table["conv_id"].to_pylist()
            begin = len(ids) - 1
            while begin and ids[begin - 1] == last:
                begin -= 1
            if part and ids[0] != parted:
                # The conversation that was cut ended with its last part.
                part = 0
            if begin:
                yield emit(table.slice(0, begin), part)
                part = 0
            held = [table.slice(begin)]
            if size(held) > PART_BYTES:
                yield emit(held[0], part)
                held, part, parted = [], part + 1, last
    if held:
        yield emit(held[0], part if parted == held[0]["conv_id"][0].as_py() else 0)


def format_chats(turns: DataFrame) -> DataFrame:
    """Conversations of rows ``conv_id, turn, role, text`` in the template.

    ``loss`` has start and length, in bytes, of every text to learn from.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", text_of("role").alias("role"), text_of("text").alias("text")
    )
    return (
        rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
        .select("conv_id", "role", "text").mapInArrow(_format, FORMATTED)
    )


def read_chat(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    turns = [t.removeprefix(START).partition("\n") for t in formatted.split(END)[:-1]]
    texts = unescape(pa.array([text for _, _, text in turns], pa.large_string())).to_pylist()
    return list(zip([unescape_role(role) for role, _, _ in turns], texts))


@dataclass
class _Digest:
    """What is read back from one conversation, part after part."""

    conv_id: int | None
    turns: int = 0
    chars: int = 0
    loss_chars: int = 0
    all: "hashlib._Hash" = field(default_factory=hashlib.sha256)
    loss: "hashlib._Hash" = field(default_factory=hashlib.sha256)

    def add(self, formatted: str, spans: list[dict]) -> None:
        turns = read_chat(formatted)
        self.turns += len(turns)
        self.chars += len(formatted)
        for role, text in turns:
            self.all.update(f"{role}\n{text}\n".encode())
        data = formatted.encode()
        under = [data[s["start"] : s["start"] + s["length"]].decode() for s in spans]
        for text in unescape(pa.array(under, pa.large_string())).to_pylist():
            self.loss_chars += len(text)
            self.loss.update(text.encode())


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_: _Digest | None = None

    def rows(done: list[_Digest]) -> pa.RecordBatch:
        columns = zip(*[(d.conv_id, d.turns, d.all.hexdigest(), d.loss_chars, d.loss.hexdigest(), d.chars) for d in done])
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in DIGEST.split(", ")])

    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if row["part"] == 0:
                if open_:
                    done.append(open_)
                open_ = _Digest(row["conv_id"])
            open_.add(row["formatted"], row["loss"])
        if done:
            yield rows(done)
    if open_:
        yield rows([open_])


def digests(formatted: DataFrame) -> DataFrame:
    """Read formatted conversations back, in the tasks that made them: one row each."""
    return formatted.mapInArrow(_digests, DIGEST)
