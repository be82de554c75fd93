"""Packing documents into sequences of a fixed number of tokens.

Bounded-space online best-fit: a task keeps at most ``OPEN_BINS`` sequences open. Their
free spaces are the set bits of one integer, so the sequence that a piece fits best is the
lowest set bit from its length up. When too many are open, the fullest one closes. What is
still open when a task has read all its documents goes, with its pieces, into a second round
that joins ``TASKS_TOGETHER`` tasks, longest pieces first.

The documents are not shuffled at all; of the second round's pieces only places and
lengths are.

Defined cases: a null text is empty; an empty text is the end token alone; only documents
longer than a sequence are cut, the short piece first; a null id is kept; repeated rows are
packed each; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from songloom.llm.common import stored, text_of

CAPACITY = 2048
OPEN_BINS = 1024
TASKS_TOGETHER = 64
END = 0
# A task remembers the ids of this many units of text, then starts anew.
UNITS = 600_000

# A unit begins at a single space between two other characters. Byte-level tokenizers of
# this kind never join characters across such a place, so units are encoded on their own.
_ALONE = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACE = re.compile(r" \s|\s |\A\s|\s\Z")


# Fixed value: how byte-level BPE files of this kind cut a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def _ranked(path: str):
    """The file's merges as ranks, which encode short strings faster; None if they are no such."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, letters = spec["model"], _byte_letters()
    cut = spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or spec.get("normalizer"):
        return None
    added = {t["content"] for t in spec.get("added_tokens", [])}
    vocabulary = {t: i for t, i in model["vocab"].items() if t not in added}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [vocabulary.get(a + b, -1) for a, b in merges]
    if any(a >= b for a, b in zip(made, made[1:])) or any(c not in letters for t in vocabulary for c in t):
        return None
    import tiktoken

    ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items()}
    return tiktoken.Encoding("units", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class _Units(dict):
    """Ids by unit, without the space before it; what is missing is encoded."""

    def __init__(self, encode: Callable[[str], bytes]) -> None:
        self.encode = encode

    def __missing__(self, unit: str) -> bytes:
        found = self[unit] = self.encode(" " + unit)
        return found


class UnitTokenizer:
    """Token ids of whole texts, as little-endian 32-bit integers; each unit is encoded once.

    The ids are those of the ``tokenizers`` library. Units go through the same merges as
    ranks where the file allows that and samples agree.
    """

    def __init__(self, path: str) -> None:
        # One thread per task; Spark runs the tasks.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = _Units(self._one)
        self.ranked = _ranked(path)
        self.whole = False
        samples = ["On it's 12 pages, he\nsaid — «no» ok.", "Ärger\t\tüber 3.5%!!", "naïve 東京  \n x"]
        exact = self._exact(samples)
        if self.ranked and [array("I", self.ranked(s)).tobytes() for s in samples] != exact:
            self.ranked = None
        self.whole = self.encode(samples) != exact

    def _exact(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _one(self, text: str) -> bytes:
        return array("I", self.ranked(text)).tobytes() if self.ranked else self._exact([text])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.whole:
            return self._exact(texts)
        if len(self.known) > UNITS:
            self.known.clear()
        out = []
        for text in texts:
            if any(s in text for s in self.special):
                # A text with a special string is left to the library as a whole.
                out.append(self._exact([text])[0])
                continue
            first, *rest = text.split(" ") if not _OTHER_SPACE.search(text) else _ALONE.split(text)
            out.append(self._one(first) + b"".join(map(self.known.__getitem__, rest)))
        return out


class BestFit:
    """Open bins by free space, at most ``most`` of them."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most = capacity, most
        self.bits, self.count, self.bins = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        found = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        self.count -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """Bin and offset of a piece."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin = self._take(free)
        else:
            free, bin = self.capacity, self.bins
            self.bins += 1
        left = free - length
        if left:
            if not self.by_free[left]:
                self.bits |= 1 << left
            self.by_free[left].append(bin)
            self.count += 1
            if self.count > self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return bin, self.capacity - free

    def open(self) -> set[int]:
        return set(chain.from_iterable(self.by_free))


def cut(length: int, capacity: int) -> Iterator[tuple[int, int]]:
    """Start and length of the pieces of a document; the first one takes the remainder."""
    first = length % capacity or min(length, capacity)
    yield 0, first
    for start in range(first, length, capacity):
        yield start, capacity


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, task int, open boolean"


def _pieces(path: str, capacity: int, most: int, with_ids: bool):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer = UnitTokenizer(path), BestFit(capacity, most)
        task = TaskContext.get().partitionId()
        end = np.array([END], "<u4").tobytes()
        held: list[pa.Table] = []
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 256):
                rows, tokens = [], []
                for doc_id, data in zip(ids[at : at + 256], tokenizer.encode(texts[at : at + 256].to_pylist())):
                    data += end
                    for piece, (start, length) in enumerate(cut(len(data) // 4, capacity)):
                        own = data[4 * start : 4 * (start + length)]
                        rows.append((doc_id, piece, start, length, zlib.crc32(own), *packer.place(length)))
                        if with_ids:
                            tokens.append(np.frombuffer(own, "<u4").astype("int32"))
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset"]
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                columns += [pa.array(np.full(len(rows), task, "int32"))]
                names += ["task"]
                if with_ids:
                    names, columns = [*names, "ids"], [*columns, pa.array(tokens, pa.list_(pa.int32()))]
                held.append(pa.table(columns, names))
            # Which bins stay open is known at the end; a piece's row is some 70 bytes.
        if held:
            whole = pa.concat_tables(held)
            still = np.array(sorted(packer.open()), "int64")
            is_open = pa.array(np.isin(whole["bin"].to_numpy(), still))
            place = whole.column_names.index("task") + 1
            yield from whole.add_column(place, "open", is_open).to_batches(max_chunksize=10_000)

    return pieces


def _second_round(capacity: int, most: int):
    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "task", "bin", "offset"], ascending=[False, True, True, True])
        packer = BestFit(capacity, most)
        bins, offsets = zip(*[packer.place(n) for n in pdf["length"].tolist()])
        return pdf.assign(new_bin=np.array(bins, "int64"), new_offset=np.array(offsets, "int64"))

    return packed


def pack(
    docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text",
    capacity: int = CAPACITY, open_bins: int = OPEN_BINS, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    ``tokenizer`` is the path of a byte-level tokenizer file. ``with_ids`` adds the tokens.
    Places are written before they are used, so a task that runs again changes none.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")
    texts = docs.select(F.col(id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    first = stored(texts.mapInArrow(_pieces(tokenizer, capacity, open_bins, with_ids), schema))

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids]
    closed = first.where("not open").withColumn("sequence_id", F.shiftleft(F.col("task").cast("long"), 33) + F.col("bin"))
    # The least number of second-round tasks that keeps each of them bounded.
    group = F.expr(f"task div {TASKS_TOGETHER}").cast("long")
    left = first.where("open").select("task", "bin", "offset", "length", group.alias("team"))
    places = left.groupBy("team").applyInPandas(
        _second_round(capacity, 1 << 30),
        "task int, bin long, offset long, length long, team long, new_bin long, new_offset long",
    )
    again = first.where("open").drop("length").alias("f").join(
        places.alias("p"), F.expr("f.task = p.task and f.bin = p.bin and f.offset = p.offset")
    ).select(
        "f.doc_id", "f.piece", "f.start", "p.length", "f.ids_crc32", F.col("p.new_offset").alias("offset"),
        # The top bits tell the rounds apart.
        (F.lit(1 << 62) + F.shiftleft(F.col("p.team"), 33) + F.col("p.new_bin")).alias("sequence_id"),
        *[F.col("f.ids")] * with_ids,
    )
    return closed.select(*columns).unionByName(again.select(*columns))
