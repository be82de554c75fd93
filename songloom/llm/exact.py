"""Exact dedup by content-defined chunk recipes.

A text is cut where a rolling hash of its last 32 bytes has ``MASK_BITS`` zero bits, so equal
stretches of texts are cut alike. Its recipe is the ordered list of its chunks'
identifiers. Recipes, some 16 bytes per 2 kB of text, are what is grouped; texts stay where
they are.

An identifier starts as a digest. Of texts whose recipes agree, and only of those, the
chunks are then compared byte for byte: per digest the least and the greatest content,
combined before the shuffle, so a chunk moves once per task however many copies there are.
A digest with two contents is no identifier; there the content itself takes its place in
the recipe.

Defined cases: a null text is the empty text, whose recipe is empty; a null id is a value
like others, smaller than any; of rows equal in id and text one stays; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from songloom.llm.common import keep_marked, stored, text_of
from songloom.llm.hashing import buffer_of
from songloom.operators.skew import even_rows, join_unique

WINDOW = 32
MASK_BITS = 11
SHORTEST = 256
LONGEST = 16_384
DIGEST_BYTES = 16
# Repeated recipes are broadcast up to so many bytes.
BROADCAST_BYTES = 8 << 20
# So much of a batch is hashed at once.
PART_BYTES = 1 << 20

# One random 64-bit number per byte value, for the rolling hash.
_GEAR = np.random.default_rng(20240501).integers(0, 2**63, 256, dtype=np.uint64)


def _hits(data: np.ndarray) -> np.ndarray:
    """Positions after which a chunk may end: the hash of the last 32 bytes fits the mask."""
    found = [np.zeros(0, np.int64)]
    for at in range(0, len(data), PART_BYTES):
        # The bytes before a part reach into the hashes of its first ones.
        lead = min(at, WINDOW)
        h = _GEAR[data[at - lead : at + PART_BYTES]]
        for step in (1, 2, 4, 8, 16):
            moved = np.zeros_like(h)
            moved[step:] = h[:-step] << np.uint64(step)
            h += moved
        # The window's bytes all reach the bits from 32 up.
        fits = (h[lead:] >> np.uint64(WINDOW)) & np.uint64((1 << MASK_BITS) - 1) == 0
        found.append(np.flatnonzero(fits) + at + 1)
    return np.concatenate(found)


def chunk_ends(data: np.ndarray, hits: np.ndarray, start: int, end: int) -> list[int]:
    """Chunk ends of ``data[start:end]``, as offsets in it. ``hits`` are those of all data."""
    ends, last = [], start
    for hit in hits[np.searchsorted(hits, start + SHORTEST) : np.searchsorted(hits, end)].tolist():
        while hit - last > LONGEST:
            last += LONGEST
            ends.append(last - start)
        if hit - last >= SHORTEST:
            ends.append(hit - start)
            last = hit
    while end - last > LONGEST:
        last += LONGEST
        ends.append(last - start)
    if end > last:
        ends.append(end - start)
    return ends


def _recipe(digest_bytes: int):
    @F.arrow_udf("struct<ids:array<binary>,ends:array<int>>")
    def recipe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            data, offsets = buffer_of(texts)
            hits = _hits(data)
            # A hash that looks at bytes before the text is no hit: those lie below SHORTEST.
            ids, ends, counts = [], [], []
            for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                cuts, last = chunk_ends(data, hits, start, end), start
                for cut in cuts:
                    ids.append(hashlib.blake2b(data[last : start + cut], digest_size=digest_bytes).digest())
                    last = start + cut
                ends.extend(cuts)
                counts.append(len(cuts))
            at = pa.array(np.concatenate([[0], np.cumsum(counts, dtype="int64")]).astype("int32"))
            lists = [pa.ListArray.from_arrays(at, pa.array(ids, pa.binary())), pa.ListArray.from_arrays(at, pa.array(ends, pa.int32()))]
            yield pa.StructArray.from_arrays(lists, ["ids", "ends"])

    # So marked, Spark never copies the call into a filter and cuts the text twice.
    return recipe.asNondeterministic()


def _contents(text: Column, ends: Column) -> Column:
    """The chunks of a text as ``array<binary>``."""
    data = F.encode(text, "UTF-8")
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))
    return F.transform(ends, lambda end, i: F.substring(data, start(i) + 1, end - start(i)))


def with_recipe(docs: DataFrame, text: str = "text", digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """Add ``_text`` and ``_chunks``: the text and its ``ids`` and ``ends``."""
    return docs.withColumn("_text", text_of(text)).withColumn("_chunks", _recipe(digest_bytes)("_text"))


def clashing(docs: DataFrame, recipes: DataFrame, text: str = "text", digest_bytes: int = DIGEST_BYTES) -> list[bytes]:
    """Digests that stand for more than one content, among texts with equal recipes.

    With 16 bytes none is to be expected in any corpus (n^2 / 2^129), so the list is short.
    """
    repeated = recipes.where(F.size("recipe") > 0).groupBy("recipe").agg(F.count(F.lit(1)).alias("n"))
    repeated = stored(repeated.where("n > 1").select("recipe"))
    # A recipe grows with its text, so its bytes count.
    bytes_ = repeated.agg(F.sum(F.size("recipe") * (digest_bytes + 16) + 32)).first()[0] or 0
    repeated = F.broadcast(repeated) if bytes_ <= BROADCAST_BYTES else repeated
    chunks = (
        with_recipe(docs.select(text), text, digest_bytes)
        .join(repeated, F.col("_chunks.ids") == F.col("recipe"), "left_semi")
        .select(F.explode(F.arrays_zip(F.col("_chunks.ids").alias("id"), _contents(F.col("_text"), F.col("_chunks.ends")).alias("content"))).alias("c"))
        .groupBy("c.id").agg(F.min("c.content").alias("lo"), F.max("c.content").alias("hi"))
    )
    return [row.id for row in chunks.where("lo <> hi").select("id").collect()]


def recipes_of(docs: DataFrame, id: str = "doc_id", text: str = "text", digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """``row, doc_id, text_sha256, recipe``, stored: a number of its own per row of ``docs``."""
    def rows(recipe: Column) -> DataFrame:
        return stored(
            with_recipe(docs.select(F.col(id).alias("doc_id"), F.col(text)), text, digest_bytes)
            .select(
                F.monotonically_increasing_id().alias("row"), "doc_id",
                F.sha2(F.encode("_text", "UTF-8"), 256).alias("text_sha256"), recipe.alias("recipe"),
            )
        )

    found = rows(F.col("_chunks.ids"))
    clashes = clashing(docs, found, text, digest_bytes)
    if not clashes:
        return found
    known = F.array(*[F.lit(c) for c in clashes])
    contents = _contents(F.col("_text"), F.col("_chunks.ends"))
    # An identifier is as long as a digest, or has a whole content after it.
    spelled = F.zip_with(F.col("_chunks.ids"), contents, lambda i, c: F.when(F.array_contains(known, i), F.concat(i, c)).otherwise(i))
    return rows(spelled)


def exact_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    The row with the largest id stays.
    """
    rows = recipes_of(docs, id, text, digest_bytes)
    groups = rows.groupBy("recipe").agg(F.max(F.struct("doc_id", "row")).alias("last"), F.count(F.lit(1)).alias("group_size"))
    # One text, the empty one as well, may be a third of all rows.
    joined = join_unique(rows, groups, ["recipe"], "inner", spread="row", hot_rows=even_rows(rows.count()))
    return joined.select(
        "doc_id", F.col("last.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("last.row")).alias("kept"), "text_sha256",
    )


def drop_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    verdicts = exact_groups(docs, id, text).select("doc_id", F.col("text_sha256").alias("key"), "kept")
    return keep_marked(docs, stored(verdicts), F.sha2(F.encode(text_of(F.col(f"row.`{text}`")), "UTF-8"), 256), id)
