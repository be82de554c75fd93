"""Near duplicates by SimHash: fingerprints that differ in few bits, met in the middle.

1. A text becomes its shingles of three words, repeats included; a fingerprint bit is 1 where
   over half of the shingles' 64-bit hashes have it. Equal fingerprints are one class, and only
   classes go on, so copies never meet.
2. Two fingerprints within ``RADIUS`` = 3 bits share a number half way between them. Balls of
   radius two round every fingerprint would find it, 2,081 numbers each. Here one of the three
   bits is spent first: the 64 bits are cut into ``BLOCKS`` parts, and without the part that
   holds a bit in which two fingerprints differ, two bits are left, one for each side. So every
   fingerprint emits, for each part left out, all numbers within one bit of the rest: 131.
3. The numbers are shuffled with least and greatest fingerprint and a count, combined before the
   shuffle. Two fingerprints that meet alone are verified at once. Where more meet, their list
   is compared inside a task, each different list once, and only links that join parts of the
   list come out, never all pairs.
4. A number at which more than ``BUCKET`` meet (they agree outside one part and may differ much
   in it) is left to the balls of radius two: round one number there are at most 65
   fingerprints within one bit and 2,081 within two, all linked through any of the first, so
   each is linked to the least of those, without comparing.

Every link is found, whatever the sizes of groups. Components are then drawn together.

Defined cases: a null text is empty; a text without words has fingerprint zero and is linked
like any other; a null id takes part and is no one's smallest id; repeated rows are one class;
ties cannot arise, as components do not depend on an order; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from songloom.llm.common import sized, stored, text_of
from songloom.llm.components import connect
from songloom.llm.hashing import U, mix
from songloom.operators.skew import HOT_ROWS, join_unique

SHINGLE = 3
SEED = 42
RADIUS = 3
BLOCKS = (21, 21, 22)
BUCKET = 2048
# So much of a text is hashed at once.
PART_BYTES = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _parts(text: bytes) -> Iterator[bytes]:
    """A text in parts cut between words."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + PART_BYTES)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def shingle_hashes(text: bytes) -> Iterator[np.ndarray]:
    """Hashes of all shingles of a text, part after part."""
    carried: list[bytes] = []
    some = False
    for part in _parts(text):
        words = carried + part.lower().split()
        if len(words) < SHINGLE:
            carried = words
            continue
        some = True
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        digest = xxhash.xxh64_intdigest
        pairs = zip(starts[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist())
        yield np.array([digest(line[a:b], SEED) for a, b in pairs], np.uint64)
        carried = words[len(words) - SHINGLE + 1 :]
    if not some and carried:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(carried), SEED)], np.uint64)


def fingerprint_of(text: bytes) -> int:
    """Bits set in over half of the shingles' hashes."""
    ones, total = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text):
        for at in range(0, len(hashes), 1 << 14):
            some = hashes[at : at + (1 << 14)]
            ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            total += len(some)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def _fingerprint():
    @F.arrow_udf("long")
    def fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [fingerprint_of(t.as_py()) for t in texts.cast(pa.large_binary())]
            yield pa.array(np.array(found, np.uint64).view(np.int64))

    return fingerprint.asNondeterministic()


def _masks() -> list[int]:
    """The bits of each part."""
    at, out = 0, []
    for size in BLOCKS:
        out.append(((1 << size) - 1) << at)
        at += size
    return out


def rest_variants(fingerprints: np.ndarray) -> np.ndarray:
    """``(fingerprints, 131)``: what is within one bit of each, with one part left out in turn."""
    columns = []
    for number, mask in enumerate(_masks()):
        rest = fingerprints & U(~mask & (2**64 - 1))
        flips = [0, *[1 << i for i in range(64) if not mask >> i & 1]]
        # Each part has numbers of its own.
        columns.append(mix(rest[:, None] ^ np.array(flips, np.uint64), number + 1))
    return np.concatenate(columns, axis=1)


def ball_variants(fingerprints: np.ndarray, radius: int) -> np.ndarray:
    """``(fingerprints, n)``: all numbers within ``radius`` bits."""
    flips = [sum(1 << i for i in bits) for n in range(radius + 1) for bits in combinations(range(64), n)]
    return fingerprints[:, None] ^ np.array(flips, np.uint64)


def emitted(fingerprints: DataFrame, of: Callable[[np.ndarray], np.ndarray], name: str) -> DataFrame:
    """``f`` and each of its numbers under ``name``."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                some = batch.column(0).slice(at, 512)
                found = of(some.to_numpy(zero_copy_only=False).view(np.uint64))
                offsets = pa.array(np.arange(len(found) + 1, dtype="int32") * found.shape[1])
                lists = pa.ListArray.from_arrays(offsets, pa.array(found.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([some, lists], ["f", "all"])

    # A task for each part of the work: a small table may be in one file.
    tasks = int(fingerprints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = fingerprints.select("f").repartition(tasks, "f")
    return spread.mapInArrow(emit, "f long, all array<long>").select("f", F.explode("all").alias(name))


def _close(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS


def spanning_links(numbers: np.ndarray) -> list[tuple[int, int]]:
    """Links within ``RADIUS`` among some fingerprints that join what is not joined yet."""
    root, links = np.arange(len(numbers)), []
    for i in range(len(numbers) - 1):
        near = np.flatnonzero(np.bitwise_count(numbers[i + 1 :] ^ numbers[i]) <= RADIUS) + i + 1
        for j in near.tolist():
            if root[j] != root[i]:
                links.append((i, j))
                root[root == root[j]] = root[i]
    return links


def _listed_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(0)
        values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        offsets = lists.offsets.to_numpy()
        a, b = [], []
        for first, last in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            for i, j in spanning_links(values[first:last]):
                a.append(first + i)
                b.append(first + j)
        held = values.view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(held[np.array(a, np.int64)]), pa.array(held[np.array(b, np.int64)])], ["a", "b"])


def _ball_links(crowded: DataFrame) -> DataFrame:
    """All that links the fingerprints ``f`` of a table, through balls of radius one and two."""
    hubs = emitted(crowded, lambda f: ball_variants(f, 1), "v").groupBy("v").agg(F.min("f").alias("a"))
    two = emitted(crowded, lambda f: ball_variants(f, 2), "v")
    return two.join(hubs, "v").where("a <> f").select("a", F.col("f").alias("b"))


def links_between(classes: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``a, b``: links that join all fingerprints ``f`` (each once) within ``RADIUS`` bits; stored."""
    meeting = emitted(classes, rest_variants, "key")
    # Nearly all numbers are met once, so nothing is gained by counting before the shuffle.
    met = stored(
        meeting.repartition("key").groupBy("key").agg(F.min("f").alias("a"), F.max("f").alias("b"), F.count(F.lit(1)).alias("n")).where("a <> b")
    )
    found = met.where((F.col("n") == 2) & _close("a", "b")).select("a", "b")
    more = sized(met.where("n > 2").select("key", "n"))
    members = stored(meeting.join(more, "key").select("key", "n", "f"))
    lists = members.where(F.col("n") <= bucket).groupBy("key").agg(F.sort_array(F.collect_list("f")).alias("fs"))
    found = found.unionByName(lists.select("fs").distinct().mapInArrow(_listed_links, "a long, b long"))
    crowded = members.where(F.col("n") > bucket).select("f").distinct()
    if not crowded.isEmpty():
        found = found.unionByName(_ball_links(stored(crowded)))
    return stored(found.distinct())


def simhash_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", bucket: int = BUCKET, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``."""
    rows = stored(docs.select(F.col(id).alias("doc_id"), _fingerprint()(text_of(text)).alias("f")))
    classes = stored(rows.groupBy("f").agg(F.min("doc_id").alias("least")))
    links = links_between(classes.select("f"), bucket)
    named = classes
    if not links.isEmpty():
        parts = connect(links)
        joined = classes.alias("c").join(parts.alias("p"), F.expr("c.f = p.node"), "left")
        named = joined.select("c.f", "c.least", F.coalesce("p.component", "c.f").alias("component"))
        smallest = named.groupBy("component").agg(F.min("least").alias("least"))
        named = named.drop("least").join(smallest, "component").select("f", "least")
    found = join_unique(rows, stored(named), ["f"], spread="doc_id", hot_rows=hot_rows)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id")
    )
