"""Near-duplicate documents: MinHash bands propose, odd sketches estimate, sets confirm.

1. A text becomes the set of its distinct shingles of five words (a shorter text is one
   shingle), ``BANDS * ROWS`` MinHash samples of it, a key per band, and an odd sketch: each
   sample flips one of 1024 bits. The bits in which two sketches differ count the samples
   that differ, precisely where most agree.
2. Equal sets are one class, and only one row per class goes on, so copies never meet.
3. In a bucket (documents with an equal band key) the one with the least number leads. Each
   other member is compared with the leader only: a bucket of m makes m - 1 pairs. Pairs
   whose sketches say less than ``ESTIMATE`` go (six standard deviations below the
   threshold); the rest is confirmed on the full sets, most likely links first, and pairs
   inside a component are not needed any more.
4. Buckets in which members besides the leader are still in different components are
   compared in full, by sketch and then by set, in blocks of ``BLOCK`` members; only links
   that join components leave a task.

So a link is lost only if it shares no band: below 2e-6 for a pair at the threshold and
5e-8 at 0.8, whatever the size of its group.

Defined cases: a null text, or one without words, has an empty set and links with nothing;
a null id takes part and is no one's smallest id; repeated rows are one class; ties cannot
arise, as components do not depend on an order; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from songloom.llm.common import keep_marked, sized, stored, text_of
from songloom.llm.components import connect
from songloom.llm.hashing import Stretches, U, buffer_of, mix, runs
from songloom.operators.skew import even_rows, join_unique

SHINGLE = 5
PERCENT = 75
BANDS = 50
ROWS = 5
BITS = 1024
ESTIMATE = 0.58
BLOCK = 1_000
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _word_hashes(data: np.ndarray, offsets: np.ndarray, hashes: Stretches) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in the rows of a buffer, and where each row's words begin."""
    low = _LOWER[data]
    inside = np.empty(len(low) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[low], out=inside[1:-1])
    edges = inside[1:] != inside[:-1]
    # A row's end ends its last word: a cut between two letters is an end and a start.
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(low))]
    joined = np.unique(cuts[inside[cuts] & inside[cuts + 1]])
    at = np.flatnonzero(edges)
    starts = np.sort(np.concatenate([at[0::2], joined]))
    ends = np.sort(np.concatenate([at[1::2], joined]))
    return hashes.of(hashes.sums(low), starts, ends), np.searchsorted(starts, offsets)


def _row_shingles(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of one text's word hashes."""
    n = len(words)
    if n == 0:
        return words
    size = min(SHINGLE, n)
    # Order and length count: every place has its own multiplier.
    h = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        h = mix(h + words[i : n - size + 1 + i], 2 * i + 1)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def shingles_per_row(texts: pa.Array, hashes: Stretches) -> Iterator[np.ndarray]:
    """The shingle set of each text, as sorted 64-bit hashes."""
    data, offsets = buffer_of(texts)
    for first, last in runs(offsets, CHUNK_BYTES):
        part = data[offsets[first] : offsets[last]]
        words, begin = _word_hashes(part, offsets[first : last + 1] - offsets[first], hashes)
        for i in range(last - first):
            yield _row_shingles(words[begin[i] : begin[i + 1]])


class Signer:
    """MinHash samples, band keys and odd sketches of many sets at once."""

    def __init__(self) -> None:
        rng = np.random.default_rng(7)
        self.factors = rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
        self.shifts = rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)

    def samples(self, sets: list[np.ndarray]) -> np.ndarray:
        """``(samples, sets)``; no set is empty."""
        out = np.empty((BANDS * ROWS, len(sets)), np.uint32)
        sizes = np.array([len(s) for s in sets])
        at = np.concatenate([[0], np.cumsum(sizes)])
        for first, last in runs(at, 1 << 16):
            x = (np.concatenate(sets[first:last]) >> U(32)).astype(np.uint32)
            starts = at[first:last] - at[first]
            held = np.empty_like(x)
            for i in range(BANDS * ROWS):
                np.multiply(x, self.factors[i], out=held)
                held += self.shifts[i]
                out[i, first:last] = np.minimum.reduceat(held, starts)
        return out

    def bands(self, samples: np.ndarray) -> np.ndarray:
        """``(sets, bands)``: a key per band; keys of different bands differ."""
        rows = samples.astype(np.uint64).reshape(BANDS, ROWS, -1)
        keys = np.repeat(np.arange(BANDS, dtype=np.uint64)[:, None] + U(1), samples.shape[1], axis=1)
        for r in range(ROWS):
            keys = mix(keys + rows[:, r], r + 11)
        return np.ascontiguousarray(keys.T)

    def sketches(self, samples: np.ndarray) -> np.ndarray:
        """``(sets, BITS / 64)``: the parity of the samples that fall on each bit."""
        n = samples.shape[1]
        place = np.arange(BANDS * ROWS, dtype=np.uint64)[:, None] << U(32)
        bits = (mix(samples.astype(np.uint64) | place, 5) >> U(54)).astype(np.int64)
        cells = (bits + np.arange(n) * BITS).ravel()
        odd = np.bincount(cells, minlength=n * BITS).astype(np.uint8) & 1
        return np.packbits(odd).view(np.uint64).reshape(n, BITS // 64)


def _lists(values: np.ndarray) -> pa.Array:
    n, width = values.shape
    at = pa.array(np.arange(n + 1, dtype="int32") * width)
    return pa.ListArray.from_arrays(at, pa.array(values.ravel().view(np.int64)))


def _signature():
    @F.arrow_udf("struct<n:long,f:long,g:long,bands:array<long>,sketch:array<long>>")
    def signature(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes, signer = Stretches(CHUNK_BYTES), Signer()
        for texts in batches:
            n = len(texts)
            sizes, prints = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64)
            bands, sketches = np.zeros((n, BANDS), np.uint64), np.zeros((n, BITS // 64), np.uint64)
            held, places, total = [], [], 0

            def sign() -> None:
                samples = signer.samples(held)
                bands[places] = signer.bands(samples)
                sketches[places] = signer.sketches(samples)

            for i, found in enumerate(shingles_per_row(texts, hashes)):
                if len(found):
                    sizes[i] = len(found)
                    # Sums over the set: equal sets, and only they, agree in both and in size.
                    prints[i] = mix(found, 21).sum(), mix(found, 22).sum()
                    held.append(found)
                    places.append(i)
                    total += len(found)
                if total > 1 << 18 or len(held) == 1000:
                    sign()
                    held, places, total = [], [], 0
            if held:
                sign()
            columns = [pa.array(sizes), pa.array(prints[:, 0].view(np.int64)), pa.array(prints[:, 1].view(np.int64)), _lists(bands), _lists(sketches)]
            yield pa.StructArray.from_arrays(columns, ["n", "f", "g", "bands", "sketch"])

    return signature


def _shingle_set():
    @F.arrow_udf("array<long>")
    def shingle_set(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = Stretches(CHUNK_BYTES)
        for texts in batches:
            sets = list(shingles_per_row(texts, hashes))
            at = np.concatenate([[0], np.cumsum([len(s) for s in sets], dtype="int64")]).astype("int32")
            values = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.ListArray.from_arrays(pa.array(at), pa.array(values))

    return shingle_set


def estimated(a: Column, b: Column) -> Column:
    """Jaccard similarity from two odd sketches."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    samples = F.log(F.greatest(1 - 2.0 * differ / BITS, F.lit(1e-9))) / float(np.log(1 - 2.0 / BITS))
    return 1 - samples / (2 * BANDS * ROWS)


def _sizes_fit(a: str, b: str) -> Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _with_sketches(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Likely links among ``a, b``, with the estimate."""
    side = classes.select("node", "n", "sketch")
    return (
        pairs.alias("p").join(side.alias("x"), F.expr("p.a = x.node")).join(side.alias("y"), F.expr("p.b = y.node"))
        .where(_sizes_fit("x.n", "y.n"))
        .select("p.a", "p.b", estimated(F.col("x.sketch"), F.col("y.sketch")).alias("likely"))
        .where(F.col("likely") >= ESTIMATE)
    )


def _sets_of(nodes: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``node, set``: the full shingle set of one document of each class, stored."""
    keys = sized(stored(nodes.join(classes.select("node", "example"), "node").select("node", "example.*")))
    texts = docs.withColumn("_hash", F.xxhash64("_text")).alias("d").join(
        keys.alias("k"), F.expr("d.doc_id <=> k.doc_id and d._hash = k.hash")
    )
    return stored(texts.select("k.node", _shingle_set()(F.col("d._text")).alias("set")).dropDuplicates(["node"]))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose sets overlap enough."""
    both = F.size(F.array_intersect("x.set", "y.set"))
    return (
        pairs.alias("p").join(sets.alias("x"), F.expr("p.a = x.node")).join(sets.alias("y"), F.expr("p.b = y.node"))
        .where(100 * both >= PERCENT * (F.size("x.set") + F.size("y.set") - both))
        .select("p.a", "p.b")
    )


def _crossing(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component yet; ``parts`` may lack single nodes."""
    x, y = parts.alias("x"), parts.alias("y")
    apart = F.coalesce("x.component", "p.a") != F.coalesce("y.component", "p.b")
    return pairs.alias("p").join(x, F.expr("p.a = x.node"), "left").join(y, F.expr("p.b = y.node"), "left").where(apart).select("p.*")


def _compare_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between the two sides of a block pair, or inside one block.

    Sketches choose which members a member is compared with in full. What a link joins is
    one component from then on, so no more links come out than the block has members.
    """
    left, right = pdf[pdf["side"] != 1], pdf[pdf["side"] != 0]
    bits = np.stack(right["sketch"].to_numpy()).view(np.uint64)
    n, node, sets = right["n"].to_numpy(), right["node"].to_numpy(), right["set"].to_numpy()
    root, own_root = right["component"].to_numpy(copy=True), left["component"].to_numpy(copy=True)
    most = (1 - (1 - 2 / BITS) ** (2 * BANDS * ROWS * (1 - ESTIMATE))) * BITS / 2
    links = []
    for i, (a, size, sketch, own) in enumerate(zip(left["node"], left["n"], left["sketch"], left["set"])):
        fits = np.flatnonzero((100 * np.minimum(size, n) >= PERCENT * np.maximum(size, n)) & (root != own_root[i]))
        fits = fits[np.bitwise_count(bits[fits] ^ sketch.view(np.uint64)).sum(axis=1) <= most]
        # Neighbours are compared together, some hundred thousand shingles at a time.
        for first, last in runs(np.concatenate([[0], np.cumsum(n[fits])]), 1 << 18):
            some = fits[first:last]
            # Sets are sorted as unsigned numbers.
            own, all_ = own.view(np.uint64), np.concatenate(sets[some]).view(np.uint64)
            place = np.minimum(np.searchsorted(own, all_), len(own) - 1)
            both = np.add.reduceat((own[place] == all_).astype(np.int64), np.cumsum(n[some]) - n[some])
            for j in some[100 * both >= PERCENT * (size + n[some] - both)].tolist():
                if root[j] != own_root[i]:
                    links.append((min(a, node[j]), max(a, node[j])))
                    old, new = root[j], own_root[i]
                    root[root == old] = new
                    own_root[own_root == old] = new
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def _open_links(banded: DataFrame, leaders: DataFrame, parts: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between members that share a bucket, no leader and no component."""
    members = (
        banded.alias("m").join(leaders.where("n > 2").alias("l"), "key").where("m.node <> l.leader").select("key", "m.node")
        .alias("m").join(parts.alias("c"), F.expr("m.node = c.node"), "left")
        .select("key", "m.node", F.coalesce("c.component", "m.node").alias("component"))
        .join(classes.select("node", "n"), "node")
    )
    # A block holds so many members, and so many shingles, at most (one member's may be more).
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("total") / (BLOCK * 1000))).cast("int")
    split = members.groupBy("key").agg(
        F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("total")
    ).where("lo <> hi").select("key", blocks.alias("blocks"))
    members = stored(members.join(split, "key"))
    sets = _sets_of(members.select("node").distinct(), classes, docs)
    # Block i meets every block: as the left side with later ones, as the right with earlier.
    placed = members.withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meets = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sided = meets.select(
        "key", F.least("i", "j").alias("left"), F.greatest("i", "j").alias("right"),
        F.when(F.col("i") == F.col("j"), 2).when(F.col("i") < F.col("j"), 0).otherwise(1).alias("side"),
        "node", "n", "component",
    )
    full = sided.join(classes.select("node", "sketch"), "node").join(sets, "node")
    return full.groupBy("key", "left", "right").applyInPandas(_compare_block, "a long, b long").distinct()


def signatures(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, hash, s``: the signature of every whole text, stored."""
    df = docs.select(F.col(id).alias("doc_id"), text_of(text).alias("_text"))
    return stored(df.select("doc_id", F.xxhash64("_text").alias("hash"), _signature()("_text").alias("s")).select("doc_id", "hash", "s.*"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, hash, n_shingles, component, component_id, kept``: one row per document.

    ``hash`` is the text's ``xxhash64``; ``component`` a number per group of linked texts,
    null without words; ``component_id`` the smallest id in it.
    """
    plain = docs.select(F.col(id).alias("doc_id"), text_of(text).alias("_text"))
    signed = signatures(docs, id, text)
    classes = stored(
        signed.where("n > 0").groupBy("n", "f", "g").agg(
            F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "hash")).alias("example"),
            F.first("bands").alias("bands"), F.first("sketch").alias("sketch"),
        ).withColumn("node", F.monotonically_increasing_id())
    )
    banded = classes.select("node", F.explode("bands").alias("key"))
    leaders = stored(
        banded.groupBy("key").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    in_bands = leaders.agg(F.sum("n")).first()[0] or 0
    led = join_unique(banded, leaders.select("key", "leader"), ["key"], "inner", spread="node", hot_rows=even_rows(in_bands), counted=leaders)
    led = led.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    likely = stored(_with_sketches(led, classes))
    nodes = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
    sets = _sets_of(nodes, classes, plain)

    # The likeliest leader of each member first; the others only where that left them apart.
    first = likely.groupBy("b").agg(F.max(F.struct("likely", "a")).alias("best")).select("best.a", "b")
    links = stored(_confirmed(first, sets))
    parts = connect(links)
    second = stored(_crossing(likely.join(first, ["a", "b"], "left_anti"), parts))
    if not second.isEmpty():
        links = links.unionByName(stored(_confirmed(second, sets)))
        parts = connect(links)
    third = stored(_open_links(banded, leaders, parts, classes, plain))
    if not third.isEmpty():
        links = links.unionByName(third)
        parts = connect(links)

    named = classes.select("node", "n", "f", "g", "least").alias("c").join(parts.alias("p"), F.expr("c.node = p.node"), "left")
    named = named.select("c.*", F.coalesce("p.component", "c.node").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    known = stored(named.join(smallest, "component").select("n", "f", "g", "component", "component_id"))
    # All copies of one text meet its class, so they are spread.
    rows = signed.select("doc_id", "hash", "n", "f", "g")
    joined = join_unique(rows, known, ["n", "f", "g"], spread="doc_id", hot_rows=even_rows(signed.count()))
    return joined.select(
        "doc_id", "hash", F.col("n").alias("n_shingles"), "component",
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, with all its columns: the one with the smallest id.

    A null id comes after all others. Texts without words stay.
    """
    found = stored(near_duplicates(docs, id, text))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("hash").alias("hash"))
    first = found.where("component is not null").groupBy("component").agg(F.min(rank).alias("first"))
    verdicts = found.alias("f").join(first.alias("x"), F.expr("f.component = x.component"), "left").select(
        "f.doc_id", F.col("f.hash").alias("key"),
        (F.col("x.first").isNull() | F.col("f.doc_id").eqNullSafe(F.col("x.first.doc_id")) & (F.col("f.hash") == F.col("x.first.hash"))).alias("kept"),
        F.col("x.first").isNull().alias("wordless"),
    )
    # Rows without words are no copies of each other, so they never count as repeated.
    return keep_marked(docs, stored(verdicts.where("not wordless").drop("wordless")), F.xxhash64(text_of(F.col(f"row.`{text}`"))), id)
