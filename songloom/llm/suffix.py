"""Bytes of long passages that repeat anywhere in a corpus, and texts without them.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts elsewhere. Suffix
arrays of a corpus don't fit a task, so strings that can be equal are first brought together:

1. The anchor of a string is the 32-byte piece in it with the least hash, the leftmost of
   equal ones. Equal strings have equal anchors. Neighbouring strings mostly share theirs;
   such a run of strings, up to 368 bytes of text, is a context. Every string of a text lies
   in exactly one context. What is shuffled is an anchor's hash, a context's hash and its
   place, about once per 80 bytes; counts are combined before.
2. An anchor seen once goes. An anchor with one context, seen twice or more, is repeated as a
   whole, and so is any context seen twice: no text moves for it.
3. For the others one copy of each context is fetched. Contexts of an anchor come to one
   task, which sorts their suffixes and finds common prefixes by increasing value: the
   boundary between two rows of the Burrows-Wheeler matrix, extended backwards by a
   character, is a boundary one longer. After ``LENGTH`` rounds of this the rows without a
   boundary between them share that many bytes.
4. An anchor with more than ``GROUP_BYTES`` of different contexts (a passage in very many
   documents) is split: strings are told apart by where their anchor lies in them, and
   those of one half all contain certain further bytes, which join the key. Halving goes on
   until groups fit or strings with one place are left, which are then equal or not.

Matches are found by bytes in step 3, by 64-bit hashes of contexts with equal anchors in 2.

Defined cases: a null text is empty; a text below ``LENGTH`` bytes keeps all; of repeated
rows or texts, each loses what the others have, all of it; a null id is a value; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from songloom.llm.common import sized, stored, text_of
from songloom.llm.hashing import Stretches, U, buffer_of, runs
from songloom.operators.skew import even_rows, join_unique

LENGTH = 200
PIECE = 32
CHUNK_BYTES = 1 << 20
BLOCK_BYTES = 2 << 20
GROUP_BYTES = 4 << 20
_SEPARATOR = 0xFF  # in no UTF-8 text

CONTEXT = "h long, c long, s int, w int, p int"


def contexts(data: np.ndarray, offsets: np.ndarray, hashes: Stretches, length: int) -> tuple[np.ndarray, ...]:
    """Contexts of the texts in a buffer: text, anchor hash, context hash, start, strings, anchor place."""
    width = length - PIECE + 1
    pieces = len(data) - PIECE + 1
    sizes = np.diff(offsets)
    strings = np.maximum(sizes - length + 1, 0)
    if not strings.sum():
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    sums = hashes.sums(data)
    at = np.arange(pieces)
    hashed = hashes.of(sums, at, at + PIECE)
    # The place in the low bits makes the leftmost of equal pieces the least.
    low = U((1 << int(len(data)).bit_length()) - 1)
    keys = (hashed & ~low) | at.astype(np.uint64)
    # Least key of every ``width`` neighbours, from running minima of blocks in both directions.
    full = -(-pieces // width) * width
    padded = np.full(full, ~U(0), np.uint64)
    padded[:pieces] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = pieces - width + 1
    anchor = (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & low).astype(np.int64)

    text = np.repeat(np.arange(len(sizes)), strings)
    first = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(strings)[:-1]]), strings)
    starts = np.arange(len(text)) + first
    own = anchor[starts]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (text[1:] != text[:-1])])
    new = np.flatnonzero(new)
    count = np.diff(np.concatenate([new, [len(text)]]))
    begin, place, text = starts[new], own[new], text[new]
    whole = hashes.of(sums, begin, begin + count - 1 + length, 77)
    return text, hashed[place].view(np.int64), whole.view(np.int64), begin - offsets[text], count, place - begin


def _contexts(length: int):
    @F.arrow_udf(f"array<struct<{CONTEXT.replace(' ', ':').replace(',:', ',')}>>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hashes = Stretches(CHUNK_BYTES + length)
        for texts in batches:
            data, offsets = buffer_of(texts)
            found: list[tuple] = []
            for first, last in runs(offsets, CHUNK_BYTES):
                # A very long text is read in overlapping parts; each string is in one of them.
                for start in range(int(offsets[first]), max(int(offsets[last]), int(offsets[first]) + 1), CHUNK_BYTES):
                    end = min(start + CHUNK_BYTES + length - 1, int(offsets[last]))
                    inner = offsets[first : last + 1].clip(start, end) - start
                    text, *rest = contexts(data[start:end], inner, hashes, length)
                    rest[2] = rest[2] + start - offsets[first + text].clip(max=start) if start > offsets[first] else rest[2]
                    found.append((text + first, *rest))
            text, h, c, s, w, p = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(6))
            at = np.searchsorted(text, np.arange(len(texts) + 1)).astype("int32")
            small = [pa.array(x.astype("int32")) for x in (s, w, p)]
            rows = pa.StructArray.from_arrays([pa.array(h.astype("int64")), pa.array(c.astype("int64")), *small], ["h", "c", "s", "w", "p"])
            yield pa.ListArray.from_arrays(pa.array(at), rows)

    return find.asNondeterministic()


def sorted_suffixes(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and its inverse, in order to ``depth`` bytes at least."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    keys = np.zeros(n, np.uint64)
    for i in range(8):
        keys = (keys << U(8)) | padded[i : n + i]
    order = np.argsort(keys)
    # A suffix's rank is the first place of those equal to it so far.
    new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    done = 8
    while done < depth:
        # Only suffixes that are still equal to others are sorted again.
        last = np.concatenate([new[1:], [True]])
        open_places = np.flatnonzero(~(new & last))
        if not len(open_places):
            break
        those = order[open_places]
        # Both ranks in one number; a suffix that ends before ``done`` bytes comes first.
        pair = (rank[those].astype(np.uint64) << U(32)) | (rank[np.minimum(those + done, n)] + 1).astype(np.uint64)
        inner = np.argsort(pair)
        those, pair = those[inner], pair[inner]
        order[open_places] = those
        fresh = np.concatenate([[True], pair[1:] != pair[:-1]])
        new[open_places] |= fresh
        rank[those] = open_places[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        done *= 2
    rank[order] = np.arange(n)
    return order, rank[:n]


def repeated_starts(data: np.ndarray, length: int) -> np.ndarray:
    """Where a string of ``length`` bytes starts that also starts elsewhere.

    Rows are the sorted suffixes. Row q begins with c and continues with the suffix of row
    ``after[q]``: backward extension by c takes that row to row q. A boundary of value v lies
    before row q if the two rows' common prefix has v bytes. Boundaries of value 0 are where
    the first byte changes. Between rows q - 1 and q lies a boundary of value v + 1 as soon
    as one of value v lies between the rows that they extend, so each round extends what the
    last one found, and nothing after round ``length - 1``.
    """
    order, rank = sorted_suffixes(data, length)
    after = np.append(rank, -1)[order + 1]
    byte = data[order]
    boundary = np.concatenate([[True], byte[1:] != byte[:-1]])
    # Mostly rows q - 1 and q extend neighbours p - 1 and p; then q is looked up from p.
    neighbours = np.concatenate([[False], after[1:] == after[:-1] + 1]) & ~boundary
    before = np.full(len(data), -1)
    rows = np.flatnonzero(neighbours)
    before[after[rows]] = rows
    wide = np.flatnonzero(~neighbours & ~boundary)
    left, right = after[wide - 1], after[wide]
    new = np.flatnonzero(boundary)
    for _ in range(length - 1):
        direct = before[new]
        direct = direct[direct >= 0]
        # The end of the data, row -1, comes before all rows.
        reached = np.searchsorted(new, right, "right") > np.searchsorted(new, left, "right")
        found = np.concatenate([direct[~boundary[direct]], wide[reached]])
        if not len(found):
            break
        boundary[found] = True
        wide, left, right = wide[~reached], left[~reached], right[~reached]
        new = np.sort(found)
    still = np.flatnonzero(~boundary)
    return np.unique(np.concatenate([order[still], order[still - 1]]))


SPAN = "doc_id long, hash long, start int, end int"


def _match_groups(length: int):
    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; whole groups are matched, several in one block."""

        def solve(block: list[pa.Table]) -> pa.RecordBatch:
            t = pa.concat_tables(block).combine_chunks()
            bytes_, offsets = buffer_of(t["ctx"].combine_chunks())
            sizes = np.diff(offsets)
            begin = offsets[:-1] - offsets[0] + np.arange(len(sizes))
            data = np.full(int(sizes.sum()) + len(sizes), _SEPARATOR, np.uint8)
            inside = np.ones(len(data), bool)
            inside[begin + sizes] = False
            data[inside] = bytes_[offsets[0] : offsets[-1]]
            at = repeated_starts(data, length)
            row = np.searchsorted(begin, at, side="right") - 1
            offset = at - begin[row]
            w, n, s = (t[c].to_numpy() for c in ("w", "n", "s"))
            # A context seen more than once is repeated as a whole; that is known before.
            wanted = (offset < w[row]) & (n[row] == 1)
            row, start = row[wanted], (s[row] + offset)[wanted]
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)]) if len(row) else np.zeros(0, bool)
            new = np.flatnonzero(new)
            last = np.concatenate([new[1:], [len(row)]]) - 1 if len(new) else new
            picked = pa.array(row[new])
            return pa.RecordBatch.from_arrays(
                [t["doc_id"].combine_chunks().take(picked), t["hash"].combine_chunks().take(picked), pa.array(start[new].astype("int32")), pa.array((start[last] + length).astype("int32"))],
                ["doc_id", "hash", "start", "end"],
            )

        held, size = [], 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = table["g"].to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            previous = held[-1]["g"][-1].as_py() if held else None
            for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if size >= BLOCK_BYTES and keys[first] != previous:
                    yield solve(held)
                    held, size = [], 0
                part = table.slice(first, last - first)
                held.append(part)
                size += part["ctx"].nbytes
                previous = keys[first]
        if held:
            yield solve(held)

    return matched


def _halves(length: int, low: Column, high: Column) -> Column:
    """A context as up to two: strings whose anchor is ``low..mid`` or ``mid..high`` bytes in.

    All strings of a half contain the bytes from ``low`` before the anchor to what the
    string with the anchor farthest in still reaches.
    """
    mid = F.expr("(lo + hi) div 2")

    def half(lo: Column, hi: Column) -> Column:
        # The string from offset o in the context has its anchor p - o bytes in.
        first, last = F.greatest(F.lit(0), F.col("p") - hi + 1), F.least(F.col("w") - 1, F.col("p") - lo)
        common = F.substring(F.col("ctx"), F.col("p") - lo + 1, length - (hi - 1) + lo)
        ctx = F.substring(F.col("ctx"), first + 1, last - first + length)
        return F.when(first <= last, F.struct(
            F.xxhash64("g", lo, hi, common).alias("g"), lo.alias("lo"), hi.alias("hi"),
            (F.col("s") + first).cast("int").alias("s"), (last - first + 1).cast("int").alias("w"), (F.col("p") - first).cast("int").alias("p"),
            F.xxhash64(ctx).alias("c"), ctx.alias("ctx"),
        ))

    return F.filter(F.array(half(low, mid), half(mid, high)), lambda x: x.isNotNull())


def _split(groups: DataFrame, length: int) -> tuple[DataFrame, DataFrame | None]:
    """Groups small enough to match, and spans found while splitting the others."""
    spans = None
    groups = groups.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(length - PIECE + 1))
    done = None
    while True:
        large = sized(stored(
            groups.groupBy("g").agg(F.sum(F.length("ctx")).alias("b"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
            .where(f"b > {GROUP_BYTES} and hi - lo > 1").select("g")
        ))
        fits = groups.join(large, "g", "left_anti")
        if large.isEmpty():
            rest = fits
            return (rest if done is None else done.unionByName(rest)), spans
        done = fits if done is None else done.unionByName(fits)
        halved = stored(
            groups.join(large, "g").withColumn("x", F.explode(_halves(length, F.col("lo"), F.col("hi"))))
            .select("doc_id", "hash", "n", "x.*")
        )
        # As for whole contexts: equal ones are repeated, and one of them stands for all.
        counted = halved.groupBy("g", "c").agg(F.sum("n").alias("t"), F.min(F.struct("doc_id", "hash", "s")).alias("one"))
        others = counted.groupBy("g").agg(F.count(F.lit(1)).alias("k"))
        judged = stored(
            halved.join(counted, ["g", "c"]).join(others, "g").withColumn("stands", F.struct("doc_id", "hash", "s") == F.col("one"))
        )
        found = judged.where("t > 1").select("doc_id", "hash", F.col("s").alias("start"), (F.col("s") + F.col("w") - 1 + length).alias("end"))
        spans = found if spans is None else spans.union(found)
        groups = judged.where("k > 1 and stands").withColumn("n", F.col("t")).select(*groups.columns)


def _without(length: int):
    @F.arrow_udf("struct<n_removed:long,n_spans:long,kept_sha256:string,kept:string>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            out = []
            for text, found in zip(texts.cast(pa.large_binary()).to_pylist(), spans.to_pylist()):
                kept, at, removed, n = [], 0, 0, 0
                for span in sorted(found or [], key=lambda x: x["start"]):
                    start, end = span["start"], span["end"]
                    if start > at or n == 0:
                        kept.append(text[at:start])
                        n += 1
                        removed += end - start
                        at = end
                    elif end > at:
                        removed += end - at
                        at = end
                kept.append(text[at:])
                data = b"".join(kept)
                out.append((removed, n, hashlib.sha256(data).hexdigest(), data.decode("utf-8", "ignore")))
            columns = list(zip(*out)) or [(), (), (), ()]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["n_removed", "n_spans", "kept_sha256", "kept"])

    return cut.asNondeterministic()


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, hash, spans`` of the texts that lose something; rows of ``doc_id, _text``."""
    found = stored(
        docs.where(F.octet_length("_text") >= length)
        .select("doc_id", F.xxhash64("_text").alias("hash"), _contexts(length)("_text").alias("x"))
    )
    each = found.select("doc_id", "hash", F.explode("x").alias("x")).select("doc_id", "hash", "x.*")
    anchors = each.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    anchors = stored(anchors.where("n > 1").select("h", "n", (F.col("lo") != F.col("hi")).alias("mixed")))
    # A passage that many texts share is one anchor.
    hot = even_rows(anchors.agg(F.sum("n")).first()[0] or 0)
    hits = stored(join_unique(each, anchors.select("h", "mixed"), ["h"], "inner", spread="hash", hot_rows=hot, counted=anchors))
    span = [F.col("s").alias("start"), (F.col("s") + F.col("w") - 1 + length).alias("end")]
    spans = hits.where("not mixed").select("doc_id", "hash", *span)

    counted = stored(
        hits.where("mixed").groupBy("h", "c").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "hash", "s", "w", "p")).alias("one")
        )
    )
    often = counted.where("n > 1")
    again = join_unique(
        hits.where("mixed").withColumn("spread", F.xxhash64("hash", "s")), often.select("h", "c"), ["h", "c"], "inner", spread="spread",
        hot_rows=hot, counted=often,
    )
    spans = spans.union(again.select("doc_id", "hash", *span))

    # One copy of each context: places per text, then one look at those texts.
    places = counted.groupBy("one.doc_id", "one.hash").agg(
        F.collect_list(F.struct("h", "n", "one.s", "one.w", "one.p")).alias("places")
    )
    at = lambda x: F.substring(F.encode(F.col("d._text"), "UTF-8"), x["s"] + 1, x["w"] - 1 + length)
    fetched = (
        docs.withColumn("hash", F.xxhash64("_text")).alias("d")
        .join(places.alias("p"), F.expr("d.doc_id <=> p.doc_id and d.hash = p.hash"))
        .select("d.doc_id", "d.hash", F.explode(F.transform("p.places", lambda x: F.struct(
            x["h"].alias("g"), x["n"].alias("n"), x["s"].alias("s"), x["w"].alias("w"), x["p"].alias("p"), at(x).alias("ctx")
        ))).alias("x"))
        .select("doc_id", "hash", "x.*")
    )
    # Rows equal in id and text were fetched twice.
    groups = stored(fetched.dropDuplicates(["doc_id", "hash", "s"]).withColumn("c", F.xxhash64("ctx")))
    small, more = _split(groups, length)
    if more is not None:
        spans = spans.union(more)
    matched = (
        small.select("g", "doc_id", "hash", "n", "s", "w", "ctx").repartition("g").sortWithinPartitions("g")
        .mapInArrow(_match_groups(length), SPAN)
    )
    spans = spans.union(matched)
    # A set, so rows equal in id and text add nothing to it.
    return spans.groupBy("doc_id", "hash").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept``.

    ``kept`` is what stays as text; characters cut in two are left out of it, while the
    digest is of the bytes.
    """
    plain = docs.select(F.col(id).cast("long").alias("doc_id"), text_of(text).alias("_text"))
    spans = stored(repeated_spans(plain, length))
    joined = plain.withColumn("hash", F.xxhash64("_text")).alias("d").join(
        spans.alias("s"), F.expr("d.doc_id <=> s.doc_id and d.hash = s.hash"), "left"
    )
    return joined.select(
        "d.doc_id", F.octet_length("d._text").cast("long").alias("n_bytes"), _without(length)("d._text", "s.spans").alias("x")
    ).select("doc_id", "n_bytes", "x.*")
