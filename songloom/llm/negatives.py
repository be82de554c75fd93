"""Hard negatives for every anchor and positive, selected by slots of scores.

Vectors are rounded down to whole 256ths, so scores are integers. Anchors are cut into blocks
of at most ``BLOCK_BYTES``; one block at a time is broadcast by Spark and every row meets it in
a task, as a product of matrices a slice at a time. A task keeps, for each anchor, only the
best, and what tasks kept is cut again per anchor: no row of scores is ever stored.

1. Positives: an anchor's first ``POSITIVES`` other rows with its label.
2. A positive asks for the best negatives between a lower and an upper share of its own score,
   so the windows of one anchor overlap. Their upper limits cut the scores into disjoint slots.
   Tasks keep the first ``NEGATIVES`` per anchor and slot, whatever the window.
3. All slots of an anchor, in descending order, are one list of at most
   ``POSITIVES * NEGATIVES``. A window begins where its slot begins and its answer is what
   comes first from there, down to its lower limit, so one list answers all windows.

Nothing is grouped by label, so a label with most rows is no hot key; an anchor's rows in the
shuffle are a few per task.

Defined cases: a null label or vector, or a null or non-finite component, keeps a row out, and
so does a null id, which no result could name; an empty vector scores 0; vectors of different
lengths do not meet; rows that repeat an id count once, as the one with the least label and
vector; ties go by id; a positive with a negative score has an empty window; an anchor without
positives or negatives has no rows; an empty table gives an empty result; a score beyond 64
bits is an error; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from songloom.llm.common import sized, stored

ANCHOR_EVERY = 100
POSITIVES = 5
NEGATIVES = 10
PERCENT = (30, 90)
SCALE = 256
BLOCK_BYTES = 4 << 20
# Scores of so many pairs are held at once.
PAIRS = 1 << 21

_LEAST = np.iinfo(np.int64).min


def prepared(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", label: Column | str = "label") -> DataFrame:
    """``id, label, v`` of the rows that take part, ``v`` in whole 256ths; stored."""
    label = F.col(label) if isinstance(label, str) else label
    whole = F.transform(F.col(vector), lambda x: F.lit(float(SCALE)) * x.cast("double"))
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col(id).isNotNull() & F.col(vector).isNotNull() & label.isNotNull()
    found = stored(
        rows.where(usable & F.coalesce(finite, F.lit(False)))
        .select(F.col(id).cast("long").alias("id"), label.cast("long").alias("label"), whole.alias("v"))
        .mapInArrow(_floored, "id long, label long, v array<double>")
    )
    repeated = stored(found.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id"))
    if repeated.isEmpty():
        return found
    repeated = sized(repeated)
    one = found.join(repeated, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.*")
    return stored(found.join(repeated, "id", "left_anti").unionByName(one))


def _floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components rounded down, as doubles: Spark's own ``floor`` would cut large ones."""
    for batch in batches:
        lists = batch.column(2)
        start = lists.offsets[0].as_py()
        values = np.floor(lists.flatten().to_numpy(zero_copy_only=False))
        offsets = pa.array(lists.offsets.to_numpy() - start, pa.int32())
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.ListArray.from_arrays(offsets, pa.array(values))], batch.schema.names)


class Block:
    """Anchors of one length as a matrix, and what is known of each."""

    def __init__(self, held: pa.StructArray) -> None:
        def column(name: str) -> np.ndarray:
            return held.field(name).to_numpy(zero_copy_only=False)

        self.ids, self.labels = column("id"), column("label")
        vectors = held.field("v")
        self.length = len(vectors[0])
        self.matrix = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(held), self.length)
        self.most = np.abs(self.matrix).max(initial=0)
        names = [f.name for f in held.type]
        if "uppers" in names:
            # Descending limits; what is missing is below every score.
            lists = held.field("uppers").to_pylist()
            self.uppers = np.full((len(held), max(map(len, lists))), _LEAST)
            for i, limits in enumerate(lists):
                self.uppers[i, : len(limits)] = limits
            self.lowest = column("lowest")

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """``(rows, anchors)``, exact."""
        if self.most * np.abs(rows).max(initial=0) * self.length < 2.0**53:
            return (rows @ self.matrix.T).astype(np.int64)
        exact = np.array([int(x) for x in rows.ravel()], object).reshape(rows.shape)
        other = np.array([int(x) for x in self.matrix.ravel()], object).reshape(self.matrix.shape)
        return np.array((exact @ other.T).tolist(), np.int64).reshape(len(rows), len(other))


class Best:
    """The first ``k`` rows of each group, by descending score and id."""

    def __init__(self, groups: int, k: int) -> None:
        self.k = k
        self.least = np.full(groups, _LEAST)
        self.group, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, group: np.ndarray, score: np.ndarray, id: np.ndarray) -> None:
        may = score >= self.least[group]
        if not may.any():
            return
        group, score, id = (np.concatenate(x) for x in ((self.group, group[may]), (self.score, score[may]), (self.id, id[may])))
        order = np.lexsort((id, -score, group))
        group, score, id = group[order], score[order], id[order]
        first = np.searchsorted(group, group)
        kept = np.arange(len(group)) - first < self.k
        self.group, self.score, self.id = group[kept], score[kept], id[kept]
        last = np.arange(len(group)) - first == self.k - 1
        self.least[group[last]] = score[last]


def _positives(block: Block, best: Best, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> None:
    row, anchor = np.nonzero((labels[:, None] == block.labels) & (ids[:, None] != block.ids) & (scores >= best.least))
    best.add(anchor, scores[row, anchor], ids[row])


def _negatives(block: Block, best: Best, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> None:
    row, anchor = np.nonzero((labels[:, None] != block.labels) & (scores <= block.uppers[:, 0]) & (scores >= block.lowest))
    score = scores[row, anchor]
    slot = (block.uppers[anchor] >= score[:, None]).sum(axis=1) - 1
    best.add(anchor * block.uppers.shape[1] + slot, score, ids[row])


def _meet(look: Callable, slots: Callable[[Block], int], k: int) -> Callable:
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = best = None
        for batch in batches:
            if block is None:
                block = Block(batch.column("block").slice(0, 1).flatten())
                best = Best(len(block.ids) * slots(block), k)
            lists = batch.column("v")
            fits = np.flatnonzero(lists.value_lengths().to_numpy() == block.length)
            step = max(1, PAIRS // len(block.ids))
            for at in range(0, len(fits), step):
                some = pa.array(fits[at : at + step])
                vectors = lists.take(some).flatten().to_numpy(zero_copy_only=False).reshape(len(some), block.length)
                ids, labels = (batch.column(c).take(some).to_numpy() for c in ("id", "label"))
                look(block, best, ids, labels, block.scores(vectors))
        if best is not None and len(best.group):
            anchor, slot = np.divmod(best.group, slots(block))
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.ids[anchor]), pa.array(slot.astype("int32")), pa.array(best.id), pa.array(best.score)],
                ["anchor_id", "slot", "id", "score"],
            )

    return meet


def _against_all(rows: DataFrame, anchors: DataFrame, meet: Callable) -> list[DataFrame]:
    """What tasks kept of all rows for each block of anchors, block after block, each stored.

    A block is one row, broadcast, and joined to the first row of every task only.
    """
    numbered = anchors.withColumn("length", F.size("v"))
    per = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("length") + 64)))
    # A row for each length that vectors have.
    cuts = numbered.groupBy("length").agg(F.ceil(F.count(F.lit(1)) / F.first(per)).cast("int").alias("blocks"))
    packed = stored(
        numbered.join(F.broadcast(cuts), "length").withColumn("number", F.pmod(F.xxhash64("id"), F.col("blocks")))
        .groupBy("length", "number").agg(F.collect_list(F.struct(*anchors.columns)).alias("block")).withColumn("here", F.lit(True))
    )
    # So each row has its place in its task.
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = rows.withColumn("first", F.when(place == 0, True))
    out = []
    for key in packed.select("length", "number").orderBy("length", "number").collect():
        block = packed.where((F.col("length") == key.length) & (F.col("number") == key.number)).select("here", "block")
        joined = placed.join(F.broadcast(block), F.col("first") == F.col("here"), "left").select("id", "label", "v", "block")
        out.append(stored(joined.mapInArrow(meet, "anchor_id long, slot int, id long, score long")))
    return out


def _first(parts: list[DataFrame], by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), "id")
    return reduce(DataFrame.unionByName, parts).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def hard_negatives(
    rows: DataFrame, anchor_every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
    percent: tuple[int, int] = PERCENT,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` from ``prepared`` rows.

    Anchors are the rows whose id is divisible by ``anchor_every``.
    """
    low, high = percent
    anchors = rows.where(F.col("id") % anchor_every == 0)
    empty = rows.sparkSession.createDataFrame([], "anchor_id long, slot int, id long, score long")
    near = _against_all(rows, anchors, _meet(_positives, lambda block: 1, positives))
    chosen = _first([empty, *near], ["anchor_id"], positives)
    # Whole-number limits of each window; a negative score has none.
    windows = stored(
        chosen.where("score >= 0").select(
            "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
            F.expr(f"({low} * score + 99) div 100").alias("lower"), F.expr(f"({high} * score) div 100").alias("upper"),
        )
    )
    limits = windows.groupBy("anchor_id").agg(
        F.sort_array(F.collect_set("upper"), asc=False).alias("uppers"), F.min("lower").alias("lowest")
    )
    asking = anchors.join(limits, anchors.id == limits.anchor_id).select("id", "label", "v", "uppers", "lowest")
    kept = _against_all(rows, asking, _meet(_negatives, lambda block: block.uppers.shape[1], negatives))
    slots = _first([empty, *kept], ["anchor_id", "slot"], negatives)
    # Ascending by slot is descending by score, so this is one list from the highest score down.
    item = F.struct("slot", "place", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    lists = slots.groupBy("anchor_id").agg(F.sort_array(F.collect_list(item)).alias("all"))
    inside = F.filter("all", lambda x: (x["negative_score"] <= F.col("upper")) & (x["negative_score"] >= F.col("lower")))
    return (
        windows.join(lists, "anchor_id")
        .select("anchor_id", "positive_id", "positive_score", F.posexplode(F.slice(inside, 1, negatives)).alias("at", "x"))
        .select(
            "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), "x.negative_id",
            "positive_score", "x.negative_score",
        )
    )
