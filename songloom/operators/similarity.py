"""Exact cosine top-k of query vectors against an index.

Every query is compared with every vector of its model. Scores are ranked at nine decimals,
ties by id. A vector that is NULL, or has a NULL or no finite length, has no direction: as a
query it finds nothing, in the index it is not found. Vectors with different numbers of
values do not meet. ``left_out`` counts what is not compared. A zero vector scores 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from songloom.operators.scratch import kept, with_block

SCORE_DIGITS = 9
# Query vectors sent to every task at once. More queries take more passes over the index.
BLOCK_BYTES = 16 << 20
# Scores held at once by a task.
SCORE_CELLS = 4 << 20
# Above this Spark does not cut to k rows per query before a shuffle; a level in between does.
OWN_CUT = 1_000
LEVEL_PARTS = 64


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    # Spark keeps k rows per query in each task before the shuffle (WindowGroupLimit).
    if k > OWN_CUT:
        part = F.pmod(F.xxhash64("id"), F.lit(LEVEL_PARTS))
        parts = Window.partitionBy("query_id", part).orderBy(F.desc("score"), F.asc("id"))
        scored = scored.withColumn("rank", F.row_number().over(parts)).where(F.col("rank") <= k)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")


def query_sizes(queries: DataFrame) -> list[Row]:
    """``model, n, dim``: how many query vectors of which length there are."""
    dim = F.size("embedding").alias("dim")
    return queries.where(_has_direction() & (F.size("embedding") > 0)).groupBy("model", dim).agg(F.count(F.lit(1)).alias("n")).collect()


def _has_direction() -> Column:
    finite = F.col("norm") < float("inf")
    return F.col("embedding").isNotNull() & F.coalesce(finite & ~F.isnan("norm"), F.lit(False))


def comparable(vectors: DataFrame, model: str, dim: int) -> DataFrame:
    """The vectors of a model that can be compared with others of ``dim`` values."""
    return vectors.where((F.col("model") == model) & _has_direction() & (F.size("embedding") == dim))


def left_out(vectors: DataFrame, model: str, dim: int) -> int:
    """How many vectors of a model are not compared with those of ``dim`` values."""
    return vectors.where(F.col("model") == model).count() - comparable(vectors, model, dim).count()


def top_k(
    queries: DataFrame,
    index: DataFrame,
    k: int,
    block_bytes: int = BLOCK_BYTES,
    sizes: list[Row] | None = None,
) -> DataFrame:
    """``query_id, rank, id, score`` of the best ``k`` per query.

    Queries are stored and counted first, unless ``sizes`` says that they are, and cut into
    blocks of checked size. A block is broadcast by Spark, takes one pass over the index and
    one matrix product per Arrow batch. Of several blocks, each leaves its ranks as a stored
    table before the next one starts, so one is in memory at a time.
    """
    if sizes is None:
        queries = kept(queries.select("query_id", "model", "embedding", "norm"))
        sizes = query_sizes(queries)
    # A block's size counts the hits that a task holds for it, too.
    parts = {row: -(-2 * row.n // most) if row.n > (most := max(1, block_bytes // (8 * row.dim + 64 * min(k, OWN_CUT) + 1))) else 1 for row in sizes}
    found = []
    for row, blocks in parts.items():
        number = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
        packed = comparable(queries, row.model, row.dim).groupBy(number.alias("number")).agg(
            F.collect_list(F.struct("query_id", "embedding", "norm")).alias("block")
        )
        packed = kept(packed) if blocks > 1 else packed
        for i in range(blocks):
            best = _ranked(_block_scores(packed.where(F.col("number") == i), index, row.model, row.dim, k), k)
            found.append(best if sum(parts.values()) == 1 else kept(best))
    if not found:
        none = F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id")
        return _ranked(index.where("false").select(none, "id", F.lit(0.0).alias("score")), k)
    # A query may have vectors of several models.
    return found[0] if len(parts) == 1 == len(found) else _ranked(reduce(DataFrame.unionByName, found), k)


def _block_scores(block: DataFrame, index: DataFrame, model: str, dim: int, k: int) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in block.schema["block"].dataType.elementType.fields}
    id_type = index.schema["id"].dataType.simpleString()

    def best_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            if best is None:
                held = batch["block"].slice(0, 1).flatten()
                if not len(held):
                    return
                query_ids = held.field("query_id")
                vectors = _unit_rows(held.field("embedding"), held.field("norm")).T.copy()
                best = _Best(k, vectors.shape[1])
                step = max(1, SCORE_CELLS // vectors.shape[1])
            # What can't be compared is left out here: as a filter of the plan it would be
            # moved below the encoder, which then ran twice.
            norms = batch["norm"].to_numpy(zero_copy_only=False)
            fits = np.isfinite(norms.astype(float)) & (pc.fill_null(batch["embedding"].value_lengths(), -1).to_numpy() == dim)
            rows = batch.select(["id", "embedding", "norm"]).filter(pa.array(fits))
            for start in range(0, rows.num_rows, step):
                part = rows.slice(start, step)
                scores = np.clip(_unit_rows(part["embedding"], part["norm"]) @ vectors, -1.0, 1.0)
                best.add(np.round(scores, SCORE_DIGITS), part["id"])
        if best is None:
            return
        at, ids, scores = best.rows()
        if len(at):
            yield pa.RecordBatch.from_arrays(
                [query_ids.take(pa.array(at)), pa.array(ids), pa.array(scores)],
                names=["query_id", "id", "score"],
            )

    narrow = with_block(index.where(F.col("model") == model).select("id", "embedding", "norm"), block)
    schema = f"query_id {types['query_id']}, id {id_type}, score double"
    return narrow.mapInArrow(best_of_task, schema)


def _unit_rows(embedding, norms) -> np.ndarray:
    """Vectors of an Arrow list column, scaled to length 1; zero vectors stay zero."""
    if isinstance(embedding, pa.ChunkedArray):
        embedding, norms = embedding.combine_chunks(), norms.combine_chunks()
    n = len(embedding)
    if n == 0:
        return np.zeros((0, 0))
    rows = embedding.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(n, -1)
    lengths = norms.to_numpy(zero_copy_only=False)[:, None]
    return np.divide(rows, lengths, out=np.zeros_like(rows), where=lengths > 0)


@dataclass
class _Best:
    """The best k ids per query so far, ranked by score, then id."""

    k: int
    queries: int

    def __post_init__(self) -> None:
        self.ids: list = [[] for _ in range(self.queries)]
        self.scores: list = [np.empty(0) for _ in range(self.queries)]
        self.floor = np.full(self.queries, -np.inf)

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        # Only queries with a score at or above their k-th best so far can change.
        for q in np.flatnonzero(scores.max(axis=0) >= self.floor):
            column = scores[:, q]
            floor = self.floor[q]
            if len(column) > self.k:
                floor = max(floor, np.partition(column, -self.k)[-self.k])
            rows = np.flatnonzero(column >= floor)
            names = self.ids[q] + ids.take(pa.array(rows)).to_pylist()
            values = np.concatenate([self.scores[q], column[rows]])
            order = sorted(range(len(names)), key=lambda i: (-values[i], names[i]))[: self.k]
            self.ids[q] = [names[i] for i in order]
            self.scores[q] = values[order]
            if len(order) == self.k:
                self.floor[q] = values[order[-1]]

    def rows(self) -> tuple[list, list, np.ndarray]:
        at = [q for q, ids in enumerate(self.ids) for _ in ids]
        ids = [name for names in self.ids for name in names]
        return at, ids, np.concatenate(self.scores) if self.scores else np.empty(0)
