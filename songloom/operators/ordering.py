"""Order-dependent operators: first or last row per key, prefixes, numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from songloom.operators.scratch import kept

# Every task may send a prefix of this length to the one that picks the final rows.
SHORT_PREFIX = 1_000


def _one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    # Spark cuts each map task to one row per key before the shuffle (WindowGroupLimit),
    # so a key that fills a third of the table arrives as one row per map task.
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def first_per_key(
    df: DataFrame, keys: Sequence[str] = ("key",), order: Sequence[str] = ("seq",)
) -> DataFrame:
    """Drop duplicates, the first occurrence wins."""
    return _one_per_key(df, keys, [F.asc(c) for c in order])


def last_per_key(
    df: DataFrame, keys: Sequence[str] = ("key",), order: Sequence[str] = ("seq",)
) -> DataFrame:
    """Drop duplicates, the last write wins."""
    return _one_per_key(df, keys, [F.desc(c) for c in order])


def checked_limit(limit: int | None) -> int | None:
    """None and 0 mean no limit; a negative limit is an error."""
    if limit is not None and limit < 0:
        raise ValueError(f"limit must not be negative: {limit}")
    return limit or None


def _placed(order: str) -> Column:
    """The order column; a row without a place is an error, for any number of rows asked for."""
    return F.coalesce(F.col(order), F.raise_error(F.lit(f"a row has no {order}")).cast("bigint"))


def first_n(df: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` rows by ``seq``.

    A short prefix is a top-k. A long one would pass through one task that way, so it is
    cut by row number instead, which stays distributed.
    """
    limit = checked_limit(limit)
    if limit is None:
        return df
    if limit <= SHORT_PREFIX:
        return df.orderBy(_placed("seq")).limit(limit)
    return number_rows(df).where(F.col("number") <= limit).drop("number")


def number_rows(df: DataFrame, order: str = "seq") -> DataFrame:
    """Number rows 1, 2, .. by a unique bigint column, without one global sort.

    The rows are computed once and stored, then dealt to tasks by ranges of the column and
    stored in order, each with its task and its place there. How many rows each task has gives
    every task its offset: one small row per task is summed up and broadcast.
    """
    rows = kept(df.withColumn(order, _placed(order)))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    spread = rows.repartitionByRange(order).sortWithinPartitions(order)
    placed = kept(spread.withColumn("_task", F.spark_partition_id()).withColumn("_at", place))
    counts = placed.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    numbered = placed.join(F.broadcast(offsets), "_task").withColumn("number", F.col("_offset") + F.col("_at") + 1)
    return numbered.select(*df.columns, "number")
