"""Intermediate tables in the shared scratch folder, and a table that every task meets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from songloom.session import shared_dir


def kept(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back, so that it is computed once."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_block(rows: DataFrame, block: DataFrame, name: str = "block") -> DataFrame:
    """Add the single row of ``block``, a column ``name``, to the first row of every task.

    Spark broadcasts the block; a function over the task's rows reads it from the first one,
    so it is neither sent along with other rows nor through the driver's Python.
    """
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = rows.withColumn("_first", F.when(place == 0, True))
    # Always true, but not as a constant: so it stays a key of the join.
    shared = block.select((F.size(name) >= 0).alias("_here"), name)
    joined = placed.join(F.broadcast(shared), F.col("_first") == F.col("_here"), "left")
    return joined.select(*rows.columns, name)
