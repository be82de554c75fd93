"""Joins of many rows to a table with one row per key, safe for hot keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

# A key with more rows than this is spread over several tasks.
HOT_ROWS = 1_000_000


def hot_keys(rows: DataFrame, on: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every key above ``hot_rows`` and how many tasks it is spread over.

    Counting reads the key columns only and is combined before the shuffle.
    """
    counted = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    return _salts(counted, "_n", on, hot_rows)


def _salts(counted: DataFrame, n: str, on: Sequence[str], hot_rows: int) -> DataFrame:
    return counted.select(*on, F.ceil(F.col(n) / hot_rows).cast("int").alias("_salts"))


def even_rows(total: int) -> int:
    """From how many rows on a key is hot, so that at most 100,000 keys of ``total`` rows are."""
    return max(1_000, total // 100_000)


def _match(left: str, right: str, on: Sequence[str], null_safe: Sequence[str]) -> Column:
    def same(name: str) -> Column:
        a, b = F.col(f"{left}.{name}"), F.col(f"{right}.{name}")
        return a.eqNullSafe(b) if name in null_safe else a == b

    return reduce(and_, map(same, on))


def join_unique(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str] = ("key",),
    how: str = "left",
    spread: str = "seq",
    hot_rows: int | None = HOT_ROWS,
    null_safe: Sequence[str] = (),
    counted: DataFrame | None = None,
) -> DataFrame:
    """Join ``rows`` to ``table``, which has at most one row per ``on``.

    In the columns named by ``null_safe`` NULL is a value like others.

    Rows of a hot key get a salt made from ``spread``; the table's row for that key is
    copied once per salt. ``hot_rows=None`` says that ``rows`` are unique as well. ``counted``,
    with ``on`` and ``n``, says how many rows there are of each key, where that is known.
    """
    on = list(on)
    if hot_rows is not None:
        # One hash and one count per hot key: 12 bytes for each ``hot_rows`` rows at most,
        # whatever the keys are. A clash of hashes spreads one key more, alike on both sides.
        hot = hot_keys(rows, on, hot_rows) if counted is None else _salts(counted.where(F.col("n") > hot_rows), "n", on, hot_rows)
        hot = hot.groupBy(F.xxhash64(*on).alias("_h")).agg(F.max("_salts").alias("_salts"))
        hot = F.broadcast(hot)
        same = lambda side: F.xxhash64(*[F.col(f"{side}.{c}") for c in on]) == F.col("h._h")
        salted = rows.alias("r").join(hot.alias("h"), same("r"), "left")
        salt = F.coalesce(F.pmod(F.xxhash64(F.col(f"r.{spread}")), F.col("h._salts")), F.lit(0))
        rows = salted.select("r.*", salt.cast("int").alias("_salt"))

        copied = table.alias("t").join(hot.alias("h"), same("t"), "left")
        last = F.coalesce(F.col("h._salts"), F.lit(1)) - 1
        table = copied.select("t.*", F.explode(F.sequence(F.lit(0), last)).alias("_salt"))
        on = [*on, "_salt"]

    joined = rows.alias("l").join(table.alias("t"), _match("l", "t", on, null_safe), how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("_salt")
    added = [F.col(f"t.{c}") for c in table.columns if c not in on]
    kept = [F.col(f"l.{c}") for c in rows.columns if c != "_salt"]
    return joined.select(*kept, *added)
