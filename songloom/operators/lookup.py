"""Best lyric record of a song: same key, then same album, then nearest length.

A key such as a common title may hold a large part of the songs and of the records, so
songs and records of a key are never paired. Where each key is asked for once, every
record has one lookup to be scored against and the best one is a minimum per key. Where
a key is asked for with several albums and lengths, both sides are first reduced to one
row per whole second, which keeps every record that can be nearest; one ordered pass per
group then finds the neighbours below and above.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from songloom.functions.text import song_key
from songloom.operators.skew import HOT_ROWS, join_unique

LOOKUP = ("key", "lookup_album", "lookup_seconds")
LOOKUP_NULLS = ("lookup_seconds",)
LYRIC_COLUMNS = ("plain_lyrics", "synced_lyrics", "instrumental", "lyrics_found")


def records_by_second(records: DataFrame) -> DataFrame:
    """Shortest, longest and lowest-numbered record per key, album and whole second.

    Lookups ask for whole seconds, so inside one second only the two ends can be nearest.
    """
    length = F.col("duration")
    # Both ends prefer the lower id among equal lengths.
    low = F.when(length.isNotNull(), F.struct(length.alias("at"), F.col("id").alias("id")))
    high = F.when(length.isNotNull(), F.struct(length.alias("at"), (-F.col("id")).alias("id")))
    keyed = records.select(
        song_key(F.col("name"), F.col("artist")).alias("key"),
        F.col("album").alias("lookup_album"),
        F.floor("duration").cast("bigint").alias("second"),
        low.alias("low"), high.alias("high"), F.col("id").alias("lowest_id"),
    )
    return _ends(keyed, ["key", "lookup_album", "second"])


def _ends(ends: DataFrame, by: Sequence[str]) -> DataFrame:
    return ends.groupBy(*by).agg(
        F.min("low").alias("low"), F.max("high").alias("high"),
        F.min("lowest_id").alias("lowest_id"),
    )


def nearest_id(lookups: DataFrame, ends: DataFrame, group: Sequence[str], out: str) -> DataFrame:
    """Add the id of the nearest record of the group, NULL if the group has none."""
    asked = lookups.withColumn("second", F.col("lookup_seconds")).withColumn("_asks", F.lit(1))
    offered = ends.select(*group, "second", "low", "high", "lowest_id", F.lit(0).alias("_asks"))
    rows = asked.unionByName(offered, allowMissingColumns=True)

    # Upwards a lookup comes before the records of its own second, downwards after them:
    # so `below` is really shorter and `above` is the lookup's second or longer.
    so_far = (Window.unboundedPreceding, Window.currentRow)
    up = Window.partitionBy(*group).orderBy(F.asc("second"), F.desc("_asks"))
    down = Window.partitionBy(*group).orderBy(F.desc("second"), F.asc("_asks"))
    whole = Window.partitionBy(*group)
    rows = (
        rows.withColumn("_below", F.last("high", ignorenulls=True).over(up.rowsBetween(*so_far)))
        .withColumn("_above", F.last("low", ignorenulls=True).over(down.rowsBetween(*so_far)))
        .withColumn("_lowest", F.min("lowest_id").over(whole))
    )
    answered = rows.where("_asks = 1").withColumn(out, _closer())
    return answered.select(*lookups.columns, out)


def _closer() -> Column:
    at = F.col("lookup_seconds")
    below, above = F.col("_below"), F.col("_above")
    gap_below, gap_above = at - below["at"], above["at"] - at
    near = (
        F.when(below.isNull(), above["id"])
        .when(above.isNull(), -below["id"])
        .when(gap_below < gap_above, -below["id"])
        .when(gap_above < gap_below, above["id"])
        .otherwise(F.least(-below["id"], above["id"]))
    )
    # Without a length on one of the sides, the lowest id decides.
    return F.coalesce(F.when(at.isNotNull(), near), F.col("_lowest"))


def best_of_one(lookups: DataFrame, records: DataFrame, hot_rows: int | None) -> DataFrame:
    """Add ``record_id`` to lookups that ask for each key once."""
    offers = records.select(
        song_key(F.col("name"), F.col("artist")).alias("key"), "id", "album", "duration"
    )
    asked = lookups.select(*LOOKUP)
    scored = join_unique(offers, asked, how="inner", spread="id", hot_rows=hot_rows)
    other_album = (F.col("lookup_album") != "") & ~F.col("album").eqNullSafe(F.col("lookup_album"))
    gap = F.abs(F.col("duration") - F.col("lookup_seconds"))
    order = F.struct(other_album.alias("album"), gap.isNull().alias("open"), gap.alias("gap"), "id")
    best = scored.groupBy("key").agg(F.min(order)["id"].alias("record_id"))
    return lookups.join(best, "key", "left")


def best_of_many(lookups: DataFrame, records: DataFrame, hot_rows: int) -> DataFrame:
    """Add ``record_id`` to lookups that are distinct in key, album and seconds."""
    by_album = records_by_second(records)
    by_key = _ends(by_album, ["key", "second"])
    # No album asked for means no album preferred.
    named = by_album.where(F.col("lookup_album") != "")
    found = nearest_id(lookups, named, ["key", "lookup_album"], "album_id")
    open_ = found.where("album_id is null").select("key", "lookup_seconds").distinct()
    answers = nearest_id(open_, by_key, ["key"], "key_id")
    answered = join_unique(
        found, answers, ["key", "lookup_seconds"], spread="lookup_album",
        hot_rows=hot_rows, null_safe=["lookup_seconds"],
    )
    return answered.select(*lookups.columns, F.coalesce("album_id", "key_id").alias("record_id"))


def look_up(
    lookups: DataFrame, records: DataFrame, unique_keys: bool, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add the lyric columns of the best record; a miss has NULL lyrics and is not found.

    ``unique_keys`` says that each key is asked for once; otherwise lookups are distinct
    in key, album and seconds.
    """
    # Misses have no record id and would all meet in one task; a second join column
    # spreads them. On the record side it is always 0 (written so that it stays a join key).
    miss = F.when(F.col("record_id").isNull(), F.xxhash64(*LOOKUP)).otherwise(0)
    best = best_of_one if unique_keys else best_of_many
    ids = best(lookups, records, hot_rows).withColumn("_miss", miss)
    lyrics = records.select(
        F.col("id").alias("record_id"),
        F.pmod(F.col("id"), F.lit(1)).cast("bigint").alias("_miss"),
        "plain_lyrics", "synced_lyrics",
        F.coalesce("instrumental", F.lit(False)).alias("instrumental"),
        F.lit(True).alias("lyrics_found"),
    )
    joined = join_unique(
        ids, lyrics, ["record_id", "_miss"], spread="key",
        hot_rows=None if unique_keys else hot_rows,
    )
    return joined.drop("_miss").withColumns({
        "instrumental": F.coalesce("instrumental", F.lit(False)),
        "lyrics_found": F.coalesce("lyrics_found", F.lit(False)),
    })


def best_record(lookups: DataFrame, records: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """The whole record that answers each lookup; misses have no row. Keys come once."""
    best = best_of_one(lookups, records, hot_rows).select("record_id")
    return records.join(best, F.col("id") == F.col("record_id"), "left_semi")
