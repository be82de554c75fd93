"""Lyrics for a list of songs, through the cache.

The list is worked off in order, as one song after the other would be: the first song of
an uncached key is a lookup, later songs of that key find its result in the cache. With
``force`` every song is a lookup of its own and the last one of a key stays cached.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from songloom.functions.text import lyric_status
from songloom.operators.library import with_lookup
from songloom.operators.lookup import LOOKUP, LOOKUP_NULLS, LYRIC_COLUMNS, look_up
from songloom.operators.ordering import checked_limit, first_n, first_per_key, last_per_key
from songloom.operators.skew import HOT_ROWS, join_unique
from songloom.operators.upsert import upsert

CACHE_COLUMNS = ("key", "track_name", "artist_name", *LYRIC_COLUMNS)
_WORK_COLUMNS = ("lookup_album", "lookup_seconds")

Keep = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class Enrichment:
    """``songs`` with lyrics and ``was_cached``; ``delta`` is what the run adds to the cache."""

    songs: DataFrame
    delta: DataFrame


def cache_lookup(songs: DataFrame, cache: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Songs with the lyric columns of their cache entry and ``was_cached``.

    Entries that say "not found" are hits too.
    """
    entries = cache.select("key", *LYRIC_COLUMNS, F.lit(True).alias("was_cached"))
    joined = join_unique(songs, entries, hot_rows=hot_rows)
    return joined.withColumn("was_cached", F.coalesce("was_cached", F.lit(False)))


def uncached(songs: DataFrame, cache: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Songs whose key is not in the cache."""
    return join_unique(songs, cache.select("key"), how="left_anti", hot_rows=hot_rows)


def cache_coverage(songs: DataFrame, cache: DataFrame) -> DataFrame:
    """How many songs the cache already covers and how many are new."""
    per_key = songs.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    known = cache.select("key", F.lit(True).alias("known"))
    covered = F.coalesce("known", F.lit(False))
    zero = F.lit(0)
    return per_key.join(known, "key", "left").agg(
        F.coalesce(F.sum(F.when(covered, F.col("n"))), zero).alias("skipped"),
        F.coalesce(F.sum(F.when(~covered, F.col("n"))), zero).alias("available"),
    )


def songs_to_process(
    songs: DataFrame,
    cache: DataFrame,
    limit: int | None = None,
    new: int | None = None,
    force: bool = False,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """The songs of a run: the first ``limit``, or the first ``new`` that are not cached.

    With ``force`` nothing counts as cached, so ``new`` takes the first songs.
    """
    if limit is not None and new is not None:
        raise ValueError("limit and new cannot be used together")
    if checked_limit(new) is None:
        return first_n(songs, limit)
    open_ = songs if force else uncached(songs, cache, hot_rows)
    return first_n(open_, new)


def enrich(
    songs: DataFrame,
    cache: DataFrame,
    records: DataFrame,
    source: str,
    limit: int | None = None,
    new: int | None = None,
    force: bool = False,
    unique: bool = False,
    hot_rows: int = HOT_ROWS,
    keep: Keep = lambda df, name: df,
) -> Enrichment:
    """Run the lookups of a song list. ``unique`` says that each key comes once.

    ``keep`` may store a result that is used more than once and return it as read back;
    otherwise everything stays one lazy plan.
    """
    hot = None if unique else hot_rows
    asked = songs_to_process(with_lookup(songs, source), cache, limit, new, force, hot)
    if limit or new:
        asked = keep(asked, "asked")
    run = _every_song if force else _first_songs
    return run(asked, cache, records, unique, hot, keep)


def _first_songs(asked, cache, records, unique: bool, hot: int | None, keep: Keep) -> Enrichment:
    names = ["name", "primary_artist"]
    narrow = asked.select(*LOOKUP, *names, "seq")
    firsts = narrow if unique else first_per_key(narrow)
    misses = firsts.join(cache.select("key"), "key", "left_anti")
    looked_up = keep(look_up(misses, records, True, hot or HOT_ROWS), "lookups")

    # Cache and lookups together answer every key once: the cache after the run.
    entries = cache.select(
        "key", *LYRIC_COLUMNS, F.lit(None).cast("bigint").alias("_looked_up_at")
    )
    answers = entries.unionByName(
        looked_up.select("key", *LYRIC_COLUMNS, F.col("seq").alias("_looked_up_at"))
    )
    joined = join_unique(asked, answers, how="inner", hot_rows=hot)
    hit = F.coalesce(F.col("seq") != F.col("_looked_up_at"), F.lit(True))
    songs = joined.withColumn("was_cached", hit).drop("_looked_up_at", *_WORK_COLUMNS)
    return Enrichment(songs, _as_entries(looked_up))


def _every_song(asked, cache, records, unique: bool, hot: int | None, keep: Keep) -> Enrichment:
    lookups = asked.select(*LOOKUP)
    if not unique:
        lookups = lookups.distinct()
    answers = look_up(lookups, records, unique, hot or HOT_ROWS)
    answers = keep(answers.select(*LOOKUP, *LYRIC_COLUMNS), "lookups")
    songs = join_unique(asked, answers, LOOKUP, hot_rows=hot, null_safe=LOOKUP_NULLS)
    songs = songs.withColumn("was_cached", F.lit(False)).drop(*_WORK_COLUMNS)

    narrow = asked.select(*LOOKUP, "name", "primary_artist", "seq")
    lasts = narrow if unique else last_per_key(narrow)
    delta = join_unique(lasts, answers, LOOKUP, hot_rows=None, null_safe=LOOKUP_NULLS)
    return Enrichment(songs, _as_entries(delta))


def _as_entries(answered: DataFrame) -> DataFrame:
    return answered.select(
        "key",
        F.col("name").alias("track_name"),
        F.col("primary_artist").alias("artist_name"),
        *LYRIC_COLUMNS,
    )


def fetch_lyrics(
    songs: DataFrame, records: DataFrame, source: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Lyrics for every song of a list without any cache; songs without lyrics are kept."""
    asked = with_lookup(songs, source)
    run = _every_song(asked, None, records, False, hot_rows, lambda df, name: df)
    return run.songs.drop("was_cached")


def save_to_cache(cache: DataFrame, saved: DataFrame, order: str = "seq") -> DataFrame:
    """The cache after saving rows in order: one row per key, the last one replaces all."""
    return upsert(cache, last_per_key(saved, order=(order,)).select(*cache.columns), ["key"])


def run_summary(enriched: DataFrame) -> DataFrame:
    """Counts of an enrichment run; instrumental counts only where something was found."""
    found, instrumental = F.col("lyrics_found"), F.col("instrumental")
    count = F.count(F.lit(1))
    with_text = F.count_if(found & ~instrumental)
    silent = F.count_if(found & instrumental)
    return enriched.agg(
        count.alias("processed"),
        with_text.alias("found"),
        silent.alias("instrumental"),
        (count - with_text - silent).alias("not_found"),
        F.count_if("was_cached").alias("from_cache"),
        F.count_if(~F.col("was_cached")).alias("lookups"),
    )


def with_status(enriched: DataFrame) -> DataFrame:
    status = lyric_status(F.col("instrumental"), F.col("lyrics_found"))
    return enriched.withColumn("status", status)
