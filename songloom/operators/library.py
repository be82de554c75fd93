"""The song library: keys, source mapping, union of both sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from songloom.functions.text import first_artist, song_key
from songloom.functions.times import whole_seconds
from songloom.operators.ordering import first_per_key

# Names of the song sources.
LIKED_SOURCE = "spotify"
PLAYS_SOURCE = "lastfm"
# Plays come after every liked song in the order of the united library.
PLAYS_OFFSET = 1 << 62


def with_artist(songs: DataFrame, source: str) -> DataFrame:
    """Add the artist that identifies a song, by the shape of the source."""
    if source == LIKED_SOURCE:
        return songs.withColumn("primary_artist", first_artist(F.col("artists")))
    if source == PLAYS_SOURCE:
        return songs.withColumn("primary_artist", F.coalesce("artist", F.lit("")))
    raise ValueError(f"songs come from {LIKED_SOURCE} or {PLAYS_SOURCE}, not {source}")


def with_key(songs: DataFrame, source: str) -> DataFrame:
    """Add artist and song key."""
    named = with_artist(songs, source)
    return named.withColumn("key", song_key(F.col("name"), F.col("primary_artist")))


def with_lookup(songs: DataFrame, source: str) -> DataFrame:
    """Add what a lyric lookup asks with: key, album and length in seconds.

    Plays carry no length, also where they are part of the united library.
    """
    keyed = with_key(songs, source)
    seconds = F.lit(None).cast("bigint")
    if source == LIKED_SOURCE:
        seconds = whole_seconds(F.col("duration_ms"))
    return keyed.select(
        "*",
        F.coalesce("album", F.lit("")).alias("lookup_album"),
        seconds.alias("lookup_seconds"),
    )


def unique_plays(plays: DataFrame, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Plays -> songs, the first play of each song."""
    return first_per_key(with_key(plays, PLAYS_SOURCE), order=order)


def with_more_plays(unique: DataFrame, plays: DataFrame, order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The songs of a play history after more plays: what it had and the first of the new ones."""
    first = unique_plays(plays, order).select(*unique.columns)
    return unique_plays(unique.unionByName(first), order).select(*unique.columns)


def as_liked(plays: DataFrame) -> DataFrame:
    """Plays in the shape of liked songs."""
    return plays.withColumn("artists", F.array("artist"))


def both_sources(liked: DataFrame, plays: DataFrame) -> DataFrame:
    """Liked songs, then plays; one row per song, so the liked row wins a tie."""
    first = liked.withColumn("source", F.lit(LIKED_SOURCE))
    second = as_liked(plays).withColumn("source", F.lit(PLAYS_SOURCE))
    second = second.withColumn("seq", F.col("seq") + F.lit(PLAYS_OFFSET))
    shared = ("key", "primary_artist")
    union = first.drop(*shared).unionByName(second.drop(*shared), allowMissingColumns=True)
    return first_per_key(with_key(union, LIKED_SOURCE))
