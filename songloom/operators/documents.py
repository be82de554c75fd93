"""One searchable document per song, and its metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from songloom.functions.text import INSTRUMENTAL_SENTENCE, field, non_empty, song_key


def _flag(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)


def document_text(df: DataFrame) -> Column:
    """The text that is encoded; parts that a song lacks are left out."""
    album, lyrics = field(df, "album"), field(df, "plain_lyrics")
    return F.concat_ws(
        "\n",
        F.concat(
            F.lit("Song: "), field(df, "track_name", "name"),
            F.lit(" by "), field(df, "artist_name", "artist"),
        ),
        F.when(album != "", F.concat(F.lit("Album: "), album)),
        F.when(_flag(df, "instrumental"), F.lit(INSTRUMENTAL_SENTENCE)),
        F.when(lyrics != "", F.concat(F.lit("Lyrics:\n"), lyrics)),
    )


def embeddable(df: DataFrame) -> Column:
    """True for songs with lyrics or without vocals; others have nothing to encode."""
    return non_empty(field(df, "plain_lyrics")) | _flag(df, "instrumental")


def found_songs(cache: DataFrame) -> DataFrame:
    """Cache entries whose lookup found something."""
    return cache.where(F.coalesce("lyrics_found", F.lit(False)))


def documents(songs: DataFrame) -> DataFrame:
    """Songs -> id, document and metadata of the songs that can be indexed."""
    track, artist = field(songs, "track_name", "name"), field(songs, "artist_name", "artist")
    return songs.where(embeddable(songs)).select(
        song_key(track, artist).alias("id"),
        document_text(songs).alias("document"),
        track.alias("track_name"),
        artist.alias("artist_name"),
        field(songs, "album").alias("album"),
        _flag(songs, "instrumental").alias("instrumental"),
        non_empty(field(songs, "plain_lyrics")).alias("has_lyrics"),
    )
