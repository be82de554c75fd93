"""Lists for reading: numbered rows with cut columns, in library order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from songloom.functions.text import (
    further_lines,
    has_lyrics_label,
    instrumental_tag,
    lyric_preview,
    lyric_status,
)
from songloom.operators.library import with_artist
from songloom.operators.ordering import number_rows

# Column widths of the lists and the mark of a running play.
TITLE, ARTIST, ALBUM = 38, 28, 28
ENRICHED_TITLE, ENRICHED_ARTIST = 33, 23
RUNNING_MARK = "> "


def _cut(text: Column, width: int) -> Column:
    return F.left(text, F.lit(width))


def list_liked(liked: DataFrame) -> DataFrame:
    return number_rows(liked).select(
        "number",
        _cut(F.col("name"), TITLE).alias("title"),
        _cut(F.array_join("artists", ", "), ARTIST).alias("artists"),
        _cut(F.col("album"), ALBUM).alias("album"),
    )


def list_plays(plays: DataFrame) -> DataFrame:
    mark = F.when(F.col("now_playing"), RUNNING_MARK).otherwise("")
    return number_rows(plays).select(
        "number",
        F.concat(mark, _cut(F.col("name"), TITLE)).alias("title"),
        _cut(F.col("artist"), ARTIST).alias("artist"),
        F.coalesce("date_text", F.lit("")).alias("date"),
    )


def list_enriched(enriched: DataFrame, source: str) -> DataFrame:
    status = lyric_status(F.col("instrumental"), F.col("lyrics_found"))
    return number_rows(with_artist(enriched, source)).select(
        "number",
        _cut(F.col("name"), ENRICHED_TITLE).alias("title"),
        _cut(F.col("primary_artist"), ENRICHED_ARTIST).alias("artist"),
        status.alias("status"),
    )


def list_lyric_results(results: DataFrame) -> DataFrame:
    """Keyword results with their labels and the head of the lyrics."""
    lyrics = F.col("plain_lyrics")
    return results.select(
        "query_id", "rank", "name", "artist", "album",
        has_lyrics_label(lyrics).alias("lyrics"),
        instrumental_tag(F.col("instrumental")).alias("tag"),
        lyric_preview(lyrics).alias("preview"),
        further_lines(lyrics).alias("more_lines"),
    )
