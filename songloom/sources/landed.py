"""Landed responses of the music and lyrics services -> typed tables.

A page is one row ``(page, body)``; ``body`` is the response as JSON text. The work is a
parse and an explode, both inside the scan stage: no shuffle at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from songloom import schemas
from songloom.functions.times import iso_time, unix_time

# Row order = page number, then place in the page. A place is an int, so 32 bits hold it.
PLACE_BITS = 32


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines ``{"page": 1, "body": {...}}``; the body stays text."""
    return spark.read.schema(schemas.PAGE).json(path)


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    """One response per file; the last number in the file name is the page."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    page = F.regexp_extract(name, r"(\d+)\D*$", 1).try_cast("bigint")
    return spark.read.text(path, wholetext=True).select(
        page.alias("page"), F.col("value").alias("body")
    )


def _seq() -> Column:
    return (F.shiftleft("page", PLACE_BITS) + F.col("pos")).alias("seq")


def _liked_items() -> Column:
    return F.from_json("body", schemas.LIKED_BODY)["items"]


def _plays_tracks() -> Column:
    """The service sends a lone track as an object.

    ``track`` is therefore taken as text and parsed as an array, which accepts both.
    """
    return F.from_json(F.from_json("body", schemas.PLAYS_BODY)["recenttracks"]["track"], schemas.PLAYS_TRACKS)


def _refused(pages: DataFrame, songs: Column, missing: Column | None = None) -> DataFrame:
    error = F.get_json_object("body", "$.error")
    reason = (
        F.when(F.col("page").isNull(), "no page number")
        .when(error.isNotNull(), F.concat(F.lit("error "), error))
        .when(songs.isNull(), "no list of songs")
    )
    if missing is not None:
        reason = reason.when(missing > 0, F.concat(missing.cast("string"), F.lit(" without a track")))
    return pages.select("page", "body", reason.alias("reason")).where("reason is not null")


def rejected_liked(pages: DataFrame) -> DataFrame:
    """Saved-track pages that ``normalize_liked`` can't read, and why: ``page, body, reason``.

    A page that it reads except for items without a track is among them, with their number.
    """
    items = _liked_items()
    return _refused(pages, items, F.size(F.filter(items, lambda item: item["track"].isNull())))


def rejected_plays(pages: DataFrame) -> DataFrame:
    """Play-history pages that ``normalize_plays`` can't read, and why."""
    return _refused(pages, _plays_tracks())


def normalize_liked(pages: DataFrame) -> DataFrame:
    """Saved-track pages -> one row per liked song. A page without a number is not read."""
    track = F.col("item.track")
    return (
        pages.where("page is not null").select("page", _liked_items().alias("items"))
        .select("page", F.posexplode("items").alias("pos", "item"))
        .where(track.isNotNull())
        .select(
            _seq(),
            track["id"].alias("id"),
            track["name"].alias("name"),
            track["artists"]["name"].alias("artists"),
            track["album"]["name"].alias("album"),
            F.col("item.added_at").alias("added_at"),
            iso_time(F.col("item.added_at")).alias("added_ts"),
            track["duration_ms"].alias("duration_ms"),
            F.coalesce(track["external_urls"]["spotify"], F.lit("")).alias("spotify_url"),
        )
    )


def normalize_plays(pages: DataFrame) -> DataFrame:
    """Play-history pages -> one row per play. A page without a number is not read."""
    playing = F.coalesce(F.col("t.`@attr`.nowplaying") == "true", F.lit(False))
    stamp = F.when(~playing, F.col("t.date.uts"))
    empty = F.lit("")
    return (
        pages.where("page is not null").select("page", F.posexplode(_plays_tracks()).alias("pos", "t"))
        .where(F.col("t").isNotNull())
        .select(
            _seq(),
            F.coalesce("t.name", empty).alias("name"),
            F.coalesce("t.artist.`#text`", empty).alias("artist"),
            F.coalesce("t.album.`#text`", empty).alias("album"),
            stamp.alias("timestamp"),
            unix_time(stamp).alias("played_at"),
            F.when(playing, "Now playing").otherwise(F.col("t.date.`#text`")).alias("date_text"),
            playing.alias("now_playing"),
            F.coalesce("t.url", empty).alias("lastfm_url"),
        )
    )


def page_totals(pages: DataFrame) -> DataFrame:
    """Totals that the play service reports about itself."""
    attr = F.from_json("body", schemas.PLAYS_BODY)["recenttracks"]["@attr"]
    largest = [
        F.coalesce(F.max(F.col(name).try_cast("bigint")), F.lit(0).cast("bigint"))
        for name in ("attr.total", "attr.totalPages")
    ]
    return pages.select(attr.alias("attr")).agg(
        largest[0].alias("total_scrobbles"), largest[1].alias("total_pages")
    )


def read_lyric_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LYRIC_RECORD).json(path)


def normalize_lyrics(records: DataFrame) -> DataFrame:
    """Records of the lyrics service -> lyric rows."""
    empty = F.lit("")
    return records.select(
        "id",
        F.coalesce("trackName", "name", empty).alias("name"),
        F.coalesce("artistName", empty).alias("artist"),
        F.coalesce("albumName", empty).alias("album"),
        "duration",
        F.coalesce("instrumental", F.lit(False)).alias("instrumental"),
        F.col("plainLyrics").alias("plain_lyrics"),
        F.col("syncedLyrics").alias("synced_lyrics"),
    )
