"""The JSON files of a single-machine library, read so that it can move to Spark.

A missing or broken file reads as an empty table. Each file is one JSON document and
therefore one task; the files are as small as one person's library. Everything larger is
kept in the snapshot tables.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from songloom import schemas
from songloom.functions.times import iso_time, unix_time


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "value string")


def _envelopes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return _whole_files(spark, path).select(F.from_json("value", schema).alias("e"))


def read_store_info(spark: SparkSession, path: str) -> DataFrame:
    """Source, stored count and fetch time of a saved song list; no row if there is none."""
    stored = _envelopes(spark, path, schemas.STORED_LIKED)
    return stored.where("e.songs is not null").select("e.source", "e.count", "e.fetched_at")


def read_liked(spark: SparkSession, path: str) -> DataFrame:
    songs = _envelopes(spark, path, schemas.STORED_LIKED).select(
        F.posexplode("e.songs").alias("seq", "s")
    )
    return songs.select(
        F.col("seq").cast("bigint").alias("seq"),
        "s.id", "s.name", "s.artists", "s.album", "s.added_at",
        iso_time(F.col("s.added_at")).alias("added_ts"),
        "s.duration_ms", "s.spotify_url",
    )


def read_plays(spark: SparkSession, path: str) -> DataFrame:
    songs = _envelopes(spark, path, schemas.STORED_PLAYS).select(
        F.posexplode("e.songs").alias("seq", "s")
    )
    return songs.select(
        F.col("seq").cast("bigint").alias("seq"),
        "s.name", "s.artist", "s.album", "s.timestamp",
        unix_time(F.col("s.timestamp")).alias("played_at"),
        "s.date_text", "s.now_playing", "s.lastfm_url",
    )


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    entries = F.from_json("value", schemas.STORED_CACHE)
    return (
        _whole_files(spark, path)
        .select(F.explode(entries).alias("key", "entry"))
        .select("key", "entry.*")
    )
