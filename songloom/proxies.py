"""The given test tables seen as a listening library.

Whole tables throughout: parts are liked songs, line items are plays of them, documents
are lyrics. Which lyrics are already cached follows from whether a document has a label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from songloom.functions.text import song_key
from songloom.operators.library import LIKED_SOURCE, PLAYS_SOURCE, with_key
from songloom.operators.ordering import last_per_key

# Six columns that order the line items fully.
PLAY_ORDER = (
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
)


TABLES = {
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,"
        " p_retailprice double"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
        " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
        " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double,"
        " props string"
    ),
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "benchmark": "item_id bigint, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def large_table(spark: SparkSession, sf_dir: str, name: str, by: str) -> DataFrame:
    """A table with much work per row, spread over the cores.

    The files here have one row group and would be one task. A table of many files has
    tasks enough and is read as it is.
    """
    rows = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, by)


def liked(spark: SparkSession, sf_dir: str) -> DataFrame:
    songs = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("seq"),
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_name").alias("name"),
        F.array("p_brand", "p_type").alias("artists"),
        F.col("p_type").alias("album"),
        (F.col("p_size") * 10000 + 999).cast("bigint").alias("duration_ms"),
    )
    return with_key(songs, LIKED_SOURCE)


def plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item is a play; returned ones are filed under another artist."""
    lines = large_table(spark, sf_dir, "lineitem", "l_orderkey").select(*PLAY_ORDER, "l_returnflag")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    artist = F.when(F.col("l_returnflag") == "R", F.col("p_type")).otherwise(F.col("p_brand"))
    songs = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("seq"),
        F.col("p_name").alias("name"),
        artist.alias("artist"),
        F.col("p_type").alias("album"),
        *PLAY_ORDER,
    )
    return with_key(songs, PLAYS_SOURCE)


def user_plays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a play by a user; the last one is still running."""
    events = table(spark, sf_dir, "events")
    last = F.broadcast(events.agg(F.max("event_id").alias("last_id")))
    playing = F.col("last_id").isNotNull()
    return events.join(last, F.col("event_id") == F.col("last_id"), "left").select(
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("name"),
        F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("artist"),
        F.lit("").alias("album"),
        F.when(playing, "Now playing").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("date_text"),
        playing.alias("now_playing"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as lyric records of the part with the same number."""
    documents = large_table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    parts = table(spark, sf_dir, "part")
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "labelled_id")
    silent = F.coalesce(F.col("toxic") == 1, F.lit(False))
    return (
        documents.join(parts, F.col("doc_id") == F.col("p_partkey"))
        .join(labels, F.col("doc_id") == F.col("labelled_id"), "left")
        .select(
            F.col("doc_id").alias("id"),
            F.col("p_name").alias("name"),
            F.col("p_brand").alias("artist"),
            F.col("p_type").alias("album"),
            (F.col("p_size") * 10).cast("double").alias("duration"),
            silent.alias("instrumental"),
            F.when(~silent, F.col("text")).alias("plain_lyrics"),
            F.lit(None).cast("string").alias("synced_lyrics"),
            F.col("labelled_id").isNotNull().alias("labelled"),
        )
    )


def _entries(lyrics: DataFrame) -> DataFrame:
    keyed = lyrics.withColumn("key", song_key(F.col("name"), F.col("artist")))
    return last_per_key(keyed, order=("id",)).select(
        "key",
        F.col("name").alias("track_name"),
        F.col("artist").alias("artist_name"),
        "plain_lyrics", "synced_lyrics", "instrumental",
        F.lit(True).alias("lyrics_found"),
    )


def cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found: songs with a labelled document. Not found: other songs of the largest parts."""
    found = _entries(records(spark, sf_dir).where("labelled"))
    parts = table(spark, sf_dir, "part")
    largest = parts.groupBy("p_name", "p_brand").agg(F.max("p_size").alias("size"))
    none = F.lit(None).cast("string")
    missing = (
        largest.where("size > 45")
        .select(
            song_key(F.col("p_name"), F.col("p_brand")).alias("key"),
            F.col("p_name").alias("track_name"),
            F.col("p_brand").alias("artist_name"),
            none.alias("plain_lyrics"), none.alias("synced_lyrics"),
            F.lit(False).alias("instrumental"), F.lit(False).alias("lyrics_found"),
        )
        .join(found.select("key"), "key", "left_anti")
    )
    return found.unionByName(missing)


def delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New cache rows in the order they are saved: the documents without a label, by number."""
    return records(spark, sf_dir).where("NOT labelled").select(
        song_key(F.col("name"), F.col("artist")).alias("key"),
        F.col("name").alias("track_name"), F.col("artist").alias("artist_name"),
        "plain_lyrics", "synced_lyrics", "instrumental",
        F.lit(True).alias("lyrics_found"),
        F.col("id").alias("seq"),
    )


