"""Counts over the library, the cache and the index. Each is one map-side combined pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from songloom.functions.text import fetch_date


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


#: Counts of cache entries, as SQL; those of parts of a cache add up.
CACHE_COUNTS = {
    "total": "count(1)",
    "with_lyrics": "count_if(coalesce(lyrics_found, false) and not coalesce(instrumental, false))",
    "instrumental": "count_if(coalesce(instrumental, false))",
    "not_found": "count_if(not coalesce(lyrics_found, false))",
}


def cache_stats(cache: DataFrame) -> DataFrame:
    """Entries, with lyrics, instrumental (found or not), not found."""
    return cache.agg(*[F.expr(value).alias(name) for name, value in CACHE_COUNTS.items()])


def index_input_counts(cache: DataFrame) -> DataFrame:
    """Cached songs and those with something to index."""
    return cache.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(_flag("lyrics_found")).alias("found")
    )


def index_run_stats(songs: DataFrame, indexable: Column, index: DataFrame, model: str) -> DataFrame:
    """Processed, indexed (new or replaced), skipped, and the size of the index after."""
    none = F.lit(0).cast("bigint")
    run = songs.select(
        F.lit(1).alias("total_processed"), indexable.cast("int").alias("indexed"), none.alias("size")
    )
    size = index.where(F.col("model") == model).select(
        none.alias("total_processed"), none.alias("indexed"), F.lit(1).alias("size")
    )
    total, indexed, kept = (
        F.coalesce(F.sum(c), none) for c in ("total_processed", "indexed", "size")
    )
    return run.unionByName(size).agg(
        total.alias("total_processed"), indexed.alias("indexed"),
        (total - indexed).alias("skipped"), kept.alias("collection_size"),
    )


def index_sizes(index: DataFrame) -> DataFrame:
    """Indexed songs per model; reads no vectors and loads no model."""
    return index.groupBy("model").agg(F.count(F.lit(1)).alias("collection_size"))


def plays_to_unique(plays: DataFrame) -> DataFrame:
    """Plays and the different songs among them."""
    return plays.agg(
        F.count(F.lit(1)).alias("plays"), F.count_distinct("key").alias("unique_songs")
    )


def row_total(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"))


def store_info(current: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Count, fetch time and place of stored song lists; no row for one never stored.

    The count is the one written at publishing, the list is not read again.
    """
    return current.where(F.col("name").isin(*names)).select(
        F.col("name").alias("source"), F.col("n").alias("count"),
        "fetched_at", F.array_join("paths", ",").alias("file"),
    )


def status_report(info: DataFrame, cache_counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Everything stored, as ``section, metric, value`` rows; ``cache_counts`` is one row."""

    def rows(df: DataFrame, section: Column, *metrics: str) -> DataFrame:
        pairs = F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("string").alias("value"))
            for m in metrics
        ])
        return df.select(section.alias("section"), F.explode(pairs).alias("p")).select("section", "p.*")

    stored = info.withColumn("fetched", fetch_date(F.col("fetched_at")))
    return (
        rows(stored, F.col("source"), "count", "fetched")
        .unionByName(rows(cache_counts, F.lit("cache"), *CACHE_COUNTS))
        .unionByName(rows(sizes, F.concat(F.lit("index "), "model"), "collection_size"))
    )
