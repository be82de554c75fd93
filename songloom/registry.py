"""Every operator as a query over the given tables, next to the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from songloom import proxies, schemas
from songloom.functions import text as tx
from songloom.functions.times import iso_time, unix_time
from songloom.functions.vectors import norm
from songloom.operators import enrich as en
from songloom.operators import stats
from songloom.operators.documents import documents, embeddable, found_songs
from songloom.operators.encoders import HashingEncoder, encode
from songloom.operators.keyword import keyword_search
from songloom.operators.library import (
    LIKED_SOURCE, PLAYS_SOURCE, both_sources, unique_plays, with_lookup, with_more_plays,
)
from songloom.operators.listings import (
    list_enriched, list_liked, list_lyric_results, list_plays,
)
from songloom.operators.lookup import look_up
from songloom.operators.ordering import first_n, last_per_key
from songloom.operators.postings import search_records, stored_postings
from songloom.operators.scratch import kept
from songloom.operators.similarity import top_k
from songloom.plans import index as indexing
from songloom.plans.workspace import LOAD_SOURCES, NothingStored, Workspace
from songloom.session import shared_dir
from songloom.sources import landed
from songloom.sources.buckets import BucketedTable
from songloom.sources.tables import TableStore

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ENCODER = HashingEncoder(64)
SEARCH_TEXTS = ("that slow one about the thing with the and of", "elle un la et les")
WORD_TEXTS = {
    "a": "the thing and of with", "b": "elle un la que", "c": "red widget", "d": "",
}


def query(sql: str = "") -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        @wraps(run)
        def in_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return run(spark, sf_dir)

        QUERIES[run.__name__] = in_utc
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return add


def digest(column: str) -> Column:
    return F.md5(F.col(column)).alias(f"{column}_md5")


# SQL parts ---------------------------------------------------------------------------

KEY = "lower(trim({0})) || '||' || lower(trim({1}))"
LIKED = f"""
  SELECT p_partkey AS seq, CAST(p_partkey AS VARCHAR) AS id, p_name AS name,
    p_brand AS artist, p_brand || ', ' || p_type AS artists, p_type AS album,
    CAST(p_size * 10000 + 999 AS BIGINT) AS duration_ms,
    CASE WHEN p_size * 10000 + 999 <> 0 THEN (p_size * 10000 + 999) // 1000 END AS seconds,
    {KEY.format('p_name', 'p_brand')} AS key
  FROM part"""
PLAY_ORDER = ", ".join(proxies.PLAY_ORDER)
PLAYS = f"""
  SELECT *, {KEY.format('name', 'artist')} AS key FROM (
    SELECT p_name AS name, p_type AS album, {PLAY_ORDER},
      CASE WHEN l_returnflag = 'R' THEN p_type ELSE p_brand END AS artist
    FROM lineitem JOIN part ON l_partkey = p_partkey)"""
UNIQUE_PLAYS = f"""
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {PLAY_ORDER}) AS rn
  FROM ({PLAYS})) WHERE rn = 1"""
RECORDS = f"""
  SELECT doc_id AS id, p_name AS name, p_brand AS artist, p_type AS album,
    CAST(p_size * 10 AS DOUBLE) AS duration, coalesce(toxic = 1, false) AS instrumental,
    CASE WHEN coalesce(toxic = 1, false) THEN NULL ELSE text END AS plain_lyrics,
    CAST(NULL AS VARCHAR) AS synced_lyrics, labels.doc_id IS NOT NULL AS labelled,
    {KEY.format('p_name', 'p_brand')} AS key
  FROM documents JOIN part ON doc_id = p_partkey LEFT JOIN labels USING (doc_id)"""
CACHE = f"""
  SELECT key, name AS track_name, artist AS artist_name, plain_lyrics, synced_lyrics,
    instrumental, true AS lyrics_found
  FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY id DESC) AS rn
        FROM ({RECORDS}) WHERE labelled) WHERE rn = 1
  UNION ALL
  SELECT {KEY.format('p_name', 'p_brand')}, p_name, p_brand, NULL, NULL, false, false
  FROM part GROUP BY p_name, p_brand
  HAVING max(p_size) > 45 AND {KEY.format('p_name', 'p_brand')} NOT IN (
    SELECT key FROM ({RECORDS}) WHERE labelled)"""
# One row per song with its best record by album, then length, then id.
BEST = """
  SELECT * FROM (
    SELECT l.seq, r.id AS record_id, r.plain_lyrics, r.instrumental,
      row_number() OVER (PARTITION BY l.seq
        ORDER BY (r.album = l.album) DESC, abs(r.duration - l.seconds) ASC NULLS LAST, r.id) AS rn
    FROM liked l JOIN records r USING (key)) WHERE rn = 1"""
# Songs worked off one after the other, without force.
ENRICHED = """
  SELECT s.seq, s.name, s.artist, s.artists, s.key, s.place > 1 OR c.key IS NOT NULL AS was_cached,
    CASE WHEN c.key IS NOT NULL THEN c.plain_lyrics ELSE b.plain_lyrics END AS plain_lyrics,
    CASE WHEN c.key IS NOT NULL THEN c.instrumental ELSE coalesce(b.instrumental, false) END
      AS instrumental,
    CASE WHEN c.key IS NOT NULL THEN c.lyrics_found ELSE b.seq IS NOT NULL END AS lyrics_found
  FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS place,
          first_value(seq) OVER (PARTITION BY key ORDER BY seq) AS first_seq FROM liked) s
  LEFT JOIN cache c ON c.key = s.key
  LEFT JOIN best b ON b.seq = s.first_seq"""
FORCED = """
  SELECT s.seq, s.name, s.artist, s.key, b.plain_lyrics,
    coalesce(b.instrumental, false) AS instrumental, b.seq IS NOT NULL AS lyrics_found
  FROM liked s LEFT JOIN best b ON b.seq = s.seq"""
FOUND = "SELECT * FROM cache WHERE lyrics_found"
DOCUMENTS = """
  SELECT key AS id, track_name, artist_name, '' AS album, instrumental,
    coalesce(plain_lyrics, '') <> '' AS has_lyrics,
    concat_ws(chr(10), 'Song: ' || track_name || ' by ' || artist_name,
      CASE WHEN instrumental THEN 'This is an instrumental track with no vocals or lyrics.' END,
      CASE WHEN coalesce(plain_lyrics, '') <> '' THEN 'Lyrics:' || chr(10) || plain_lyrics END
    ) AS document
  FROM found WHERE coalesce(plain_lyrics, '') <> '' OR instrumental"""
_PARTS = {
    "liked": LIKED, "plays": PLAYS, "unique_plays": UNIQUE_PLAYS, "records": RECORDS,
    "cache": CACHE, "best": BEST, "enriched": ENRICHED, "forced": FORCED, "found": FOUND,
    "docs": DOCUMENTS,
}


def sql(parts: str, body: str) -> str:
    """``body`` with the named parts, given in order of need, put before it."""
    return "WITH " + ", ".join(f"{p} AS ({_PARTS[p]})" for p in parts.split()) + body


def hashed(name: str, id_column: str, source: str) -> str:
    """Parts ``<name>_v (id, b, w)`` and ``<name>_n (id, n)``: non-zero cells and lengths."""
    return f"""
  {name}_c AS (
    SELECT id, CAST(CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS INTEGER) AS b, count(*) AS c
    FROM (SELECT {id_column} AS id,
            unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM {source})
    WHERE w <> '' GROUP BY ALL),
  {name}_v AS (
    SELECT id, b, CAST(c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS FLOAT) AS w FROM {name}_c),
  {name}_n AS (
    SELECT id, sqrt(sum(CAST(w AS DOUBLE) * CAST(w AS DOUBLE))) AS n FROM {name}_v GROUP BY id)"""


def hashed_scores(k: int) -> str:
    """Part ``hits``: the best k of ``d`` for every row of ``q``."""
    return f"""
  hits AS (
    SELECT * FROM (
      SELECT query_id, id, score,
        row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
      FROM (
        SELECT q_v.id AS query_id, d_v.id AS id,
          round(least(1.0, sum(CAST(q_v.w AS DOUBLE) * CAST(d_v.w AS DOUBLE))
            / (any_value(q_n.n) * any_value(d_n.n))), 9) AS score
        FROM q_v JOIN d_v USING (b) JOIN q_n ON q_n.id = q_v.id JOIN d_n ON d_n.id = d_v.id
        GROUP BY q_v.id, d_v.id))
    WHERE rank <= {k})"""


# Keys, dedup, library ----------------------------------------------------------------

@query(sql("liked", " SELECT seq, key, artist AS primary_artist FROM liked"))
def song_key(spark, sf_dir):
    return proxies.liked(spark, sf_dir).select("seq", "key", "primary_artist")


@query(sql("unique_plays", f" SELECT key, name, artist, album, {PLAY_ORDER.replace('l_shipdate', 'CAST(l_shipdate AS VARCHAR) AS l_shipdate')} FROM unique_plays"))
def dedup_first(spark, sf_dir):
    return _first_plays(unique_plays(proxies.plays(spark, sf_dir), proxies.PLAY_ORDER))


def _first_plays(songs: DataFrame) -> DataFrame:
    day = F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("l_shipdate")
    order = [day if c == "l_shipdate" else F.col(c) for c in proxies.PLAY_ORDER]
    return songs.select("key", "name", "artist", "album", *order)


@query(ORACLES["dedup_first"])
def plays_in_three_loads(spark, sf_dir):
    """The same songs from a third of the plays at a time."""
    tables = _store(spark)
    plays = proxies.plays(spark, sf_dir)
    for third in range(3):
        some = plays.where(F.col("l_orderkey") % 3 == third)
        tables.publish(with_more_plays(tables.read("songs", plays.schema), some, proxies.PLAY_ORDER), "songs")
    return _first_plays(tables.read("songs", plays.schema))


@query(sql("plays", " SELECT count(*) AS plays, count(DISTINCT key) AS unique_songs FROM plays"))
def plays_to_unique_counts(spark, sf_dir):
    return stats.plays_to_unique(proxies.plays(spark, sf_dir))


_BOTH = """ SELECT source, key, name, artist, album, duration_ms FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY place, seq) AS one FROM (
    SELECT 'spotify' AS source, 0 AS place, seq, key, name, artist, album, duration_ms FROM liked
    UNION ALL SELECT 'lastfm', 1, l_orderkey, key, name, artist, album, NULL FROM unique_plays))
  WHERE one = 1"""


def _both(spark, sf_dir):
    plays = unique_plays(proxies.plays(spark, sf_dir), proxies.PLAY_ORDER)
    return both_sources(proxies.liked(spark, sf_dir), plays.drop(*proxies.PLAY_ORDER))


@query(sql("liked unique_plays", _BOTH))
def library_both(spark, sf_dir):
    return _both(spark, sf_dir).select(
        "source", "key", "name", F.col("primary_artist").alias("artist"), "album", "duration_ms"
    )


@query(sql("liked unique_plays", f" SELECT source, count(*) AS total FROM ({_BOTH}) GROUP BY source"))
def library_both_counts(spark, sf_dir):
    return _both(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("total"))


@query(sql("liked", " SELECT seq, key, name, artists, album FROM liked"))
def library_single(spark, sf_dir):
    return proxies.liked(spark, sf_dir).select(
        "seq", "key", "name", F.array_join("artists", ", ").alias("artists"), "album"
    )


@query(sql("liked", " SELECT seq, name FROM liked ORDER BY seq LIMIT 25"))
def first_songs(spark, sf_dir):
    return first_n(proxies.liked(spark, sf_dir), 25).select("seq", "name")


# Enrichment --------------------------------------------------------------------------

@query(sql("liked", " SELECT seq, key, album AS lookup_album, seconds AS lookup_seconds FROM liked"))
def lookup_parameters(spark, sf_dir):
    songs = with_lookup(proxies.liked(spark, sf_dir), LIKED_SOURCE)
    return songs.select("seq", "key", "lookup_album", "lookup_seconds")


@query(sql("liked records cache", """
  SELECT s.seq, s.key, c.lyrics_found, c.instrumental, md5(c.plain_lyrics) AS plain_lyrics_md5,
    c.key IS NOT NULL AS was_cached FROM liked s LEFT JOIN cache c ON c.key = s.key"""))
def cache_lookup(spark, sf_dir):
    songs = en.cache_lookup(proxies.liked(spark, sf_dir), proxies.cache(spark, sf_dir))
    return songs.select(
        "seq", "key", "lyrics_found", "instrumental", digest("plain_lyrics"), "was_cached"
    )


@query(sql("liked records cache", """
  SELECT seq, key FROM liked WHERE key NOT IN (SELECT key FROM cache)"""))
def uncached_songs(spark, sf_dir):
    songs = en.uncached(proxies.liked(spark, sf_dir), proxies.cache(spark, sf_dir))
    return songs.select("seq", "key")


@query(sql("liked records cache", """
  SELECT count(*) FILTER (key IN (SELECT key FROM cache)) AS skipped,
    count(*) FILTER (key NOT IN (SELECT key FROM cache)) AS available FROM liked"""))
def cache_coverage(spark, sf_dir):
    return en.cache_coverage(proxies.liked(spark, sf_dir), proxies.cache(spark, sf_dir))


@query(sql("liked records cache", """
  SELECT seq, key FROM liked WHERE key NOT IN (SELECT key FROM cache) ORDER BY seq LIMIT 40"""))
def first_new_songs(spark, sf_dir):
    songs = en.songs_to_process(
        proxies.liked(spark, sf_dir), proxies.cache(spark, sf_dir), new=40
    )
    return songs.select("seq", "key")


@query(sql("liked records best", """
  SELECT s.seq, s.key, b.record_id, md5(b.plain_lyrics) AS plain_lyrics_md5,
    coalesce(b.instrumental, false) AS instrumental, b.seq IS NOT NULL AS lyrics_found
  FROM liked s LEFT JOIN best b ON b.seq = s.seq"""))
def lyric_lookup_best(spark, sf_dir):
    songs = with_lookup(proxies.liked(spark, sf_dir), LIKED_SOURCE)
    asked = songs.select("key", "lookup_album", "lookup_seconds").distinct()
    answers = look_up(asked, proxies.records(spark, sf_dir), unique_keys=False)
    joined = en.join_unique(songs, answers, en.LOOKUP, null_safe=en.LOOKUP_NULLS)
    return joined.select(
        "seq", "key", "record_id", digest("plain_lyrics"), "instrumental", "lyrics_found"
    )


@query(sql("liked records best", """
  SELECT record_id AS id, liked.name, plain_lyrics, instrumental
  FROM best JOIN liked USING (seq) WHERE seq = (SELECT min(seq) FROM best)"""))
def lookup_stored(spark, sf_dir):
    """One song, looked up in records that are stored by key."""
    records = proxies.records(spark, sf_dir)
    music = Workspace(spark, shared_dir(spark))
    music.store_lyrics(records.drop("labelled"))
    songs = with_lookup(proxies.liked(spark, sf_dir), LIKED_SOURCE)
    keys = records.select(tx.song_key(F.col("name"), F.col("artist")).alias("key")).distinct()
    song = songs.join(keys, "key", "left_semi").orderBy("seq").first()
    if song is None:
        return music.lyrics().where("false").select("id", "name", "plain_lyrics", "instrumental")
    found = music.lyrics_for(song.name, song.primary_artist, song.lookup_album, song.lookup_seconds)
    return found.select("id", "name", "plain_lyrics", "instrumental")


@query(sql("liked records best forced", """
  SELECT seq, md5(plain_lyrics) AS plain_lyrics_md5, instrumental, lyrics_found FROM forced"""))
def fetch_lyrics(spark, sf_dir):
    songs = en.fetch_lyrics(
        proxies.liked(spark, sf_dir), proxies.records(spark, sf_dir), LIKED_SOURCE
    )
    return songs.select("seq", digest("plain_lyrics"), "instrumental", "lyrics_found")


def _run(spark, sf_dir, **options):
    return en.enrich(
        proxies.liked(spark, sf_dir), proxies.cache(spark, sf_dir),
        proxies.records(spark, sf_dir), LIKED_SOURCE, **options,
    )


_SUMMARY = """
  SELECT count(*) AS processed, count(*) FILTER (lyrics_found AND NOT instrumental) AS found,
    count(*) FILTER (lyrics_found AND instrumental) AS instrumental,
    count(*) FILTER (NOT lyrics_found) AS not_found, count(*) FILTER (was_cached) AS from_cache,
    count(*) FILTER (NOT was_cached) AS lookups FROM """


@query(sql("liked records cache best enriched", """
  SELECT seq, key, md5(plain_lyrics) AS plain_lyrics_md5, instrumental, lyrics_found, was_cached,
    CASE WHEN instrumental THEN '[instrumental]' WHEN lyrics_found THEN '[found]'
      ELSE '[missing]' END AS status FROM enriched"""))
def enrich_full(spark, sf_dir):
    return en.with_status(_run(spark, sf_dir).songs).select(
        "seq", "key", digest("plain_lyrics"), "instrumental", "lyrics_found", "was_cached", "status"
    )


@query(sql("liked records cache best enriched", _SUMMARY + "enriched"))
def enrich_summary(spark, sf_dir):
    return en.run_summary(_run(spark, sf_dir).songs)


@query(sql("liked records cache best enriched", """
  SELECT seq, key, was_cached, lyrics_found FROM enriched"""))
def enrich_attribution(spark, sf_dir):
    return _run(spark, sf_dir).songs.select("seq", "key", "was_cached", "lyrics_found")


@query(sql("liked records cache best enriched", _SUMMARY +
           "(SELECT * FROM enriched ORDER BY seq LIMIT 100)"))
def enrich_limit(spark, sf_dir):
    return en.run_summary(_run(spark, sf_dir, limit=100).songs)


@query(sql("liked records cache best enriched", """
  SELECT seq, key, lyrics_found,
    row_number() OVER (PARTITION BY key ORDER BY seq) > 1 AS was_cached FROM enriched
  WHERE key NOT IN (SELECT key FROM cache) ORDER BY seq LIMIT 40"""))
def enrich_new(spark, sf_dir):
    return _run(spark, sf_dir, new=40).songs.select("seq", "key", "lyrics_found", "was_cached")


@query(sql("liked records cache best forced", """
  SELECT seq, key, md5(plain_lyrics) AS plain_lyrics_md5, instrumental, lyrics_found,
    false AS was_cached FROM forced"""))
def enrich_forced(spark, sf_dir):
    return _run(spark, sf_dir, force=True).songs.select(
        "seq", "key", digest("plain_lyrics"), "instrumental", "lyrics_found", "was_cached"
    )


_ENTRY = ("key", "track_name", "artist_name", "instrumental", "lyrics_found")


@query(sql("liked records cache best forced", """
  SELECT key, track_name, artist_name, instrumental, lyrics_found,
    md5(plain_lyrics) AS plain_lyrics_md5 FROM cache
  WHERE key NOT IN (SELECT key FROM liked)
  UNION ALL SELECT key, name, artist, instrumental, lyrics_found, md5(plain_lyrics) FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM forced)
  WHERE rn = 1"""))
def enrich_forced_cache(spark, sf_dir):
    run = _run(spark, sf_dir, force=True)
    after = en.upsert(proxies.cache(spark, sf_dir), run.delta, ["key"])
    return after.select(*_ENTRY, digest("plain_lyrics"))


@query(sql("liked records cache best enriched", """
  SELECT key, track_name, artist_name, instrumental, lyrics_found,
    md5(plain_lyrics) AS plain_lyrics_md5 FROM cache
  UNION ALL SELECT key, name, artist, instrumental, lyrics_found, md5(plain_lyrics)
  FROM enriched WHERE NOT was_cached"""))
def enrich_cache(spark, sf_dir):
    run = _run(spark, sf_dir)
    after = proxies.cache(spark, sf_dir).unionByName(run.delta)
    return after.select(*_ENTRY, digest("plain_lyrics"))


# Cache tables ------------------------------------------------------------------------

_SAVED = """
  SELECT * FROM (SELECT key, name AS track_name, artist AS artist_name, instrumental,
      true AS lyrics_found, plain_lyrics,
      row_number() OVER (PARTITION BY key ORDER BY id DESC) AS rn
    FROM records WHERE NOT labelled) WHERE rn = 1"""


@query(sql("records", f"""
  SELECT key, track_name, artist_name, instrumental, lyrics_found,
    md5(plain_lyrics) AS plain_lyrics_md5 FROM ({_SAVED})"""))
def cache_last_write(spark, sf_dir):
    return last_per_key(proxies.delta(spark, sf_dir)).select(*_ENTRY, digest("plain_lyrics"))


@query(sql("records cache", f"""
  SELECT key, track_name, artist_name, instrumental, lyrics_found,
    md5(plain_lyrics) AS plain_lyrics_md5 FROM ({_SAVED})
  UNION ALL SELECT key, track_name, artist_name, instrumental, lyrics_found, md5(plain_lyrics)
  FROM cache WHERE key NOT IN (SELECT key FROM ({_SAVED}))"""))
def cache_upsert(spark, sf_dir):
    after = en.save_to_cache(proxies.cache(spark, sf_dir), proxies.delta(spark, sf_dir))
    return after.select(*_ENTRY, digest("plain_lyrics"))


def _stored_cache(spark) -> BucketedTable:
    return BucketedTable(_store(spark), "lyrics_cache", schemas.CACHE, stats.CACHE_COUNTS)


@query(ORACLES["cache_upsert"])
def cache_saved_twice(spark, sf_dir):
    stored = _stored_cache(spark)
    stored.save(proxies.cache(spark, sf_dir))
    stored.save(last_per_key(proxies.delta(spark, sf_dir)))
    return stored.read().select(*_ENTRY, digest("plain_lyrics"))


@query(sql("records cache", """
  SELECT count(*) AS total, count(*) FILTER (lyrics_found AND NOT instrumental) AS with_lyrics,
    count(*) FILTER (instrumental) AS instrumental,
    count(*) FILTER (NOT lyrics_found) AS not_found FROM cache"""))
def cache_stats(spark, sf_dir):
    return stats.cache_stats(proxies.cache(spark, sf_dir))


@query(sql("records cache", """
  SELECT count(*) AS total, count(*) FILTER (lyrics_found) AS found FROM cache"""))
def index_input_counts(spark, sf_dir):
    return stats.index_input_counts(proxies.cache(spark, sf_dir))


def _store(spark) -> TableStore:
    return TableStore(spark, shared_dir(spark))


def _stored_lists(spark, sf_dir) -> TableStore:
    tables = _store(spark)
    tables.publish(proxies.liked(spark, sf_dir), LIKED_SOURCE)
    tables.publish(unique_plays(proxies.plays(spark, sf_dir), proxies.PLAY_ORDER), PLAYS_SOURCE)
    return tables


@query(sql("liked unique_plays", """
  SELECT 'spotify' AS source, count(*) AS count, true AS stamped FROM liked
  UNION ALL SELECT 'lastfm', count(*), true FROM unique_plays"""))
def store_info(spark, sf_dir):
    current = _stored_lists(spark, sf_dir).current()
    info = stats.store_info(current, (LIKED_SOURCE, PLAYS_SOURCE))
    today = tx.fetch_date(F.col("fetched_at")) >= F.date_sub(F.current_date(), 1).cast("string")
    return info.select("source", "count", today.alias("stamped"))


@query(sql("liked unique_plays records cache found docs", """
  SELECT 'spotify' AS section, 'count' AS metric, CAST(count(*) AS VARCHAR) AS value FROM liked
  UNION ALL SELECT 'lastfm', 'count', CAST(count(*) AS VARCHAR) FROM unique_plays
  UNION ALL SELECT 'cache', 'total', CAST(count(*) AS VARCHAR) FROM cache
  UNION ALL SELECT 'cache', 'with_lyrics',
    CAST(count(*) FILTER (lyrics_found AND NOT instrumental) AS VARCHAR) FROM cache
  UNION ALL SELECT 'cache', 'instrumental',
    CAST(count(*) FILTER (instrumental) AS VARCHAR) FROM cache
  UNION ALL SELECT 'cache', 'not_found',
    CAST(count(*) FILTER (NOT lyrics_found) AS VARCHAR) FROM cache
  UNION ALL SELECT 'index hashing-64', 'collection_size', CAST(count(*) AS VARCHAR) FROM docs"""))
def status_report(spark, sf_dir):
    info = stats.store_info(_stored_lists(spark, sf_dir).current(), (LIKED_SOURCE, PLAYS_SOURCE))
    cache = _stored_cache(spark)
    # Half of the cache at a time: the counts of both are those of the folders written.
    for part in (0, 1):
        half = proxies.cache(spark, sf_dir).where(F.pmod(F.xxhash64("key"), F.lit(2)) == part)
        cache.save(half, new_keys=True)
    sizes = stats.index_sizes(indexing.index_rows(found_songs(cache.read()), ENCODER))
    return stats.status_report(info, cache.totals(), sizes).where("metric <> 'fetched'")


@query(sql("liked", " SELECT seq, id, key, name, album, duration_ms FROM liked"))
def snapshot_roundtrip(spark, sf_dir):
    tables, songs = _store(spark), proxies.liked(spark, sf_dir)
    long = F.col("duration_ms") > 250_000
    tables.publish(songs.where(~long), LIKED_SOURCE)
    tables.publish(songs.where(long), LIKED_SOURCE, append=True)
    stored = tables.read(LIKED_SOURCE, schemas.LIKED + ", key string")
    return stored.select("seq", "id", "key", "name", "album", "duration_ms")


@query(sql("records cache", " SELECT count(*) AS cleared, CAST(0 AS BIGINT) AS left_over FROM cache"))
def clear_counts(spark, sf_dir):
    tables = _store(spark)
    tables.publish(proxies.cache(spark, sf_dir), "lyrics_cache")
    cleared = tables.clear("lyrics_cache", schemas.CACHE)
    after = tables.read("lyrics_cache", schemas.CACHE)
    return after.agg(F.lit(cleared).cast("bigint").alias("cleared"), F.count("key").alias("left_over"))


# Documents, encoding, index ----------------------------------------------------------

@query(sql("records cache found docs", " SELECT id, document FROM docs"))
def document_text(spark, sf_dir):
    return documents(found_songs(proxies.cache(spark, sf_dir))).select("id", "document")


@query("""
  SELECT doc_id, concat_ws(chr(10), 'Song: ' || p_name || ' by ' || p_brand || ', ' || p_type,
    'Album: ' || p_type, CASE WHEN text <> '' THEN 'Lyrics:' || chr(10) || text END) AS document
  FROM documents JOIN part ON doc_id = p_partkey""")
def document_text_with_album(spark, sf_dir):
    songs = proxies.liked(spark, sf_dir)
    texts = proxies.large_table(spark, sf_dir, "documents", "doc_id").select(
        F.col("doc_id"), F.col("text").alias("plain_lyrics")
    )
    both = songs.join(texts, F.col("seq") == F.col("doc_id"))
    shown = both.withColumn("artist", F.col("artists"))
    from songloom.operators.documents import document_text as build

    return shown.select("doc_id", build(shown).alias("document"))


@query(sql("records cache found docs", """
  SELECT id, track_name, artist_name, album, instrumental, has_lyrics FROM docs"""))
def index_metadata(spark, sf_dir):
    return documents(found_songs(proxies.cache(spark, sf_dir))).drop("document")


@query(sql("records cache found docs", """
  SELECT (SELECT count(*) FROM found) AS total_processed, (SELECT count(*) FROM docs) AS indexed,
    (SELECT count(*) FROM found) - (SELECT count(*) FROM docs) AS skipped,
    (SELECT count(*) FROM docs) AS collection_size"""))
def index_run_stats(spark, sf_dir):
    songs = found_songs(proxies.cache(spark, sf_dir))
    rows = indexing.index_rows(songs, ENCODER)
    empty = spark.createDataFrame([], rows.schema)
    after = indexing.upsert(empty, rows, ["model", "id"])
    return stats.index_run_stats(songs, embeddable(songs), after, ENCODER.model)


@query("WITH " + hashed("d", "doc_id", "documents") + """
  SELECT id AS doc_id, b AS bucket, round(CAST(w AS DOUBLE), 6) AS weight FROM d_v""")
def hash_encode(spark, sf_dir):
    texts = proxies.large_table(spark, sf_dir, "documents", "doc_id").select("doc_id", "text")
    # The outer form keeps Spark from encoding twice, once to filter empty vectors.
    cells = encode(texts, ENCODER, "text").select(
        "doc_id", F.posexplode_outer("embedding").alias("bucket", "w")
    )
    return cells.where("w <> 0").select(
        "doc_id", "bucket", F.round(F.col("w").cast("double"), 6).alias("weight")
    )


def _index(spark, sf_dir, songs: DataFrame) -> DataFrame:
    return indexing.index_rows(songs, ENCODER)


@query(sql("records cache found docs", f"""
  , saved AS ({_SAVED}), fresh AS (
    SELECT key AS id, instrumental, 'Song: ' || track_name || ' by ' || artist_name || chr(10) ||
      CASE WHEN instrumental THEN 'This is an instrumental track with no vocals or lyrics.'
        ELSE 'Lyrics:' || chr(10) || plain_lyrics END AS document FROM saved),
  named AS (
    SELECT id, instrumental, document AS text FROM fresh
    UNION ALL SELECT id, instrumental, document FROM docs WHERE id NOT IN (SELECT id FROM fresh)),"""
    + hashed("h", "id", "named") + """
  SELECT id, 'hashing-64' AS model, instrumental, md5(text) AS document_md5, 1.0::DOUBLE AS length,
    cells, heaviest
  FROM named JOIN (SELECT id, count(*) AS cells, round(max(CAST(w AS DOUBLE)), 6) AS heaviest
    FROM h_v GROUP BY id) USING (id)"""))
def index_upsert(spark, sf_dir):
    before = kept(_index(spark, sf_dir, found_songs(proxies.cache(spark, sf_dir))))
    saved = last_per_key(proxies.delta(spark, sf_dir))
    after = indexing.build_index(before, saved, ENCODER)
    return after.select(
        "id", "model", "instrumental", digest("document"), F.round("norm", 6).alias("length"),
        F.size(F.filter("embedding", lambda x: x != 0)).cast("bigint").alias("cells"),
        F.round(F.array_max("embedding").cast("double"), 6).alias("heaviest"),
    )


@query(sql("records cache found docs", """
  SELECT 'hashing-64' AS model, count(*) AS collection_size FROM docs"""))
def index_sizes(spark, sf_dir):
    return stats.index_sizes(_index(spark, sf_dir, found_songs(proxies.cache(spark, sf_dir))))


# Search ------------------------------------------------------------------------------

def _stored_vectors(spark, sf_dir) -> DataFrame:
    vectors = proxies.table(spark, sf_dir, "embeddings")
    return vectors.select(
        F.col("vec_id").alias("id"), F.lit("stored").alias("model"), "embedding",
        norm(F.col("embedding")).alias("norm"), "label",
    )


def _label_queries(index: DataFrame) -> DataFrame:
    """Of every label, the vector with the lowest id."""
    first = index.groupBy("label").agg(F.min_by(F.struct("embedding", "norm"), "id").alias("v"))
    return first.select(F.col("label").alias("query_id"), F.lit("stored").alias("model"), "v.*")


_VECTOR_SQL = """
  SELECT * FROM (
    SELECT query_id, id, round(score, 6) AS score,
      row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank
    FROM (SELECT q.label AS query_id, i.vec_id AS id,
        list_cosine_similarity(q.v::DOUBLE[], i.embedding::DOUBLE[]) AS score
      FROM (SELECT label, min_by(embedding, vec_id) AS v FROM embeddings GROUP BY label) q,
        embeddings i)) WHERE rank <= 10"""


def _six_digits(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(_VECTOR_SQL)
def vector_topk(spark, sf_dir):
    index = _stored_vectors(spark, sf_dir)
    return _six_digits(top_k(_label_queries(index), index, 10))


@query("""
  SELECT * FROM (
    SELECT query_id, id, round(score, 6) AS score,
      row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank
    FROM (SELECT q.vec_id AS query_id, i.vec_id AS id,
        list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS score
      FROM embeddings q, embeddings i WHERE q.vec_id % 20 = 0)) WHERE rank <= 10""")
def vector_topk_all(spark, sf_dir):
    index = _stored_vectors(spark, sf_dir)
    asked = index.where(F.col("id") % 20 == 0).withColumnRenamed("id", "query_id")
    return _six_digits(top_k(asked, index, 10))


@query(_VECTOR_SQL)
def vector_topk_batch(spark, sf_dir):
    index = _stored_vectors(spark, sf_dir)
    return _six_digits(top_k(_label_queries(index), index, 10, block_bytes=1 << 14))


@query("WITH " + hashed("d", "doc_id", "documents") + "," + hashed("q", "item_id", "benchmark")
       + "," + hashed_scores(10) + """
  SELECT query_id, rank, id, round(score, 6) AS score FROM hits""")
def text_topk_batch(spark, sf_dir):
    texts = proxies.large_table(spark, sf_dir, "documents", "doc_id").select(F.col("doc_id").alias("id"), "text")
    asked = proxies.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    index = encode(texts, ENCODER, "text").drop("text")
    queries = indexing.query_vectors(asked, ENCODER)
    return _six_digits(top_k(queries, index, 10))


_TEXT_ROWS = ", ".join(f"({i}, '{t}')" for i, t in enumerate(SEARCH_TEXTS))


@query(sql("records cache found docs", f""", named AS (
    SELECT id, document AS text FROM docs), texts(qid, text) AS (VALUES {_TEXT_ROWS}),"""
    + hashed("d", "id", "named") + "," + hashed("q", "qid", "texts") + "," + hashed_scores(5) + """
  SELECT CAST(query_id AS BIGINT) AS query_id, rank, track_name, artist_name, album,
    round(1 - score, 6) AS distance, round(score, 6) AS score,
    round(score * 100, 1) AS match_percent,
    CASE WHEN length(document) > 200 THEN substr(document, 1, 200) || '...' ELSE document END
      AS document_preview
  FROM hits JOIN docs USING (id)"""))
def search_results(spark, sf_dir):
    index = _index(spark, sf_dir, found_songs(proxies.cache(spark, sf_dir)))
    found = indexing.search(index, list(SEARCH_TEXTS), ENCODER, 5)
    return found.withColumns(
        {"score": F.round("score", 6), "distance": F.round("distance", 6)}
    )


_WORD_ROWS = ", ".join(f"('{q}', '{t}')" for q, t in WORD_TEXTS.items())
_WORD_SQL = f"""WITH r AS ({RECORDS}), texts(query_id, text) AS (VALUES {_WORD_ROWS}),
  asked AS (SELECT DISTINCT query_id, w FROM (SELECT query_id,
    unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM texts) WHERE w <> ''),
  held AS (SELECT DISTINCT id, w FROM (SELECT id, unnest(regexp_split_to_array(
    lower(concat_ws(' ', name, artist, album, plain_lyrics)), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM r)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
    FROM (SELECT query_id, id, CAST(count(*) AS INTEGER) AS score
      FROM asked JOIN held USING (w) GROUP BY ALL))"""


@query(_WORD_SQL + """
  SELECT query_id, rank, score, id, name, artist, md5(plain_lyrics) AS plain_lyrics_md5
  FROM ranked JOIN r USING (id) WHERE rank <= 10""")
def lyric_keyword_search(spark, sf_dir):
    found = keyword_search(proxies.records(spark, sf_dir), WORD_TEXTS, 10)
    return found.select(
        "query_id", "rank", "score", "id", "name", "artist", digest("plain_lyrics")
    )


@query(_WORD_SQL.replace(f"(VALUES {_WORD_ROWS})", "(SELECT item_id, text FROM benchmark)") + """
  SELECT query_id, rank, score, id, name, artist, md5(plain_lyrics) AS plain_lyrics_md5
  FROM ranked JOIN r USING (id) WHERE rank <= 10""")
def keyword_batch(spark, sf_dir):
    records = proxies.records(spark, sf_dir)
    asked = proxies.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = search_records(records, stored_postings(records), asked, 10)
    return found.select("query_id", "rank", "score", "id", "name", "artist", digest("plain_lyrics"))


@query(_WORD_SQL + """
  SELECT query_id, rank, name, artist, album,
    CASE WHEN coalesce(plain_lyrics, '') <> '' THEN 'yes' ELSE 'no' END AS lyrics,
    CASE WHEN instrumental THEN '[instrumental]' ELSE '' END AS tag,
    array_to_string(list_slice(lines, 1, 6), chr(10)) AS preview,
    CAST(greatest(coalesce(len(lines), 0) - 6, 0) AS INTEGER) AS more_lines
  FROM (SELECT *, CASE WHEN coalesce(plain_lyrics, '') <> '' THEN
      string_split(regexp_replace(plain_lyrics, '^\\s+|\\s+$', '', 'g'), chr(10)) END AS lines
    FROM ranked JOIN r USING (id) WHERE rank <= 5 AND query_id = 'a')""")
def lyric_search_listing(spark, sf_dir):
    found = keyword_search(proxies.records(spark, sf_dir), {"a": WORD_TEXTS["a"]}, 5)
    return list_lyric_results(found)


@query("""
  SELECT doc_id, CASE WHEN lines[1] IS NULL THEN NULL
      ELSE array_to_string(list_slice(lines, 1, 6), chr(10)) END AS preview,
    CAST(greatest(coalesce(len(lines), 0) - 6, 0) AS INTEGER) AS more_lines,
    CASE WHEN text <> '' THEN 'yes' ELSE 'no' END AS lyrics,
    CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS head
  FROM (SELECT *, CASE WHEN text <> '' THEN
      string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10)) END AS lines
    FROM documents)""")
def lyric_preview(spark, sf_dir):
    text = F.col("text")
    return proxies.large_table(spark, sf_dir, "documents", "doc_id").select(
        "doc_id", tx.lyric_preview(text).alias("preview"),
        tx.further_lines(text).alias("more_lines"),
        tx.has_lyrics_label(text).alias("lyrics"), tx.document_preview(text).alias("head"),
    )


@query("""
  SELECT item_id, array_to_string(list_filter(
      regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''), ' ') AS text
  FROM benchmark""")
def query_text(spark, sf_dir):
    asked = proxies.table(spark, sf_dir, "benchmark")
    return asked.select("item_id", tx.query_text(tx.words(F.col("text"))).alias("text"))


# Listings ----------------------------------------------------------------------------

@query(sql("liked", """
  SELECT row_number() OVER (ORDER BY seq) AS number, left(name, 38) AS title,
    left(artists, 28) AS artists, left(album, 28) AS album FROM liked"""))
def listing_liked(spark, sf_dir):
    return list_liked(proxies.liked(spark, sf_dir))


@query("""
  SELECT row_number() OVER (ORDER BY event_id) AS number,
    CASE WHEN event_id = (SELECT max(event_id) FROM events) THEN '> ' ELSE '' END
      || left(event_type, 38) AS title,
    left('user ' || CAST(user_id AS VARCHAR), 28) AS artist,
    CASE WHEN event_id = (SELECT max(event_id) FROM events) THEN 'Now playing'
      ELSE strftime(ts, '%Y-%m-%d') END AS date FROM events""")
def listing_plays(spark, sf_dir):
    return list_plays(proxies.user_plays(spark, sf_dir))


@query(sql("liked records cache best enriched", """
  SELECT row_number() OVER (ORDER BY seq) AS number, left(name, 33) AS title,
    left(artist, 23) AS artist,
    CASE WHEN instrumental THEN '[instrumental]' WHEN lyrics_found THEN '[found]'
      ELSE '[missing]' END AS status FROM enriched"""))
def listing_enriched(spark, sf_dir):
    return list_enriched(_run(spark, sf_dir).songs, LIKED_SOURCE)


@query("SELECT count(*) AS total FROM events")
def listing_total(spark, sf_dir):
    return stats.row_total(proxies.user_plays(spark, sf_dir))


# Landed pages ------------------------------------------------------------------------

@query("""
  SELECT (p_partkey // 50) * 4294967296 + p_partkey % 50 AS seq,
    CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_brand || ', ' || p_type AS artists,
    p_type AS album, '2024-01-01T00:00:00Z' AS added_at, '2024-01-01 00:00:00' AS added_ts,
    CAST(p_size * 10000 + 999 AS BIGINT) AS duration_ms,
    CASE WHEN p_size > 25 THEN 'part/' || CAST(p_partkey AS VARCHAR) ELSE '' END AS spotify_url
  FROM part""")
def normalize_liked(spark, sf_dir):
    songs = landed.normalize_liked(_liked_pages(proxies.table(spark, sf_dir, "part")))
    return songs.select(
        "seq", "id", "name", F.array_join("artists", ", ").alias("artists"), "album", "added_at",
        F.date_format("added_ts", "yyyy-MM-dd HH:mm:ss").alias("added_ts"),
        "duration_ms", "spotify_url",
    )


@query("""
  SELECT DISTINCT p_partkey // 50 AS page,
    CASE p_partkey // 50 % 3 WHEN 0 THEN 'no list of songs' ELSE 'error 29' END AS reason
  FROM part WHERE p_partkey // 50 % 3 < 2""")
def rejected_pages(spark, sf_dir):
    """A third of the pages cut short, a third replaced by an error, a third sound."""
    third = F.col("page") % 3
    body = (
        F.when(third == 0, F.substring("body", 1, 40)).when(third == 1, '{"error": 29, "message": "limit"}')
        .otherwise(F.col("body"))
    )
    pages = _liked_pages(proxies.table(spark, sf_dir, "part")).withColumn("body", body)
    return landed.rejected_liked(pages).select("page", "reason")


def _liked_pages(parts: DataFrame) -> DataFrame:
    """Parts as pages of 50 saved tracks."""
    url = F.when(F.col("p_size") > 25, F.concat(F.lit("part/"), F.col("p_partkey").cast("string")))
    track = F.struct(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_name").alias("name"),
        F.array(F.struct(F.col("p_brand").alias("name")), F.struct(F.col("p_type").alias("name")))
        .alias("artists"),
        F.struct(F.col("p_type").alias("name")).alias("album"),
        (F.col("p_size") * 10000 + 999).alias("duration_ms"),
        F.struct(url.alias("spotify")).alias("external_urls"),
    )
    item = F.struct(
        F.col("p_partkey").alias("at"), F.lit("2024-01-01T00:00:00Z").alias("added_at"),
        track.alias("track"),
    )
    items = F.array_sort(F.collect_list(item)).alias("items")
    return parts.groupBy(F.floor(F.col("p_partkey") / 50).cast("bigint").alias("page")).agg(items).select(
        "page", F.to_json(F.struct("items")).alias("body")
    )


# Two pages per seven events, by value: some hold one event only.
_EVENT_PAGE = "(event_id // 7) * 2 + CASE WHEN value >= 20 THEN 1 ELSE 0 END"


@query(f"""
  SELECT page * 4294967296 + row_number() OVER (PARTITION BY page ORDER BY event_id) - 1 AS seq,
    event_type AS name, 'user ' || CAST(user_id AS VARCHAR) AS artist, props AS album,
    CASE WHEN event_type <> 'error' THEN CAST(CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS VARCHAR) END AS "timestamp",
    CASE WHEN event_type <> 'error' THEN strftime(ts, '%Y-%m-%d %H:%M') END AS played_at,
    CASE WHEN event_type = 'error' THEN 'Now playing' ELSE strftime(ts, '%Y-%m-%d') END AS date_text,
    event_type = 'error' AS now_playing, '' AS lastfm_url
  FROM (SELECT *, {_EVENT_PAGE} AS page FROM events)""")
def normalize_plays(spark, sf_dir):
    plays = landed.normalize_plays(_play_pages(spark, sf_dir))
    return plays.select(
        "seq", "name", "artist", "album", "timestamp",
        F.date_format("played_at", "yyyy-MM-dd HH:mm").alias("played_at"),
        "date_text", "now_playing", "lastfm_url",
    )


def _play_pages(spark, sf_dir) -> DataFrame:
    """Events as pages of at most seven plays; a page of one sends an object, not a list."""
    events = proxies.table(spark, sf_dir, "events")
    running = F.when(F.col("event_type") == "error", "true")
    track = F.struct(
        F.col("event_type").alias("name"),
        F.struct(F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("#text")).alias("artist"),
        F.struct(F.col("props").alias("#text")).alias("album"),
        F.struct(
            F.unix_timestamp("ts").cast("string").alias("uts"),
            F.date_format("ts", "yyyy-MM-dd").alias("#text"),
        ).alias("date"),
        F.struct(running.alias("nowplaying")).alias("@attr"),
    )
    half = F.when(F.col("value") >= 20, 1).otherwise(0)
    page = (F.floor(F.col("event_id") / 7) * 2 + half).cast("bigint").alias("page")
    placed = F.struct("event_id", track.alias("track"))
    pages = events.groupBy(page).agg(F.array_sort(F.collect_list(placed))["track"].alias("tracks"))
    tracks = F.when(F.size("tracks") == 1, F.to_json(F.col("tracks")[0])).otherwise(F.to_json("tracks"))
    listed = pages.select(
        "page", F.concat(F.lit('{"recenttracks":{"track":'), tracks, F.lit("}}")).alias("body")
    )
    # A last page without plays carries the totals.
    attr = F.struct(
        F.count(F.lit(1)).cast("string").alias("total"),
        F.count_distinct(page).cast("string").alias("totalPages"),
    )
    totals = events.agg(attr.alias("@attr"), (F.max(page) + 1).alias("page")).select(
        "page", F.to_json(F.struct(F.struct("`@attr`").alias("recenttracks"))).alias("body")
    )
    return listed.unionByName(totals)


@query(f"SELECT count(*) AS total_scrobbles, count(DISTINCT {_EVENT_PAGE}) AS total_pages FROM events")
def page_totals(spark, sf_dir):
    return landed.page_totals(_play_pages(spark, sf_dir))


@query(f"""
  SELECT id, name, artist, album, duration, instrumental,
    md5(plain_lyrics) AS plain_lyrics_md5 FROM ({RECORDS})""")
def normalize_lyrics(spark, sf_dir):
    rows = proxies.records(spark, sf_dir)
    # Half of the records carry the title under the older name only.
    old = F.col("labelled")
    raw = rows.select(
        "id", F.when(~old, F.col("name")).alias("trackName"), F.when(old, F.col("name")).alias("name"),
        F.col("artist").alias("artistName"), F.col("album").alias("albumName"), "duration",
        F.when(F.col("instrumental"), True).alias("instrumental"),
        F.col("plain_lyrics").alias("plainLyrics"), F.col("synced_lyrics").alias("syncedLyrics"),
    )
    return landed.normalize_lyrics(raw).select(
        "id", "name", "artist", "album", "duration", "instrumental", digest("plain_lyrics")
    )


@query("""
  SELECT event_id, strftime(date_trunc('second', ts),
      '%Y-%m-%d %H:%M:%S') AS played_at,
    strftime(ts, '%Y-%m-%d') AS day FROM events""")
def time_parsing(spark, sf_dir):
    events = proxies.table(spark, sf_dir, "events")
    seconds = F.unix_timestamp("ts").cast("string")
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return events.select(
        "event_id",
        F.date_format(unix_time(seconds), "yyyy-MM-dd HH:mm:ss").alias("played_at"),
        tx.fetch_date(iso_time(text)).alias("day"),
    )


# Choices and empty stores ------------------------------------------------------------

_PLAY_KEY = "lower(trim(event_type)) || '||user ' || CAST(user_id AS VARCHAR)"
_SONGS = f"""
  WITH n(source, songs) AS (
    SELECT 'spotify', (SELECT count(*) FROM part)
    UNION ALL SELECT 'lastfm', (SELECT count(DISTINCT {_PLAY_KEY}) FROM events)
    UNION ALL SELECT 'both', (SELECT count(DISTINCT key) FROM (
      SELECT {KEY.format('p_name', 'p_brand')} AS key FROM part UNION ALL SELECT {_PLAY_KEY} FROM events)))"""


def _loaded(spark, sf_dir, source: str) -> Workspace:
    music = Workspace(spark, shared_dir(spark))
    music.load(source, _liked_pages(proxies.table(spark, sf_dir, "part")), _play_pages(spark, sf_dir))
    return music


@query(_SONGS + """
  SELECT 'spotify' AS loaded, source, songs FROM n WHERE source = 'spotify'
  UNION ALL SELECT 'lastfm', source, songs FROM n WHERE source = 'lastfm'
  UNION ALL SELECT 'all', source, songs FROM n WHERE source <> 'both'""")
def load_choice(spark, sf_dir):
    """What is stored after loading one source, the other, or both."""
    rows = []
    for source in LOAD_SOURCES:
        music = _loaded(spark, sf_dir, source)
        rows += [(source, name, music.tables.entry(name).n) for name in music.stored_sources()]
    return spark.createDataFrame(rows, "loaded string, source string, songs bigint")


@query(_SONGS + """, choices(loaded, asked, source) AS (VALUES
    ('spotify', 'auto', 'spotify'), ('spotify', 'both', 'both'), ('spotify', 'spotify', 'spotify'), ('spotify', 'lastfm', NULL),
    ('lastfm', 'auto', 'lastfm'), ('lastfm', 'both', 'both'), ('lastfm', 'spotify', NULL), ('lastfm', 'lastfm', 'lastfm'),
    ('all', 'auto', 'both'), ('all', 'both', 'both'), ('all', 'spotify', 'spotify'), ('all', 'lastfm', 'lastfm')),
  unique_liked AS (SELECT count(DISTINCT """ + KEY.format("p_name", "p_brand") + """) AS k FROM part)
  SELECT loaded, asked, source, CASE
    WHEN source = 'both' AND loaded = 'spotify' THEN (SELECT k FROM unique_liked)
    WHEN source = 'both' AND loaded = 'lastfm' THEN (SELECT songs FROM n WHERE n.source = 'lastfm')
    ELSE (SELECT songs FROM n WHERE n.source = choices.source) END AS songs
  FROM choices""")
def library_auto(spark, sf_dir):
    """The library that each choice comes to, by what is stored; none where it is not."""
    rows = []
    for loaded in LOAD_SOURCES:
        music = _loaded(spark, sf_dir, loaded)
        for asked in ("auto", "both", LIKED_SOURCE, PLAYS_SOURCE):
            try:
                rows.append((loaded, asked, music.effective_source(asked), music.library(asked)[0].count()))
            except NothingStored:
                rows.append((loaded, asked, None, None))
    return spark.createDataFrame(rows, "loaded string, asked string, source string, songs bigint")


@query("SELECT item_id AS query_id, 0 AS rank, text AS track_name FROM benchmark WHERE false")
def search_empty_index(spark, sf_dir):
    asked = proxies.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    found = Workspace(spark, shared_dir(spark)).search(asked, 5, ENCODER)
    return found.select("query_id", "rank", "track_name")


@query(sql("records cache found docs", """
  SELECT count(*) AS indexed, count(*) AS cleared, CAST(0 AS BIGINT) AS size, CAST(0 AS BIGINT) AS cleared_again FROM docs"""))
def index_cleared(spark, sf_dir):
    """An index filled, opened by its size, cleared, and cleared once more."""
    music = Workspace(spark, shared_dir(spark))
    music.tables.publish(_index(spark, sf_dir, found_songs(proxies.cache(spark, sf_dir))), "index", ENCODER.model)
    counts = (music.index_size(ENCODER.model), music.clear_index(ENCODER.model), music.index(ENCODER.model).count())
    row = (*counts, music.clear_index(ENCODER.model))
    return spark.createDataFrame([row], "indexed bigint, cleared bigint, size bigint, cleared_again bigint")


@query(sql("records cache", """
  SELECT count(*) AS cached, 'no cached song has lyrics to index' AS reason FROM cache WHERE NOT lyrics_found"""))
def nothing_to_index(spark, sf_dir):
    """A cache of songs without lyrics, and what indexing it says."""
    music = Workspace(spark, shared_dir(spark))
    missing = proxies.cache(spark, sf_dir).where("not lyrics_found").withColumn("seq", F.lit(0).cast("bigint"))
    music.save_lyrics(missing)
    try:
        reason = str(music.build_index(ENCODER))
    except NothingStored as nothing:
        reason = str(nothing)
    return music.cache_stats().select(F.col("total").alias("cached"), F.lit(reason).alias("reason"))
