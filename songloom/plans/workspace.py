"""The whole library in one folder: load, enrich, index, search, status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from songloom import schemas
from songloom.functions.text import song_key
from songloom.operators.documents import embeddable, found_songs
from songloom.operators.encoders import DEFAULT_MODEL, Encoder, encoder_for
from songloom.operators.enrich import (
    Enrichment,
    enrich,
    fetch_lyrics,
    run_summary,
)
from songloom.operators.keyword import keyword_search
from songloom.operators.library import (
    LIKED_SOURCE,
    PLAYS_SOURCE,
    both_sources,
    unique_plays,
    with_key,
    with_more_plays,
)
from songloom.operators.listings import list_liked, list_plays
from songloom.operators.lookup import best_record
from songloom.operators.ordering import first_n, last_per_key
from songloom.operators.stats import CACHE_COUNTS, index_run_stats, store_info, status_report
from songloom.operators.upsert import upsert
from songloom.plans import index as indexing
from songloom.sources.buckets import BucketedTable
from songloom.sources.landed import (
    normalize_liked,
    normalize_lyrics,
    normalize_plays,
    rejected_liked,
    rejected_plays,
)
from songloom.sources.tables import TableStore

# What a load or a library can be asked for.
LOAD_SOURCES = (LIKED_SOURCE, PLAYS_SOURCE, "all")

RAW_PLAYS, LYRICS, CACHE, INDEX = "raw_plays", "lyrics", "lyrics_cache", "index"
REJECTED = "rejected_pages"


class NothingStored(LookupError):
    """The step needs a table that was never filled."""


class Workspace:
    """Tables of one library below ``root``, a folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.tables = TableStore(spark, root)
        self._cache = BucketedTable(self.tables, CACHE, schemas.CACHE, CACHE_COUNTS)

    # load ---------------------------------------------------------------------------

    def load(
        self, source: str, liked_pages: DataFrame | None = None, play_pages: DataFrame | None = None
    ) -> dict[str, Row]:
        """Store landed pages. Plays are kept raw and as unique songs.

        Pages that can't be read are stored with the reason, see ``rejected_pages``.
        """
        if source not in LOAD_SOURCES:
            raise ValueError(f"can load {', '.join(LOAD_SOURCES)}, not {source}")
        stored = {}
        if source in (LIKED_SOURCE, "all"):
            pages = _given(liked_pages, LIKED_SOURCE)
            stored[LIKED_SOURCE] = self.save_liked(normalize_liked(pages))
            self.tables.publish(rejected_liked(pages), REJECTED, LIKED_SOURCE)
        if source in (PLAYS_SOURCE, "all"):
            pages = _given(play_pages, PLAYS_SOURCE)
            stored[RAW_PLAYS] = self.tables.publish(normalize_plays(pages), RAW_PLAYS)
            self.tables.publish(rejected_plays(pages), REJECTED, PLAYS_SOURCE)
            stored[PLAYS_SOURCE] = self.save_plays(self.raw_plays())
        return stored

    def save_liked(self, liked: DataFrame) -> Row:
        return self.tables.publish(liked, LIKED_SOURCE)

    def save_plays(self, plays: DataFrame) -> Row:
        """Store the unique songs of a play history."""
        columns = self.raw_plays().columns
        return self.tables.publish(unique_plays(plays).select(*columns), PLAYS_SOURCE)

    def add_plays(self, pages: DataFrame) -> Row:
        """Store more landed plays beside those there are; only these and the known songs are read.

        Their page numbers must go on from those before.
        """
        plays = normalize_plays(pages)
        known = self.tables.read(PLAYS_SOURCE, schemas.PLAYS)
        self.tables.publish(rejected_plays(pages), REJECTED, PLAYS_SOURCE, append=True)
        self.tables.publish(plays, RAW_PLAYS, append=True)
        return self.tables.publish(with_more_plays(known, plays), PLAYS_SOURCE)

    def play_counts(self) -> tuple[int, int]:
        """Plays and the different songs among them, from the manifest."""
        entries = [self.tables.entry(name) for name in (RAW_PLAYS, PLAYS_SOURCE)]
        return tuple(0 if e is None else e.n for e in entries)

    def load_lyrics(self, records: DataFrame) -> Row:
        """Store landed lyric records, one row per record id.

        A record without an id gets one from its content, above all ids of the service.
        """
        lyrics = normalize_lyrics(records)
        columns = [c for c in lyrics.columns if c != "id"]
        own = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(*columns), 2)
        known = lyrics.withColumn("id", F.coalesce("id", own))
        return self.store_lyrics(last_per_key(known, ("id",), columns))

    def store_lyrics(self, lyrics: DataFrame) -> Row:
        """Store records in order of their song key, so that a lookup reads the files around its key."""
        keyed = lyrics.withColumn("key", song_key(F.col("name"), F.col("artist")))
        return self.tables.publish(keyed.repartitionByRange("key", "id").sortWithinPartitions("key", "id"), LYRICS)

    def rejected_pages(self) -> DataFrame:
        """Pages of the last load of each source that could not be read."""
        return self.tables.read_parts(REJECTED, schemas.REJECTED)

    def vacuum(self) -> int:
        """Delete what failed writes and replaced snapshots left behind."""
        return self.tables.vacuum()

    # library ------------------------------------------------------------------------

    def raw_plays(self) -> DataFrame:
        return self.tables.read(RAW_PLAYS, schemas.PLAYS)

    def stored_sources(self) -> list[str]:
        return [s for s in (LIKED_SOURCE, PLAYS_SOURCE) if self.tables.entry(s) is not None]

    def effective_source(self, source: str = "auto") -> str:
        """What a library source comes to, given what is stored."""
        if source not in ("auto", "both", LIKED_SOURCE, PLAYS_SOURCE):
            raise ValueError(f"no such library: {source}")
        stored = self.stored_sources()
        if not stored or (source in (LIKED_SOURCE, PLAYS_SOURCE) and source not in stored):
            raise NothingStored(f"no songs stored for {source}")
        if source == "auto":
            return "both" if len(stored) == 2 else stored[0]
        return source

    def library(self, source: str = "auto") -> tuple[DataFrame, str]:
        """Songs and the source whose field mapping they follow.

        Liked songs alone come as stored; both sources together come unique.
        """
        source = self.effective_source(source)
        liked = self.tables.read(LIKED_SOURCE, schemas.LIKED)
        plays = self.tables.read(PLAYS_SOURCE, schemas.PLAYS)
        if source == "both":
            return both_sources(liked, plays), LIKED_SOURCE
        return with_key(liked if source == LIKED_SOURCE else plays, source), source

    def liked_songs(self, limit: int | None = None) -> DataFrame:
        """The numbered list of liked songs."""
        return list_liked(first_n(self.tables.read(LIKED_SOURCE, schemas.LIKED), limit))

    def scrobbles(self, limit: int | None = None) -> DataFrame:
        """The numbered list of plays, the latest first as the service sends them."""
        return list_plays(first_n(self.raw_plays(), limit))

    # lyrics -------------------------------------------------------------------------

    def lyrics(self) -> DataFrame:
        return self.tables.read(LYRICS, schemas.KEYED_LYRICS).drop("key")

    def cache(self) -> DataFrame:
        return self._cache.read()

    def _key(self, track: str, artist: str) -> str:
        return self.spark.range(1).select(song_key(F.lit(track), F.lit(artist))).first()[0]

    def cached_lyrics(self, track: str, artist: str) -> Row | None:
        """The cache entry of one song, from the bucket of its key."""
        return self._cache.read_key(self._key(track, artist)).first()

    def get_lyrics(
        self, track: str, artist: str, album: str = "", duration: int | None = None
    ) -> Row | None:
        """The best lyric record for one song, None if there is none."""
        return self.lyrics_for(track, artist, album, duration).first()

    def lyrics_for(
        self, track: str, artist: str, album: str = "", duration: int | None = None
    ) -> DataFrame:
        """The best lyric record for one song, as a table of one row or none.

        Only files whose range of keys has the song's are read.
        """
        asked = self.spark.createDataFrame(
            [(track, artist, album, duration)],
            "track string, artist string, lookup_album string, lookup_seconds bigint",
        )
        key = song_key(F.col("track"), F.col("artist")).alias("key")
        lookup = asked.select(key, "lookup_album", "lookup_seconds")
        records = self.tables.read(LYRICS, schemas.KEYED_LYRICS)
        records = records.where(F.col("key") == self._key(track, artist)).drop("key")
        return best_record(lookup, records, hot_rows=None)

    def fetch_lyrics(self, source: str = "auto") -> DataFrame:
        """Lyrics for the library, past the cache."""
        songs, mapping = self.library(source)
        return fetch_lyrics(songs, self.lyrics(), mapping)

    def save_lyrics(self, saved: DataFrame) -> int:
        """Put entries into the cache, in the order of ``seq``; the last of a key stays.

        Returns how many of the cache's buckets were written.
        """
        keyed = saved.withColumn("key", song_key(F.col("track_name"), F.col("artist_name")))
        return self._cache.save(last_per_key(keyed))

    def enrich(
        self,
        source: str = "auto",
        limit: int | None = None,
        new: int | None = None,
        force: bool = False,
    ) -> Enrichment:
        """Add lyrics to the library and keep the results in the cache."""
        songs, mapping = self.library(source)
        unique = self.effective_source(source) != LIKED_SOURCE
        cache = self.cache()
        run = enrich(
            songs, cache, self.lyrics(), mapping, limit, new, force, unique, keep=self._keep
        )
        # Without force, the lookups were of keys that the cache did not have.
        self._cache.save(run.delta, new_keys=not force)
        return run

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        """Store an intermediate result of a run, so that it is computed once."""
        stored = self.tables.publish(df, f"run_{name}")
        return self.spark.read.schema(df.schema).parquet(*stored.paths)

    def clear_cache(self) -> int:
        return self._cache.clear()

    def search_lyrics(self, query: str, limit: int = 5) -> DataFrame:
        return keyword_search(self.lyrics(), query, limit)

    # index --------------------------------------------------------------------------

    def index(self, model: str = DEFAULT_MODEL) -> DataFrame:
        return self.tables.read(INDEX, schemas.INDEX, model)

    def build_index(
        self, encoder: Encoder | str = DEFAULT_MODEL, with_album: bool = False
    ) -> dict[str, int]:
        """Index all found songs of the cache; returns the counts of the run."""
        encoder = encoder_for(encoder) if isinstance(encoder, str) else encoder
        cache = self.cache()
        songs = found_songs(cache)
        if songs.isEmpty():
            raise NothingStored("no cached song has lyrics to index")
        if with_album:
            songs = indexing.with_album(songs, self.library()[0])
        index = self.index(encoder.model)
        rows = self._keep(indexing.changed_rows(index, songs, encoder), "index")
        if index.join(rows, "id", "left_semi").isEmpty():
            self.tables.attach(self.tables.entry("run_index"), INDEX, encoder.model)
        else:
            self.tables.publish(upsert(index, rows, ["model", "id"]), INDEX, encoder.model)
        stats = index_run_stats(songs, embeddable(songs), self.index(encoder.model), encoder.model)
        return stats.first().asDict()

    def clear_index(self, model: str = DEFAULT_MODEL) -> int:
        return self.tables.clear(INDEX, schemas.INDEX, model)

    def index_size(self, model: str = DEFAULT_MODEL) -> int:
        """Size of an index from its manifest; neither vectors nor a model are loaded."""
        entry = self.tables.entry(INDEX, model)
        return 0 if entry is None else entry.n

    def search(
        self,
        texts: str | Sequence[str] | DataFrame,
        k: int = indexing.DEFAULT_RESULTS,
        encoder: Encoder | str = DEFAULT_MODEL,
    ) -> DataFrame:
        """Songs that fit a text best; empty if nothing is indexed."""
        encoder = encoder_for(encoder) if isinstance(encoder, str) else encoder
        texts = [texts] if isinstance(texts, str) else texts
        return indexing.search(self.index(encoder.model), texts, encoder, k)

    # reports ------------------------------------------------------------------------

    def store_info(self) -> DataFrame:
        return store_info(self.tables.current(), (LIKED_SOURCE, PLAYS_SOURCE))

    def cache_stats(self) -> DataFrame:
        """Counts of the cache, from those of its folders."""
        return self._cache.totals()

    def status(self) -> DataFrame:
        """Stored lists, cache and index in one report."""
        current = self.tables.current()
        sizes = current.where(F.col("name") == INDEX).select(
            F.col("part").alias("model"), F.col("n").alias("collection_size")
        )
        return status_report(self.store_info(), self.cache_stats(), sizes)

    def summary(self, run: Enrichment) -> DataFrame:
        return run_summary(run.songs)


def _given(pages: DataFrame | None, source: str) -> DataFrame:
    if pages is None:
        raise ValueError(f"no pages given for {source}")
    return pages
