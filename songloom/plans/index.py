"""From cached lyrics to an index, and from a query text to results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from songloom.functions.text import document_preview
from songloom.functions.vectors import match_percent
from songloom.operators.documents import documents, found_songs
from songloom.operators.encoders import Encoder, encode
from songloom.operators.ordering import checked_limit
from songloom.operators.scratch import kept
from songloom.operators.similarity import query_sizes, top_k
from songloom.operators.skew import join_unique
from songloom.operators.upsert import upsert

INDEX_COLUMNS = (
    "id", "model", "document", "embedding", "norm",
    "track_name", "artist_name", "album", "instrumental", "has_lyrics", "digest",
)
# What the digest of an index row is made of.
SHOWN = ("track_name", "artist_name", "album", "instrumental", "document")
# Up to this many changed ids the songs stay where they are.
BROADCAST_CHANGED = 200_000
DEFAULT_RESULTS = 5
# Up to this many found ids the documents are not shuffled to show them.
BROADCAST_HITS = 200_000


def offered(songs: DataFrame) -> DataFrame:
    """Documents of songs with the digest of what the index shows of them."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in SHOWN]
    return documents(songs).withColumn("digest", F.sha2(F.to_json(F.array(*shown)), 256))


def index_rows(songs: DataFrame, encoder: Encoder) -> DataFrame:
    """Songs -> index rows; songs with nothing to encode are left out."""
    return encode(offered(songs), encoder).select(*INDEX_COLUMNS)


def changed_rows(index: DataFrame, songs: DataFrame, encoder: Encoder) -> DataFrame:
    """Index rows of the songs that are new or read differently now.

    Encoding the same document again would give the same row, so it is not done. Only ids and
    digests meet, those of the index as stored with its rows; documents follow for the ids that
    changed.
    """
    known = index.where(F.col("model") == encoder.model).select("id", "digest")
    new = offered(songs)
    changed = kept(new.select("id", "digest").join(known, ["id", "digest"], "left_anti").select("id"))
    if changed.count() <= BROADCAST_CHANGED:
        changed = F.broadcast(changed)
    return encode(new.join(changed, "id", "left_semi"), encoder).select(*INDEX_COLUMNS)


def build_index(index: DataFrame, cache: DataFrame, encoder: Encoder) -> DataFrame:
    """The index after indexing all found songs of the cache."""
    return upsert(index, changed_rows(index, found_songs(cache), encoder), ["model", "id"])


def with_album(cache: DataFrame, library: DataFrame) -> DataFrame:
    """Cache entries with the album of the first such song of the library.

    The cache itself keeps no album.
    """
    firsts = library.groupBy("key").agg(F.min_by("album", "seq").alias("album"))
    return cache.join(firsts, "key", "left")


def query_vectors(queries: DataFrame, encoder: Encoder) -> DataFrame:
    """``query_id, text`` -> vectors to search with."""
    return encode(queries, encoder, "text").select("query_id", "model", "embedding", "norm")


def search(
    index: DataFrame,
    texts: Sequence[str] | DataFrame,
    encoder: Encoder,
    k: int = DEFAULT_RESULTS,
) -> DataFrame:
    """The best ``k`` songs per query text, ranked and ready to show.

    ``texts`` is a list of texts, numbered from 0, or a table ``query_id, text``.
    """
    count = checked_limit(k) or 0
    if not isinstance(texts, DataFrame):
        texts = index.sparkSession.createDataFrame(
            list(enumerate(texts)), "query_id bigint, text string"
        )
    queries = kept(query_vectors(texts, encoder))
    sizes = query_sizes(queries)
    hits = top_k(queries, index, count, sizes=sizes)
    return results(hits, index, encoder.model, count * sum(row.n for row in sizes))


def results(hits: DataFrame, index: DataFrame, model: str, most: int) -> DataFrame:
    """Join documents and names to the ids that were found, ``most`` of them at most."""
    shown = index.where(F.col("model") == model).select(
        "id", "document", "track_name", "artist_name", "album"
    )
    # The found ids are broadcast while they are few; a song that many queries find is spread.
    if most <= BROADCAST_HITS:
        joined = F.broadcast(hits).join(shown, "id")
    else:
        joined = join_unique(hits, shown, ["id"], "inner", spread="query_id")
    return joined.select(
        "query_id", "rank", "track_name", "artist_name", "album",
        (1 - F.col("score")).alias("distance"),
        "score",
        match_percent(F.col("score")).alias("match_percent"),
        document_preview(F.col("document")).alias("document_preview"),
    )
