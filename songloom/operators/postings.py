"""Keyword search for a table of queries, over stored postings.

Records are cut into parts of about ``PART_RECORDS`` by a hash of their id. Per part and word
there is one row with the ascending ids of the records that have the word, so a word that all
records have is as many rows as there are parts. Rows lie in folders by a hash of the word: a
few words read a few folders.

To search, the distinct words of the queries are joined to the postings, which leaves those
that are asked for. A part's postings then meet one block of queries in a task: a query's lists
are counted together in numpy and only its best ``limit`` records leave the task, so counts are
never shuffled; what is left is cut to ``limit`` per query again. Every list is moved once per
block of queries, and every query once per part.

Defined cases: a query without words, or of words that no record has, has no rows; null texts
are empty; a null query id is no query; ties go to the lower id; repeated query ids are one query of all their words; rows
that repeat a record id are one record of all their words; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from songloom.functions.text import words
from songloom.operators.keyword import BROADCAST_HITS
from songloom.operators.ordering import checked_limit
from songloom.operators.scratch import kept
from songloom.operators.skew import join_unique
from songloom.session import shared_dir

PART_RECORDS = 16_384
BUCKETS = 64
# Words of queries in one block; with their ids and numbers some 100 bytes each.
BLOCK_WORDS = 200_000
# Up to this many different words are broadcast to the postings.
BROADCAST_WORDS = 300_000


POSTINGS = "word string, part int, ids array<bigint>, bucket int"


def record_text() -> Column:
    """The text of a lyric record that words are searched in."""
    return F.concat_ws(" ", "name", "artist", "album", "plain_lyrics")


def _bucket(word: str = "word") -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def postings_of(records: DataFrame, part_records: int = PART_RECORDS, text: Column | None = None) -> DataFrame:
    """``word, part, ids, bucket`` of records (with a numeric ``id``), to be stored by ``bucket``.

    A bucket comes from one task and is in order of words, so that readers skip what they
    don't ask for.
    """
    parts = max(1, -(-records.count() // part_records))
    each = records.select(
        "id", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"),
        F.explode(F.array_distinct(words(record_text() if text is None else text))).alias("word"),
    )
    lists = each.groupBy("word", "part").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    return lists.withColumn("bucket", _bucket()).repartition("bucket").sortWithinPartitions("bucket", "word", "part")


def stored_postings(records: DataFrame, part_records: int = PART_RECORDS, text: Column | None = None) -> DataFrame:
    """Postings in a scratch folder of their own."""
    path = shared_dir(records.sparkSession)
    postings_of(records, part_records, text).write.partitionBy("bucket").parquet(path)
    return records.sparkSession.read.schema(POSTINGS).parquet(path)


def query_words(queries: DataFrame) -> DataFrame:
    """``query_id, word``: the different words of ``query_id, text``, stored."""
    named = queries.where("query_id is not null")
    return kept(named.select("query_id", F.explode(F.array_distinct(words(F.col("text")))).alias("word")).distinct())


def _count(limit: int):
    def best(key: tuple, lists: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        """The best records of one part for each query of one block."""
        ids = np.unique(np.concatenate([*lists["ids"].to_numpy(), np.zeros(0, np.int64)]))
        places = {word: np.searchsorted(ids, held) for word, held in zip(lists["word"], lists["ids"])}
        out = []
        for query_id, words_ in asked.groupby("query_id", sort=False)["word"]:
            hits = [places[w] for w in words_ if w in places]
            if not hits:
                continue
            score = np.bincount(np.concatenate(hits), minlength=len(ids))
            at = np.flatnonzero(score)
            if len(at) > limit:
                # All that tie with the last stay, then ids decide.
                at = at[score[at] >= np.partition(score[at], -limit)[-limit]]
            at = at[np.lexsort((ids[at], -score[at]))][:limit]
            out.append(pd.DataFrame({"query_id": query_id, "id": ids[at], "score": score[at]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []})

    return best


def word_hits(postings: DataFrame, queries: DataFrame, limit: int, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``query_id, rank, score, id``: the best ``limit`` records per query; ``queries`` has ``query_id, text``."""
    count = checked_limit(limit) or 0
    asked = query_words(queries)
    total = asked.count()
    blocks = max(1, -(-total // block_words))
    different = asked.select("word").distinct().withColumn("bucket", _bucket())
    if total <= BROADCAST_WORDS:
        different = F.broadcast(different)
    # Folders that no word falls into are not read.
    touched = [row.bucket for row in different.select("bucket").distinct().collect()]
    held = postings.where(F.col("bucket").isin(touched)).join(different, ["bucket", "word"], "left_semi").select("part", "word", "ids")
    held = kept(held.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    # Each query goes to every part.
    last = held.agg(F.max("part")).first()[0] or 0
    part = F.explode(F.sequence(F.lit(0), F.lit(last))).alias("part")
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
    meets = asked.select("query_id", "word", block, part)
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id bigint, score int"
    scored = held.groupBy("part", "block").cogroup(meets.groupBy("part", "block")).applyInPandas(_count(count), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)
    return ranked.select("query_id", "rank", "score", "id")


def search_records(records: DataFrame, postings: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """The best records per query, with their columns."""
    hits = kept(word_hits(postings, queries, limit))
    if hits.count() <= BROADCAST_HITS:
        shown = F.broadcast(hits).join(records, "id")
    else:
        shown = join_unique(hits, records, ["id"], "inner", spread="query_id")
    return shown.select("query_id", "rank", "score", *records.columns)
