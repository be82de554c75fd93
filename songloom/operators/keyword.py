"""Keyword search over lyric records.

The score of a record is the number of different query words found in its name, artist,
album and lyrics; ties go to the lower id. Scoring is a column expression on the scan, so
no word of the corpus is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window, functions as F

from songloom.functions.text import words
from songloom.operators.ordering import checked_limit
from songloom.operators.skew import join_unique

DEFAULT_RESULTS = 5
# Up to this many results the records are not shuffled to show them.
BROADCAST_HITS = 200_000


def keyword_search(
    records: DataFrame, queries: Mapping[str, str] | str, limit: int = DEFAULT_RESULTS
) -> DataFrame:
    """The best ``limit`` records per query text; 0 asks for none.

    Columns: ``query_id, rank, score`` and those of the record.
    """
    wanted = {"q": queries} if isinstance(queries, str) else dict(queries)
    count = checked_limit(limit) or 0
    texts = records.sparkSession.createDataFrame(list(wanted.items()), "query_id string, text string")
    asked = texts.select("query_id", F.array_distinct(words(F.col("text"))).alias("asked")).collect()
    every_word = sorted({word for row in asked for word in row.asked})

    text = F.concat_ws(" ", "name", "artist", "album", "plain_lyrics")
    # The words of a record are searched once; each query then looks at the few that hit.
    hits = F.array_intersect(words(text), _strings(every_word))
    if len(asked) == 1:
        # One query: a bounded top-k per task, records included.
        best = records.withColumn("score", F.size(hits)).orderBy(F.desc("score"), "id").limit(count)
        order = Window.orderBy(F.desc("score"), F.asc("id"))
        ranked = best.where("score > 0").withColumn("rank", F.row_number().over(order))
        return ranked.select(
            F.lit(asked[0].query_id).alias("query_id"), "rank", "score", *records.columns
        )
    per_query = F.array(*[
        F.struct(
            F.lit(row.query_id).alias("query_id"),
            F.size(F.array_intersect(F.col("hits"), _strings(row.asked))).alias("score"),
        )
        for row in asked
    ])
    scored = records.select("id", hits.alias("hits")).select(
        "id", F.inline(F.filter(per_query, lambda s: s["score"] > 0))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)
    if len(asked) * count <= BROADCAST_HITS:
        shown = F.broadcast(ranked).join(records, "id")
    else:
        shown = join_unique(ranked, records, ["id"], "inner", spread="query_id")
    return shown.select("query_id", "rank", "score", *records.columns)


def _strings(values: list[str]):
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")
