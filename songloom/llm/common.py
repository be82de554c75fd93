"""What several of the operators share: words, stored intermediates, checked broadcasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from songloom.session import shared_dir

#: The characters that separate words, and the pattern of a word.
SPACES = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"

#: A side of a join is broadcast up to this many rows (of a few numbers each), after a count.
BROADCAST_ROWS = 300_000


def text_of(column: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array; no words give an empty array."""
    trimmed = F.btrim(text, F.lit(SPACES))
    parts = F.split(trimmed, r"[\x20\x09-\x0D]+")
    return F.when(F.length(trimmed) > 0, parts).otherwise(F.array().cast("array<string>"))


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared scratch folder and read it back.

    What follows is then computed from files that survive a lost executor, and the plan
    starts anew.
    """
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A stored table, marked for a broadcast only if it is counted to be small."""
    return F.broadcast(df) if df.count() <= rows else df


def as_rows(docs: DataFrame) -> DataFrame:
    """Each row as one struct ``row``, so that no column can clash with those added beside it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def keep_marked(docs: DataFrame, verdicts: DataFrame, key: Column, id: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` that stay, by ``verdicts`` of ``doc_id, key, kept`` per row.

    ``key`` tells texts apart, as a column of ``row``. Only verdicts that change something
    meet the documents. Of rows equal in id and key one stays, the first by a hash of all
    columns.
    """
    per_text = verdicts.groupBy("doc_id", "key").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    changed = sized(stored(per_text.where("not kept or n > 1").select("doc_id", "key", "kept")))
    same = F.col(f"d.row.`{id}`").eqNullSafe(F.col("x.doc_id")) & (F.col("d.key") == F.col("x.key"))
    marked = as_rows(docs).withColumn("key", key).alias("d").join(changed.alias("x"), same, "left").select("d.*", "x.kept")
    single = marked.where("kept is null").select("row.*")
    if changed.where("kept").isEmpty():
        return single
    order = Window.partitionBy(F.col(f"row.`{id}`"), "key").orderBy(F.xxhash64("row"))
    first = marked.where("kept").withColumn("place", F.row_number().over(order)).where("place = 1")
    return single.unionByName(first.select("row.*"))
