"""Mixing sources to target weights by entropy balancing.

Each document has a number of copies between 0 and ``MOST``. Before balancing, copies are
binomial with mean 1. The rates that meet the token targets and stay closest to that in
relative entropy are an exponential tilt of it,

    rate = 3 e^u / (2 + e^u),    u = lambda(source) * size,

where lambda(source) minimises the convex dual

    sum over documents of 3 log((2 + e^u) / 3)  -  lambda * target.

Newton's method runs for all sources at once, on counts of documents per source and size:
one combined aggregation per step, kept between brackets so that it can't diverge. The
rates are then rounded to whole copies, so that the words taken per source come within
about one short document of the target, as far as rates of 0 and 3 leave room.

What grows with the corpus (documents) is touched three times: counting words, counting
documents per (source, size), and dealing out copies. All other tables have one row per
source, or one per source and document length.

Defined cases: a null text has no words; a null source is a source of its own, ranked last;
empty sources and documents without words take nothing; repeated rows each count; an empty
table gives an empty result; columns besides the named ones are not looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from songloom.llm.common import as_rows, count_words, stored

MOST = 3
STEPS = 60
TOLERANCE = 1e-6
# A (source, size) class with more documents than this is ranked in parts.
CLASS_ROWS = 50_000


def sizes_of(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, source, size``: the words of every whole text."""
    size = F.coalesce(count_words(F.col(text)), F.lit(0).cast("long"))
    return docs.select(
        F.col(id).alias("doc_id"), F.col(source).alias("source"), size.alias("size")
    )


def targets_of(sources: DataFrame, weights: Sequence[float], most: int = MOST) -> DataFrame:
    """Add ``target`` to rows of ``source, source_size``.

    Sources by code point, null last, weigh ``weights``, repeating. They share all words; a
    target stops at ``most`` times its source, and what is left over is shared again by
    weight. With sources in order of ``cap / weight``, that is one running sum: the first
    ones stop at their cap, the others share the rest. One row per source passes one task.
    """
    w = F.array(*[F.lit(float(x)) for x in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = (
        sources.withColumn("_place", place).withColumn("_w", F.element_at(w, F.col("_place") + 1))
        .withColumn("_cap", F.col("source_size").cast("double") * most)
    )
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = (
        ranked.withColumn("_total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_share", (F.col("_total") - F.col("_capped")) / F.sum("_w").over(after))
        # The level is what the first uncapped source and all after it get per unit of weight.
        .withColumn("_free", F.col("_share") * F.col("_w") <= F.col("_cap"))
        .withColumn("_level", F.min(F.when(F.col("_free"), F.struct("_capped", "_share"))).over(everything))
    )
    level = F.col("_level._share") * F.col("_w")
    target = F.when(F.col("_total") == 0, F.lit(0.0)).otherwise(
        F.least(F.col("_cap"), F.coalesce(level, F.col("_cap")))
    )
    return shared.select("source", "source_size", target.alias("target"))


def _rate(tilt: Column, size: Column, most: int) -> Column:
    # 3 e^u / (2 + e^u), written so that no exponential overflows to a NaN.
    return F.lit(float(most)) / (1 + (most - 1) * F.exp(-tilt * size))


def balance(classes: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """Solve the dual: add ``tilt``, null where a source takes nothing or all it may.

    ``classes``: ``source, size, n``. A step is one aggregation over the classes; the
    driver sees one number, the largest relative gap.
    """
    words = classes.where("size > 0").groupBy("source").agg(F.max("size").alias("_longest"))
    inner = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * F.lit(float(most)) * (1 - 1e-12))
    state = stored(
        sources.alias("s").join(words.alias("w"), F.expr("s.source <=> w.source"), "left")
        .select("s.*", "_longest")
        .withColumn("_open", inner)
        .withColumn("tilt", F.lit(0.0))
        # Any finite target lies between these: u is within +-60 for documents of one word.
        .withColumn("_lo", F.lit(-60.0)).withColumn("_hi", F.lit(60.0))
        .withColumn("_gap", F.when(F.col("_open"), F.lit(1.0)).otherwise(F.lit(0.0)))
    )
    for _ in range(STEPS):
        u_rate = _rate(F.col("tilt"), F.col("size").cast("double"), most)
        sums = (
            classes.where("size > 0").alias("c").join(state.where("_open").alias("s"), F.expr("c.source <=> s.source"))
            .select("s.source", "size", "n", u_rate.alias("_r"))
            .groupBy("source").agg(
                F.sum(F.col("n") * F.col("size") * F.col("_r")).alias("_got"),
                F.sum(F.col("n") * F.col("size") * F.col("size") * F.col("_r") * (1 - F.col("_r") / most)).alias("_slope"),
            )
        )
        joined = state.alias("s").join(sums.alias("g"), F.expr("s.source <=> g.source"), "left").select("s.*", "_got", "_slope")
        above = F.col("_got") > F.col("target")
        lo = F.when(above, F.col("_lo")).otherwise(F.col("tilt"))
        hi = F.when(above, F.col("tilt")).otherwise(F.col("_hi"))
        newton = F.col("tilt") - (F.col("_got") - F.col("target")) / F.col("_slope")
        inside = (F.col("_slope") > 0) & (newton > F.col("_lo2")) & (newton < F.col("_hi2"))
        gap = F.abs(F.col("_got") - F.col("target")) / F.col("target")
        state = stored(
            joined.withColumn("_lo2", F.coalesce(lo, "_lo")).withColumn("_hi2", F.coalesce(hi, "_hi"))
            .withColumn("_gap", F.coalesce(gap, F.lit(0.0)))
            .withColumn("tilt", F.when(~F.col("_open") | (F.col("_gap") <= TOLERANCE), F.col("tilt")).when(inside, newton).otherwise((F.col("_lo2") + F.col("_hi2")) / 2))
            .drop("_lo", "_hi", "_got", "_slope")
            .withColumnRenamed("_lo2", "_lo").withColumnRenamed("_hi2", "_hi")
            .select(*state.columns)
        )
        if (state.agg(F.max("_gap")).first()[0] or 0.0) <= TOLERANCE:
            break
    return state.select("source", "source_size", "target", F.when(F.col("_open"), F.col("tilt")).alias("tilt"))


def _round_source(most: int):
    def rounded(pdf: pd.DataFrame) -> pd.DataFrame:
        # Longest first: what a class leaves over or takes too much goes to shorter ones.
        pdf = pdf.sort_values("size", ascending=False, ignore_index=True)
        owed, out = 0.0, []
        for size, n, rate in zip(pdf["size"], pdf["n"], pdf["rate"]):
            owed += n * size * rate
            low, high = n * int(np.floor(rate)), n * min(most, int(np.ceil(rate)))
            m = int(min(max(round(owed / size), low), high))
            owed -= m * size
            out.append(m)
        # What is still owed is a fraction of a short document, unless short ones had no room.
        for i in range(len(out) - 1, -1, -1):
            size, n = int(pdf["size"][i]), int(pdf["n"][i])
            move = int(np.fix(owed / size))
            m = min(max(out[i] + move, 0), n * most)
            owed -= (m - out[i]) * size
            out[i] = m
        return pdf.assign(copies=np.array(out, dtype="int64"))[["source", "size", "n", "copies"]]

    return rounded


def copies_per_class(classes: DataFrame, tilts: DataFrame, most: int = MOST) -> DataFrame:
    """``source, size, n, copies``: whole copies that all documents of a class get together.

    A group here is one source with one row per document length, however many documents
    it has.
    """
    full = F.col("target") >= F.col("source_size") * F.lit(float(most)) * (1 - 1e-12)
    rate = F.coalesce(
        _rate(F.col("tilt"), F.col("size").cast("double"), most),
        F.when(full & (F.col("target") > 0), F.lit(float(most))).otherwise(F.lit(0.0)),
    )
    rated = (
        classes.where("size > 0").alias("c").join(tilts.alias("t"), F.expr("c.source <=> t.source"))
        .select("c.source", "size", "n", rate.alias("rate"))
    )
    return rated.groupBy("source").applyInPandas(_round_source(most), "source string, size long, n long, copies long")


def mix(sizes: DataFrame, weights: Sequence[float], most: int = MOST) -> DataFrame:
    """Add ``source_size, target, copies`` to rows of ``doc_id, source, size``.

    The documents of a class get ``floor(copies / n)`` each, and those first by hash one
    more. A class is dealt out in parts of about ``CLASS_ROWS``, so no task ranks more.
    Equal rows may swap places, which changes no result.
    """
    sizes = stored(sizes)
    classes = stored(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    sources = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    tilts = balance(classes, stored(targets_of(sources, weights, most)), most)
    planned = stored(copies_per_class(classes, tilts, most))
    tilts = tilts.select("source", "source_size", "target")

    same = F.expr("d.source <=> p.source and d.size = p.size")
    parts = F.ceil(F.col("n") / CLASS_ROWS)
    dealt = (
        sizes.alias("d").join(planned.alias("p"), same, "left")
        .select("d.*", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("copies", F.lit(0)).alias("_all"))
        .withColumn("_hash", F.xxhash64("doc_id"))
        .withColumn("_base", F.expr("_all div n")).withColumn("_more", F.col("_all") % F.col("n"))
        .withColumn("_part", F.pmod(F.xxhash64("_hash"), parts))
    )
    # Classes in one part, the usual case, need no counts; others get theirs part by part.
    some = F.col("_more") > 0
    ranks = Window.partitionBy("source", "size", "_part").orderBy("_hash", "doc_id")
    large = dealt.where(some & (F.col("n") > CLASS_ROWS)).groupBy("source", "size", "_part").agg(
        F.count(F.lit(1)).alias("_rows"), F.max("_more").alias("_m"), F.max("n").alias("_n")
    )
    run = Window.partitionBy("source", "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    until = F.sum("_rows").over(run)
    upto = lambda rows: F.floor(rows.cast("decimal(20,0)") * F.col("_m") / F.col("_n")).cast("long")
    large = large.select("source", "size", "_part", (upto(until) - upto(until - F.col("_rows"))).alias("_quota"))
    picked = (
        dealt.where(some).withColumn("_rank", F.row_number().over(ranks)).alias("d")
        .join(large.alias("q"), F.expr("d.source <=> q.source and d.size = q.size and d._part = q._part"), "left")
        .select("d.*", F.when(F.col("_rank") <= F.coalesce("_quota", "_more"), F.lit(1)).otherwise(F.lit(0)).alias("_plus"))
        .drop("_rank")
    )
    given = dealt.where(~some).withColumn("_plus", F.lit(0)).unionByName(picked)
    return (
        given.alias("g").join(tilts.alias("t"), F.expr("g.source <=> t.source"), "left")
        .select("g.doc_id", "g.source", "g.size", "t.source_size", "t.target", (F.col("_base") + F.col("_plus")).cast("int").alias("copies"))
    )


def mixed(docs: DataFrame, weights: Sequence[float], most: int = MOST) -> DataFrame:
    """The documents of a mix: each row as often as it is taken, with all its columns.

    Copies are found per (id, source, size) and rows of equal ones share them evenly, so
    repeated ids need no number of their own.
    """
    taken = mix(sizes_of(docs), weights, most).groupBy("doc_id", "source", "size").agg(
        F.sum("copies").alias("sum"), F.count(F.lit(1)).alias("n")
    )
    size = F.coalesce(count_words(F.col("row.text")), F.lit(0).cast("long"))
    same = F.expr("d.row.doc_id <=> t.doc_id and d.row.source <=> t.source and d.size = t.size")
    joined = as_rows(docs).withColumn("size", size).alias("d").join(stored(taken).alias("t"), same).select("d.*", "sum", "n")
    single = joined.where("n = 1").select("row", F.col("sum").alias("times"))
    order = Window.partitionBy("row.doc_id", "row.source", "size").orderBy(F.xxhash64("row"))
    shared = joined.where("n > 1").withColumn("place", F.row_number().over(order)).select(
        "row", (F.expr("sum div n") + F.when(F.col("place") <= F.col("sum") % F.col("n"), 1).otherwise(0)).alias("times")
    )
    both = single.unionByName(shared).where("times > 0")
    return both.select("row", F.expr("explode(sequence(1L, times))")).select("row.*")
