import random
import re

import pytest

from songloom import schemas
from songloom.operators import postings
from songloom.operators.keyword import keyword_search


def record(id, text, name="n", artist="a", album=None):
    return (id, name, artist, album, None, False, text, None)


def plain(records, queries, limit):
    held = {}
    for id, name, artist, album, _, _, text, _ in records:
        joined = " ".join(x for x in (name, artist, album, text) if x is not None)
        held.setdefault(id, set()).update(w for w in re.split(r"[^\w]+|_", joined.lower()) if w)
    asked = {}
    for q, text in queries:
        if q is not None:
            asked.setdefault(q, set()).update(w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w)
    out = []
    for q, words in asked.items():
        scored = sorted((-len(words & own), i) for i, own in held.items() if words & own)[:limit]
        out += [(q, rank, -score, i) for rank, (score, i) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("part_records,block_words,broadcast", [(7, 20, 300_000), (1000, 10_000, 0)])
def test_hits_against_brute_force(spark, monkeypatch, part_records, block_words, broadcast):
    """A word that all records have, many ties, repeated ids, odd queries; several parts and blocks, and one."""
    monkeypatch.setattr(postings, "BROADCAST_WORDS", broadcast)
    rng = random.Random(part_records)
    words = [f"w{i}" for i in range(30)]
    records = [record(i, "the " + " ".join(rng.choices(words, k=rng.randrange(6)))) for i in range(150)]
    records += [record(3, "twice"), record(3, "the w1"), record(900, None, name="w2"), record(901, "ÉTÉ Zoë", album="w3 w3")]
    queries = [(i, " ".join(rng.choices([*words, "the", "none"], k=rng.randrange(5)))) for i in range(40)]
    queries += [(100, None), (101, ""), (102, "été, zoë!"), (103, "the"), (103, "w1"), (None, "the")]
    df = spark.createDataFrame(records, schemas.LYRICS).repartition(3)
    asked = spark.createDataFrame(queries, "query_id bigint, text string").repartition(2)
    held = postings.stored_postings(df, part_records)
    for limit in (1, 4):
        found = postings.word_hits(held, asked, limit, block_words)
        assert sorted(map(tuple, found.collect())) == plain(records, queries, limit)
    assert held.groupBy("word", "part").count().where("count > 1").count() == 0


def test_shown_records_and_few_queries(spark, monkeypatch):
    records = spark.createDataFrame([record(i, f"red {i}", name=f"n{i % 3}") for i in range(20)], schemas.LYRICS)
    asked = spark.createDataFrame([("x", "red n1"), ("y", "7")], "query_id string, text string")
    held = postings.stored_postings(records, 6)
    want = sorted(map(tuple, keyword_search(records, {"x": "red n1", "y": "7"}, 5).collect()))
    for most in (postings.BROADCAST_HITS, 0):
        monkeypatch.setattr(postings, "BROADCAST_HITS", most)
        assert sorted(map(tuple, postings.search_records(records, held, asked, 5).collect())) == want


def test_only_folders_of_asked_words_are_read(spark, monkeypatch):
    records = spark.createDataFrame([record(i, f"word{i} other{i}") for i in range(200)], schemas.LYRICS)
    held = postings.stored_postings(records)
    assert held.select("bucket").distinct().count() > 50
    asked = spark.createDataFrame([(1, "word7")], "query_id bigint, text string")
    # Broadcasting the words or not, the plan names their folders.
    read = []
    monkeypatch.setattr(postings, "kept", lambda df: read.append(df) or df)
    assert postings.word_hits(held, asked, 3).collect()[0].id == 7
    plan = read[1]._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ (IN|=)", plan)


def test_empty_tables(spark):
    records = spark.createDataFrame([], schemas.LYRICS)
    asked = spark.createDataFrame([(1, "red")], "query_id bigint, text string")
    assert postings.word_hits(postings.stored_postings(records), asked, 3).collect() == []
    some = spark.createDataFrame([record(1, "red")], schemas.LYRICS)
    assert postings.word_hits(postings.stored_postings(some), asked.limit(0), 3).collect() == []
    assert postings.word_hits(postings.stored_postings(some), asked, 0).collect() == []
    with pytest.raises(ValueError):
        postings.word_hits(postings.stored_postings(some), asked, -1)
