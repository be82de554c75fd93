import pytest

from songloom import Workspace, schemas
from songloom.operators import stats
from songloom.sources import buckets
from songloom.sources.buckets import BucketedTable, bucket_of
from songloom.sources.tables import TableStore


def entries(spark, *rows):
    data = [(f"{k}||x", k, "x", text, None, False, text is not None) for k, text in rows]
    return spark.createDataFrame(data, schemas.CACHE)


@pytest.fixture
def table(spark, tmp_path):
    return BucketedTable(TableStore(spark, str(tmp_path / "t")), "cache", schemas.CACHE, stats.CACHE_COUNTS)


def held(table):
    return {r.key: r.plain_lyrics for r in table.read().collect()}


def test_a_save_writes_the_buckets_it_touches(spark, table, monkeypatch):
    assert held(table) == {} and table.totals().first().total == 0
    many = [(f"s{i}", f"text {i}") for i in range(300)]
    # Small tasks: a bucket may be several files.
    monkeypatch.setattr(buckets, "TASK_ROWS", 2)
    written = table.save(entries(spark, *many))
    assert written == len({bucket_of(f"{k}||x") for k, _ in many})
    before = {r.part: r.snapshot for r in table.tables.entries("cache")}

    assert table.save(entries(spark, ("s7", "new"))) == 1
    after = {r.part: r.snapshot for r in table.tables.entries("cache")}
    assert [p for p in after if after[p] != before[p]] == [f"{bucket_of('s7||x'):03d}"]
    assert held(table) == {f"{k}||x": t for k, t in many} | {"s7||x": "new"}

    table.save(entries(spark, ("added", None), ("s9000", "y")), new_keys=True)
    assert len(held(table)) == 302
    assert tuple(table.totals().first()) == tuple(stats.cache_stats(table.read()).first()) == (302, 301, 0, 1)
    assert table.save(entries(spark)) == 0
    gone = table.tables.vacuum()
    assert gone == 0 and len(held(table)) == 302
    assert table.clear() == 302 and held(table) == {} and table.totals().first().total == 0
    assert table.clear() == 0
    assert table.tables.vacuum() == 3
    table.save(entries(spark, ("s7", "again")))
    assert held(table) == {"s7||x": "again"}


def test_a_lookup_reads_one_bucket(spark, table):
    table.save(entries(spark, *[(f"s{i}", "t") for i in range(200)]))
    found = table.read_key("s3||x")
    assert found.first().track_name == "s3" and table.read_key("none||x").first() is None
    assert {f.rpartition("/")[0].rpartition("=")[2] for f in found.inputFiles()} == {str(bucket_of("s3||x"))}
    assert "EqualTo(key,s3||x)" in found._jdf.queryExecution().executedPlan().toString()


def test_records_lie_in_order_of_their_key(spark, tmp_path):
    music = Workspace(spark, str(tmp_path / "music"))
    rows = [(i, f"Song {i:04d}", "A", "", 1.0, False, f"text {i}", None) for i in range(2000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        music.store_lyrics(spark.createDataFrame(rows, schemas.LYRICS))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    per_file = (
        music.tables.read("lyrics", schemas.KEYED_LYRICS).selectExpr("input_file_name() as f", "key")
        .groupBy("f").agg({"key": "min"}).collect()
    )
    ends = (
        music.tables.read("lyrics", schemas.KEYED_LYRICS).selectExpr("input_file_name() as f", "key")
        .groupBy("f").agg({"key": "max"}).collect()
    )
    ranges = sorted((a[1], dict((r[0], r[1]) for r in ends)[a[0]]) for a in per_file)
    assert len(ranges) > 1 and all(x[1] < y[0] for x, y in zip(ranges, ranges[1:]))
    found = music.lyrics_for("song 0123", "a")
    assert "EqualTo(key,song 0123||a)" in found._jdf.queryExecution().executedPlan().toString()
    assert found.first().id == 123 and music.get_lyrics("song 9", "a") is None
