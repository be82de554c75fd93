from pyspark.sql import functions as F

from songloom.operators.skew import hot_keys, join_unique


def data(spark):
    left = [(i, "hot" if i % 3 else f"k{i % 11}", i % 2 or None) for i in range(120)]
    songs = spark.createDataFrame(left, "seq bigint, key string, n bigint").repartition(4)
    right = [("hot", "H"), ("k1", "one"), ("k2", "two"), ("other", "x")]
    return songs, spark.createDataFrame(right, "key string, v string")


def test_hot_keys_are_listed_with_their_salts(spark, rows):
    songs, _ = data(spark)
    assert rows(hot_keys(songs, ["key"], 20)) == [("hot", 4)]
    assert rows(hot_keys(songs, ["key"], 1000)) == []


def test_salted_join_equals_plain_join(spark, rows):
    songs, table = data(spark)
    for how in ("left", "inner"):
        plain = songs.join(table, "key", how)
        for hot_rows in (7, 1000, None):
            got = join_unique(songs, table, how=how, hot_rows=hot_rows)
            assert got.columns == ["seq", "key", "n", "v"]
            assert rows(got, "seq", "key", "v") == rows(plain, "seq", "key", "v")
    for how in ("left_anti", "left_semi"):
        got = join_unique(songs, table.select("key"), how=how, hot_rows=7)
        assert rows(got) == rows(songs.join(table, "key", how), "seq", "key", "n")


def test_null_can_be_a_value(spark, rows):
    songs, _ = data(spark)
    table = spark.createDataFrame([("hot", None, "none"), ("hot", 1, "one")], "key string, n bigint, v string")
    got = join_unique(songs, table, ["key", "n"], hot_rows=7, null_safe=["n"])
    expect = sorted(
        ((r.seq, {None: "none", 1: "one"}[r.n] if r.key == "hot" else None) for r in songs.collect()),
        key=repr,
    )
    assert rows(got, "seq", "v") == expect


def test_hot_rows_are_spread(spark):
    songs, table = data(spark)
    salts = songs.join(hot_keys(songs, ["key"], 10), "key").select(
        F.pmod(F.xxhash64("seq"), F.col("_salts"))
    )
    assert salts.distinct().count() == 8


def test_every_hot_key_is_listed(spark, rows):
    many = spark.range(12_000).selectExpr("id as seq", "concat('k', id % 6000) as key")
    assert hot_keys(many, ["key"], 1).count() == 6000
    table = spark.range(6000).selectExpr("concat('k', id) as key", "id as v")
    got = join_unique(many, table, hot_rows=1)
    assert got.count() == 12_000 and got.where("v is null or concat('k', v) <> key").count() == 0


def test_known_counts_spread_like_counted_ones(spark, rows):
    from pyspark.sql import functions as F
    from songloom.operators.skew import even_rows

    many = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(90)] + [(None, 99)], "key string, seq bigint")
    table = spark.createDataFrame([("hot", "x"), ("k0", "y")], "key string, v string")
    counted = many.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    plain = rows(join_unique(many, table, hot_rows=7))
    assert rows(join_unique(many, table, hot_rows=7, counted=counted)) == plain and len(plain) == 91
    assert even_rows(10) == 1_000 and even_rows(10**12) == 10**7
