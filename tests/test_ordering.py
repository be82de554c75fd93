import pytest

from songloom.operators import ordering
from songloom.operators.ordering import first_n, first_per_key, last_per_key, number_rows


@pytest.fixture
def plays(spark):
    data = [(i, f"k{i % 7}" if i % 3 else "hot", f"v{i}") for i in range(200)]
    return spark.createDataFrame(data, "seq bigint, key string, v string").repartition(6)


def model(rows, last=False):
    kept = {}
    for seq, key, v in sorted(rows, reverse=last):
        kept.setdefault(key, (seq, key, v))
    return sorted(kept.values(), key=repr)


def test_first_and_last_per_key(plays, rows):
    data = [tuple(r) for r in plays.collect()]
    assert rows(first_per_key(plays)) == model(data)
    assert rows(last_per_key(plays)) == model(data, last=True)
    assert rows(first_per_key(first_per_key(plays))) == model(data)


def test_one_row_per_key_is_cut_before_the_shuffle(plays):
    plan = first_per_key(plays)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_first_n(plays, rows, monkeypatch):
    expect = sorted((tuple(r) for r in plays.collect()))[:20]
    assert rows(first_n(plays, 20)) == sorted(expect, key=repr)
    monkeypatch.setattr(ordering, "SHORT_PREFIX", 5)
    assert rows(first_n(plays, 20)) == sorted(expect, key=repr)
    assert first_n(plays, 0).count() == first_n(plays, None).count() == 200
    assert first_n(plays, 1000).count() == 200
    with pytest.raises(ValueError):
        first_n(plays, -1)


@pytest.mark.parametrize("limit", [999, 1000, 1001])
def test_a_row_without_a_place_is_an_error_for_any_limit(spark, limit):
    df = spark.createDataFrame([(1,), (None,), (2,)], "seq bigint")
    with pytest.raises(Exception, match="a row has no seq"):
        first_n(df, limit).collect()
    assert first_n(df.where("seq is not null"), limit).count() == 2


def test_numbers_are_dense_for_any_spread(spark):
    seqs = [-5, 0, 3, 65535, 65536, 90_000, 1 << 32, (1 << 32) + 1, 5 << 47, 1 << 62, (1 << 62) + 7]
    df = spark.createDataFrame([(s,) for s in reversed(seqs)], "seq bigint").repartition(3)
    got = sorted(tuple(r) for r in number_rows(df).select("seq", "number").collect())
    assert got == [(s, i) for i, s in enumerate(seqs, 1)]
