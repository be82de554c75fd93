import re

import pytest
from pyspark.sql import functions as F

from songloom.llm import mixing


def plain_targets(sizes, weights, most=3):
    """Share by weight, stop at the cap, share the excess again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        for s in above or open_:
            target[s] = most * sizes[s] if above else left * weight[s] / total
        left -= sum(target[s] for s in above)
        open_ -= above or set(open_)
    return target


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("weights", [(5, 2, 1), (1,), (100, 1, 1, 1)])
def test_targets_like_repeated_sharing(spark, weights):
    sizes = {"b": 100, "a": 5000, "Z": 0, None: 700, "é": 1200, "\U0001f600": 90, "z": 1}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets_of(df, weights).collect()}
    want = plain_targets(sizes, weights)
    assert got.keys() == want.keys()
    assert all(got[s] == pytest.approx(want[s], rel=1e-9, abs=1e-9) for s in want)
    assert sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_words_taken_come_near_targets(spark, documents):
    rows = [(i, "w " * (1 + i * 37 % 211)) for i in range(300)]
    got = mixing.mix(mixing.sizes_of(documents(rows)), (5, 2, 1)).collect()
    again = mixing.mix(mixing.sizes_of(documents(rows).repartition(7)), (5, 2, 1)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    assert len(got) == 300 and all(0 <= r.copies <= 3 for r in got)
    for source in {r.source for r in got}:
        mine = [r for r in got if r.source == source]
        assert sum(r.size for r in mine) == mine[0].source_size
        assert abs(sum(r.copies * r.size for r in mine) - mine[0].target) <= 0.002 * mine[0].target + 1


def test_rates_are_an_exponential_tilt(spark):
    classes = spark.createDataFrame([("a", s, 3) for s in (1, 10, 50, 200)], "source string, size long, n long")
    total = 3 * 261
    sources = spark.createDataFrame([("a", total, 1.7 * total)], "source string, source_size long, target double")
    tilt = mixing.balance(classes, sources).first().tilt
    rate = lambda s: 3 / (1 + 2 * 2.718281828459045 ** (-tilt * s))
    assert sum(3 * s * rate(s) for s in (1, 10, 50, 200)) == pytest.approx(1.7 * total, rel=1e-5)


def test_large_classes_are_dealt_in_parts(spark, documents, monkeypatch):
    monkeypatch.setattr(mixing, "CLASS_ROWS", 20)
    rows = [(i, "one two three") for i in range(500)]
    got = mixing.mix(mixing.sizes_of(documents(rows)), (5, 2, 1)).collect()
    assert len(got) == 500
    for source in {r.source for r in got}:
        mine = [r for r in got if r.source == source]
        assert abs(sum(3 * r.copies for r in mine) - mine[0].target) <= 3


def test_odd_rows(spark, documents, odd_rows):
    df = documents(odd_rows, extra=True)
    got = mixing.mix(mixing.sizes_of(df), (5, 2, 1)).collect()
    assert sorted(((r.doc_id, r.size) for r in got), key=repr) == sorted(((i, size(t)) for i, t in odd_rows), key=repr)
    taken = mixing.mixed(df, (5, 2, 1))
    assert taken.columns == df.columns
    assert taken.count() == sum(r.copies for r in got)
    assert mixing.mix(mixing.sizes_of(df.limit(0)), (5, 2, 1)).count() == 0
    assert mixing.mixed(df.limit(0), (5, 2, 1)).count() == 0
    none = documents([(1, ""), (2, None)])
    assert [r.copies for r in mixing.mix(mixing.sizes_of(none), (5, 2, 1)).collect()] == [0, 0]
