from __future__ import annotations

import math
import random

import pytest

from songloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v string, block int"


def plain(rows, every, positives, k):
    """By comparing every anchor with all rows."""
    rows = {i: (label, [math.floor(256 * x) for x in v]) for i, v, label in rows}
    out = []
    for a, (label, v) in rows.items():
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in rows.items() if i != a and len(w) == len(v)]
        for p, pid, _ in sorted(s for s in scored if s[2] == label)[:positives]:
            fits = sorted(s for s in scored if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p)
            out += [(a, pid, r + 1, n, -p, -s) for r, (s, n, _) in enumerate(fits[:k])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, 7, "x", 1) for i, v, label in rows], SCHEMA)


@pytest.mark.parametrize("seed,grid", [(1, None), (2, 2)])
def test_against_all_pairs(spark, monkeypatch, seed, grid):
    """Several blocks; with a grid, many tied scores."""
    rng = random.Random(seed)

    def number():
        return rng.gauss(0, 1) if grid is None else rng.randrange(-1, 3) / 256

    import numpy as np

    rows = [(i, [float(np.float32(number())) for _ in range(6)], rng.randrange(3)) for i in range(300)]
    rows += [(300 + i, [1.0, 2.0], i % 2) for i in range(12)]
    monkeypatch.setattr(negatives, "BLOCK_BYTES", 1200)
    monkeypatch.setattr(negatives, "PAIRS", 300)
    found = negatives.hard_negatives(negatives.prepared(table(spark, rows).repartition(5)), 10, 4, 3)
    expected = plain(rows, 10, 4, 3)
    assert sorted(map(tuple, found.collect())) == expected and len(expected) > 50


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, [1.0, 1.0], 0), (1, [1.0, 1.0], 0), (2, [0.5, 0.5], 1), (3, [0.5, 0.5], 1), (4, [0.25, -0.5], 2), (100, [], 0), (101, [], 0), (102, [], 1)]
    bad = [(5, None, 0), (6, [1.0, 1.0], None), (7, [1.0, None], 0), (8, [nan, 1.0], 0), (9, [inf, 1.0], 0), (None, [1.0, 1.0], 0)]
    # Repeated rows count once; the least label of an id counts.
    found = negatives.hard_negatives(negatives.prepared(table(spark, good + bad + [good[2], (3, [0.5, 0.5], 5)])))
    assert sorted(map(tuple, found.collect())) == plain(good, 100, 5, 10)
    assert negatives.hard_negatives(negatives.prepared(table(spark, bad))).collect() == []
    assert negatives.hard_negatives(negatives.prepared(table(spark, []))).collect() == []


def test_large_components_are_exact(spark):
    rows = [(0, [1e6, 1.0], 0), (1, [9e5, 0.5], 0), (2, [3e5, 0.25], 1), (3, [3e5, 0.5], 1)]
    found = negatives.hard_negatives(negatives.prepared(table(spark, rows)))
    assert sorted(map(tuple, found.collect())) == plain(rows, 100, 5, 10)
