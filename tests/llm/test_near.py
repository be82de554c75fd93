import random
import re

import numpy as np
import pandas as pd

from songloom.llm import near
from songloom.llm.components import connect

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(UPPER))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def plain(rows):
    """Smallest id reachable over all links, from all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    smallest = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            smallest[root(k)] = min(i, smallest.get(root(k), i))
    return [(i, len(sets[k]), smallest.get(root(k)) if sets[k] else i) for k, (i, _) in enumerate(rows)]


def chained(seed, groups=6, steps=12, words=120):
    """Groups in which each text is an edit of the one before, so ends are far apart."""
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        text = [f"v{rng.randrange(5000)}" for _ in range(words)]
        for _ in range(steps):
            rows.append((len(rows) + 50, " ".join(text)))
            text = list(text)
            for _ in range(rng.choice((1, 2, 3))):
                text[rng.randrange(words)] = f"v{rng.randrange(5000)}"
    rng.shuffle(rows)
    return rows


def test_like_comparing_all_pairs(documents, odd_rows):
    rows = odd_rows + chained(1) + [(40, "ONE Two three"), (41, "a b c d e"), (42, "A b\tC d\ne"), (43, "É b c d e")]
    got = near.near_duplicates(documents(rows, extra=True)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted(plain(rows), key=repr)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_stage_keeps_one_of_each_group(documents, odd_rows):
    rows = odd_rows + chained(2, groups=2)
    df = documents(rows, extra=True)
    kept = near.drop_near_copies(df)
    assert kept.columns == df.columns
    verdict = [v for (_, t), v in zip(rows, plain(rows)) if shingles(t)]
    wordless = sum(not shingles(t) for _, t in rows)
    found = kept.collect()
    assert sum(not shingles(r.text) for r in found) == wordless
    assert sorted(r.doc_id for r in found if shingles(r.text)) == sorted({v[2] for v in verdict})
    assert near.near_duplicates(df.limit(0)).count() == 0 and near.drop_near_copies(df.limit(0)).count() == 0


def test_block_finds_every_joining_link():
    """A block's links give the components of all its pairs, in one or two blocks."""
    rng = random.Random(4)
    rows = chained(9, groups=3, steps=10)
    rng.shuffle(rows)
    vocabulary = {}
    sets = [np.array(sorted(hash((x, 1)) & (2**64 - 1) for x in shingles(t)), np.uint64) for _, t in rows]
    signer = near.Signer()
    sketches = signer.sketches(signer.samples(sets))
    frame = pd.DataFrame({
        "node": range(len(rows)), "component": range(len(rows)), "n": [len(s) for s in sets],
        "sketch": [s.view(np.int64) for s in sketches], "set": [s.view(np.int64) for s in sets], "side": 2,
    })
    links = near._compare_block(frame)
    parent = list(range(len(rows)))
    for a, b in links.itertuples(index=False):
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        assert a != b
        parent[max(a, b)] = min(a, b)
    assert len(rows) - len(links) == len({v[2] for v in plain(rows)})
    assert not vocabulary


def test_sketches_estimate_high_similarities():
    rng, signer = np.random.default_rng(2), near.Signer()
    for share in (0.6, 0.75, 0.9, 1.0):
        x = rng.integers(0, 2**63, 2000, dtype=np.uint64)
        own = int(2000 * (1 - share) / (1 + share))
        y = np.concatenate([x[own:], rng.integers(0, 2**63, own, dtype=np.uint64)])
        true = (2000 - own) / (2000 + own)
        a, b = signer.sketches(signer.samples([np.sort(x), np.sort(y)]))
        differ = int(np.bitwise_count(a ^ b).sum())
        samples = np.log(max(1 - 2 * differ / near.BITS, 1e-9)) / np.log(1 - 2 / near.BITS)
        assert abs(1 - samples / (2 * near.BANDS * near.ROWS) - true) < 0.12


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(60)]
    hub = [(100, 100 + i) for i in range(1, 80)]
    rng = random.Random(1)
    links = chain + hub + [(300, 301), (301, 302), (302, 300)]
    rng.shuffle(links)
    got = {r.node: r.component for r in connect(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[100 + i] == 100 for i in range(80))
    assert {got[i] for i in (300, 301, 302)} == {300}
