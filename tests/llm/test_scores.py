"""Trees, quality and toxicity: held-out accuracy, exact neighbours, odd rows."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from songloom.llm import blockmax, quality, terms, toxicity, trees
from songloom.llm.hashing import Stretches
from songloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def auc(scores, labels):
    rank = np.argsort(np.argsort(scores, kind="stable")) + 1
    y = np.asarray(labels) == 1
    return (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


def test_forest_learns_and_walks_like_one_row_at_a_time():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] * x[:, 2] > 0)).astype(float)
    forest = trees.fit(x[:2000], y[:2000])
    assert auc(forest.scores(x[2000:]), y[2000:]) > 0.95
    for row in x[:20]:
        total = forest.base
        for t in range(len(forest.feature)):
            node = 0
            while node < forest.feature.shape[1]:
                node = 2 * node + 1 + (row[forest.feature[t, node]] > forest.above[t, node])
            total += forest.value[t, node - forest.feature.shape[1]]
        assert total == pytest.approx(forest.margins(row[None])[0])
    assert (trees.fit(x, y).above == trees.fit(x, y).above).all()
    assert trees.fit(np.zeros((0, 4)), np.zeros(0)).scores(x[:1])[0] == pytest.approx(0.5)
    assert trees.fit(x[:50], np.ones(50)).scores(x[:1])[0] > 0.9


@pytest.mark.parametrize("name,label,least", [("op3_quality_scores", "quality", 0.97), ("op5_toxicity", "toxic", 0.85)])
def test_held_out_accuracy(spark, name, label, least):
    got = QUERIES[name](spark, SF)
    pairs = got.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("score", label).collect()
    assert auc([r[0] for r in pairs], [r[1] for r in pairs]) > least
    assert got.count() == 1000 and got.where("score < 0 or score > 1 or score is null").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_block_max_neighbours_like_comparing_all(seed):
    rng = random.Random(seed)
    vectors = []
    for _ in range(700):
        terms = np.array(sorted(rng.sample(range(12), rng.randrange(0, 5))), np.int64)
        weights = np.array([rng.choice([1.0, 1.0, 2.0, 3.5]) for _ in terms])
        vectors.append((terms, weights / np.linalg.norm(weights) if len(terms) else weights))
    labels = [rng.randrange(2) for _ in vectors]
    index = blockmax.build(vectors, 12, list(range(700)), labels, 2)
    assert index.counts.sum() == 700 and index.positives.sum() == sum(labels)
    dense = np.zeros((700, 12))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    asked = 600
    own = np.array([index.entry_of[q] if q % 2 else -1 for q in range(asked)])
    row, entry, cosine = index.nearest(blockmax.Vectors.of(vectors[:asked]), 15, own)
    for q in range(asked):
        every = dense @ dense[q]
        if q % 2:
            # One document of its own entry is left out.
            every = np.delete(every, q)
        bound = np.sort(every)[-15]
        mine = row == q
        counts = index.counts[entry[mine]] - (entry[mine] == own[q])
        assert counts.sum() == (every >= bound - 1e-9).sum()
        assert np.abs(cosine[mine][counts > 0].min() - bound) < 1e-9
    assert 0 < index.opened <= asked * index.maxima.shape[1]


def test_far_blocks_stay_closed():
    """Examples about different things: a query opens the blocks of its own only."""
    rng = random.Random(1)
    vectors = []
    for i in range(1280):
        pair = np.array([rng.uniform(0.2, 1), rng.uniform(0.2, 1)])
        vectors.append((np.array([2 * (i % 20), 2 * (i % 20) + 1]), pair / np.linalg.norm(pair)))
    index = blockmax.build(vectors, 40, list(range(1280)), [0] * 1280, 1)
    row, entry, cosine = index.nearest(blockmax.Vectors.of(vectors[:1]), 15)
    assert len(row) >= 15 and cosine.min() > 0 and index.opened < index.maxima.shape[1] / 2


def test_few_examples_are_all_neighbours():
    index = blockmax.build([(np.array([0]), np.array([1.0])), (np.array([1]), np.array([1.0]))], 2, [5, 6], [0, 1], 3)
    row, entry, cosine = index.nearest(blockmax.Vectors.of([(np.array([0]), np.array([1.0]))]), 15)
    assert entry.tolist() == [0, 1] and cosine.tolist() == [1.0, 0.0]


def plain_numbers(text, known, size):
    counts = Counter()
    for word in re.findall(r"[^\x20\x09-\x0D]+", terms.lowered(pa.array([text], pa.string()))[0].as_py()):
        own = terms.terms_of(word)
        counts.update({known[t] for t in own if t in known} or ({size} if own else ()))
    return sorted(counts.items())


def test_term_counts_like_word_by_word(monkeypatch):
    texts = ["", None, "  ", "Hello, World! \u201ctrash\u201d \u00abfoo\u00bb\u2026", "a b\tc", "日本語のテキスト。 test", "x!!! ...", "ÉTAT trashes TRASH tras tra"]
    rng = random.Random(0)
    texts += [" ".join(rng.choice(["trash", "Trashy,", "état", "ab", "été!", "house-boat", "\u2014", "日本語日本語"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    known = {t: i // 2 for i, t in enumerate(["trash$", "tras", "tra", "été", "été$", "hous", "house-", "日本語", "ab$"])}
    lexicon = terms.Lexicon(known)
    for size in (40, 1 << 20):
        monkeypatch.setattr(terms, "RUN_BYTES", size)
        got = []
        for sizes, numbers, counts in lexicon.counts(pa.array(texts, pa.string()), Stretches(1 << 12)):
            ends = np.cumsum(sizes)
            got += [list(zip(numbers[e - n : e].tolist(), counts[e - n : e].tolist())) for e, n in zip(ends.tolist(), sizes.tolist())]
        assert got == [plain_numbers(t, known, lexicon.size) for t in texts]


def test_scores_like_comparing_with_every_example(spark, documents):
    """Frequencies, vectors, neighbours, leave-one-out votes and the vote of each document, the plain way."""
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["vile", "viles", "good", "fine", *[f"w{j}" for j in range(30)]]) for _ in range(rng.randrange(0, 25)))) for i in range(260)]
    toxic = {i: int("vile" in t.split()) for i, t in rows if i < 200}
    model, held = toxicity.learn(documents(rows), spark.createDataFrame(list(toxic.items()), "doc_id long, label int"))
    known = dict(zip(model.lexicon._hashes.tolist(), model.lexicon._numbers.tolist()))
    numbers = {}
    for word in {t for _, text in rows for w in text.split() for t in terms.terms_of(w)}:
        n = known.get(int(terms.term_hashes([word])[0]))
        if n is not None:
            numbers[word] = n
    size = model.lexicon.size
    counts = {i: plain_numbers(t, numbers, size) for i, t in rows}
    frequency = Counter(n for c in counts.values() for n, _ in c if n < size)
    idf = [np.log((len(rows) + 1) / (frequency[n] + 1)) + 1 for n in range(size)] + [1.0]
    assert np.allclose(model.idf, idf)

    def vector(i):
        v = np.zeros(size + 1)
        for n, c in counts[i]:
            v[n] = (1 + np.log(c)) * idf[n]
        return v / np.linalg.norm(v) if v.any() else v

    vectors = {i: vector(i) for i, _ in rows}

    def vote(i, examples):
        if not vectors[i].any():
            near = [(1.0, toxic[e]) for e in examples if not vectors[e].any()]
        else:
            near = sorted(((vectors[e] @ vectors[i], toxic[e]) for e in examples), reverse=True)
            near = [x for x in near if x[0] >= near[14][0] - 1e-9]
        weights = [1 / (1 - min(c, 1.0) + toxicity.SOFT) for c, _ in near]
        return sum(w * y for w, (_, y) in zip(weights, near)) / sum(weights) if weights else None

    got = {r.doc_id: r for r in toxicity.judged(held, model).collect()}
    for i, _ in rows:
        plain = vote(i, toxic)
        expected = model.prior if plain is None else 1 / (1 + np.exp(-(model.slope * plain + model.shift)))
        assert got[i].score == pytest.approx(expected, abs=1e-9)
    own = [(vote(i, [e for e in toxic if e != i]), toxic[i]) for i in toxic]
    slope, shift = toxicity._curve(*(np.array(x, float) for x in zip(*[(v if v is not None else model.prior, y, 1) for v, y in own])))
    assert (slope, shift) == (pytest.approx(model.slope, rel=1e-6), pytest.approx(model.shift, rel=1e-6))


def test_scores_of_odd_rows(spark, documents, odd_rows):
    df = documents([*odd_rows, *[(500 + i, f"w{i} good text here {i % 7}" + " vile" * (i % 3 == 0)) for i in range(90)]], extra=True)
    labels = spark.createDataFrame([(500 + i, int(i % 3 == 0)) for i in range(60)] + [(None, 1), (500, 0), (1, None)], "doc_id long, label int")
    docs = df.drop("score")
    forest = quality.learn(docs, labels)
    scored = quality.quality_scores(docs, forest)
    assert scored.count() == df.count() and scored.where("score is null").count() == 0
    model, _ = toxicity.learn(docs, labels)
    judged = toxicity.toxicity_scores(docs, model)
    by_id = {r.doc_id: r for r in judged.collect()}
    assert judged.count() == df.count()
    assert by_id[563].predicted == 1 and by_id[564].predicted == 0
    assert {e.label for e in by_id[563].evidence} == {1}
    kept = toxicity.drop_toxic(df, model)
    assert kept.columns == df.columns and kept.count() == judged.where("predicted = 0").count()
    assert toxicity.drop_toxic(df.limit(0), model).count() == 0
    for none in (labels.limit(0), labels.where("label = 0")):
        prior = toxicity.toxicity_scores(docs, toxicity.learn(docs, none)[0]).select("score").distinct().collect()
        assert len(prior) == 1
        assert quality.quality_scores(docs, quality.learn(docs, none)).select("score").distinct().count() == 1


def test_folds_follow_crc32(spark):
    import zlib

    df = spark.createDataFrame([(i,) for i in [*range(200), None, -5]], "doc_id long").withColumn("out", quality.in_fold(4, 2))
    assert all(r.out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in df.collect())
