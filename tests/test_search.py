import numpy as np
import pytest
from pyspark.sql import functions as F

from songloom import schemas
from songloom.functions.vectors import norm
from songloom.operators import keyword, similarity
from songloom.operators.documents import document_text, documents, embeddable
from songloom.operators.encoders import (
    DEFAULT_MODEL, HashingEncoder, ModelEncoder, encode, encoder_for, word_bucket,
)
from songloom.operators.keyword import keyword_search
from songloom.operators.similarity import top_k
from songloom.plans import index as plans_index
from songloom.plans.index import build_index, changed_rows, index_rows, search, with_album

ENCODER = HashingEncoder(16)


def cache(spark, *entries):
    return spark.createDataFrame(list(entries), schemas.CACHE)


def entry(track, lyrics="la la", instrumental=False, found=True, artist="Ann"):
    key = f"{track.strip().lower()}||{artist.lower()}"
    return (key, track, artist, lyrics, None, instrumental, found)


def test_document_text(spark):
    df = spark.createDataFrame(
        [("T", "A", "B", True, "x\ny"), ("T", "A", "", False, ""), ("T", None, None, None, None)],
        "track_name string, artist_name string, album string, instrumental boolean, plain_lyrics string",
    )
    got = [r[0] for r in df.select(document_text(df)).collect()]
    silent = "This is an instrumental track with no vocals or lyrics."
    assert got == [f"Song: T by A\nAlbum: B\n{silent}\nLyrics:\nx\ny", "Song: T by A", "Song: T by "]
    assert [r[0] for r in df.select(embeddable(df)).collect()] == [True, False, False]


def test_songs_without_content_are_not_indexed(spark, rows):
    df = cache(spark, entry("a"), entry("b", lyrics=""), entry("c", lyrics=None, instrumental=True))
    assert rows(documents(df), "id", "instrumental", "has_lyrics", "album") == [
        ("a||ann", False, True, ""), ("c||ann", True, False, ""),
    ]


def test_hashing_encoder_counts_words(spark):
    texts = ["rain Rain, sun", "", None, "été 9 9"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, text string").repartition(2)
    got = {r.id: r for r in encode(df, ENCODER, "text").collect()}
    for i, words in {0: ["rain", "rain", "sun"], 3: ["été", "9", "9"]}.items():
        counts = np.bincount([word_bucket(w, 16) for w in words], minlength=16)
        assert np.allclose(got[i].embedding, counts / np.linalg.norm(counts))
        assert got[i].norm == pytest.approx(1) and got[i].model == "hashing-16"
    for i in (1, 2):
        assert got[i].embedding == [0.0] * 16 and got[i].norm == 0


def test_encoders_by_name(spark):
    assert encoder_for("hashing-32") == HashingEncoder(32)
    assert encoder_for().model == DEFAULT_MODEL
    lengths = ModelEncoder("lengths", lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]))
    df = spark.createDataFrame([("abc",), (None,)], "text string")
    assert [r.embedding for r in encode(df, lengths, "text").collect()] == [[3.0, 1.0], [0.0, 1.0]]


def vectors(spark, n=300, dim=8):
    rng = np.random.default_rng(3)
    data = rng.integers(-2, 3, (n, dim)).astype("float32")
    data[:5] = 0
    # A third of the vectors is the same: many ties.
    data[10:110] = data[10]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id bigint, embedding array<float>")
    return data, df.select("id", F.lit("m").alias("model"), "embedding", norm(F.col("embedding")).alias("norm")).repartition(6)


def brute(data, queries, k):
    unit = lambda v: v / (np.linalg.norm(v) or 1)
    out = []
    for q in queries:
        scores = [round(float(np.dot(unit(data[q].astype(float)), unit(v.astype(float)))), 9) for v in data]
        best = sorted(range(len(data)), key=lambda i: (-scores[i], i))[:k]
        out += [(q, rank, i, scores[i]) for rank, i in enumerate(best, 1)]
    return out


@pytest.mark.parametrize("k", [1, 7, 500])
def test_any_blocks_equal_brute_force(spark, k, monkeypatch):
    monkeypatch.setattr(similarity, "SCORE_CELLS", 100)
    data, index = vectors(spark)
    asked = [0, 7, 10, 200, 250]
    queries = index.where(F.col("id").isin(asked)).withColumnRenamed("id", "query_id")
    expect = sorted(brute(data, asked, k))
    for hits in (top_k(queries, index, k), top_k(queries, index, k, block_bytes=128)):
        got = sorted(tuple(r) for r in hits.collect())
        assert [g[:3] for g in got] == [e[:3] for e in expect]
        assert np.allclose([g[3] for g in got], [e[3] for e in expect], atol=1e-9)


def test_vectors_without_direction_are_not_found(spark):
    """One query or ten, a NaN, infinite, NULL or shorter vector changes nothing."""
    nan, inf = float("nan"), float("inf")
    bad = [(900, [nan] * 8), (901, [inf] + [0.0] * 7), (902, None), (903, [1.0] * 5), (904, [None] + [1.0] * 7), (905, [0.0] * 8)]
    odd = spark.createDataFrame(bad, "id bigint, embedding array<float>").select(
        "id", F.lit("m").alias("model"), "embedding", norm(F.col("embedding")).alias("norm"))
    data, index = vectors(spark)
    both = index.unionByName(odd)
    for asked in ([7], [0, 7, 10, 20, 30, 110, 120, 200, 250, 299]):
        queries = index.where(F.col("id").isin(asked)).withColumnRenamed("id", "query_id")
        clean = sorted(map(tuple, top_k(queries, index, 60).collect()))
        found = sorted(map(tuple, top_k(queries.unionByName(odd.where("id < 905").withColumnRenamed("id", "query_id")), both, 60).collect()))
        assert [f for f in found if f[0] != 903] == clean
        assert [f for f in found if f[0] == 903] == [(903, 1, 903, 1.0)]
    assert similarity.left_out(both, "m", 8) == 5


def test_deep_results_are_cut_in_two_levels(spark, monkeypatch):
    _, index = vectors(spark)
    queries = index.where("id in (7, 200)").withColumnRenamed("id", "query_id")
    want = sorted(map(tuple, top_k(queries, index, 50).collect()))
    monkeypatch.setattr(similarity, "OWN_CUT", 10)
    assert sorted(map(tuple, top_k(queries, index, 50).collect())) == want


def test_texts_are_encoded_once_and_after_the_spread(spark):
    """No filter of the plan copies the encoder, and no row of queries goes along with rows of the index."""
    texts = spark.createDataFrame([(i, f"rain {i} sun") for i in range(40)], "id bigint, text string").repartition(5)
    index = encode(texts, ENCODER, "text").drop("text")
    hits = top_k(plans_index.query_vectors(texts.withColumnRenamed("id", "query_id"), ENCODER), index, 3)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert plan.index("ArrowEvalPython") < plan.index("REPARTITION")
    assert hits.count() == 120


def test_models_do_not_meet(spark):
    _, index = vectors(spark, 20)
    queries = index.withColumnRenamed("id", "query_id").withColumn("model", F.lit("other"))
    assert top_k(queries, index, 3).count() == 0
    assert top_k(queries.where("false"), index, 3).count() == 0


def test_search_end_to_end(spark, monkeypatch):
    df = cache(spark, entry("Rain", "rain rain falling"), entry("Sun", "shining bright"), entry("Gone", None, found=False),
               entry("Quiet", None, instrumental=True), entry("Long", "word " * 100))
    index = build_index(spark.createDataFrame([], schemas.INDEX), df, ENCODER)
    assert index.count() == 4
    first = search(index, ["rain falling"], ENCODER, 2).orderBy("rank").collect()
    assert [r.rank for r in first] == [1, 2] and first[0].track_name == "Rain"
    assert first[0].distance == pytest.approx(1 - first[0].score)
    assert first[0].match_percent == round(first[0].score * 100, 1)
    long = search(index, ["word word"], ENCODER, 10).where("track_name = 'Long'").first()
    assert len(long.document_preview) == 203 and long.document_preview.endswith("...")
    assert search(index, ["x"], ENCODER, 10).count() == 4
    many = search(index, ["rain", "sun", "bright", "quiet", "word", "falling"], ENCODER, 1)
    table = spark.createDataFrame([(i, t) for i, t in enumerate(["rain", "sun", "bright", "quiet", "word", "falling"])], "query_id bigint, text string")
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, search(index, table, ENCODER, 1).collect()))
    assert search(index.where("false"), ["rain"], ENCODER).count() == 0
    monkeypatch.setattr(plans_index, "BROADCAST_HITS", 0)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, search(index, table, ENCODER, 1).collect()))
    with pytest.raises(ValueError):
        search(index, ["rain"], ENCODER, -1)


def test_indexing_again_replaces(spark, rows):
    old = build_index(spark.createDataFrame([], schemas.INDEX), cache(spark, entry("a", "old"), entry("b")), ENCODER)
    new = build_index(old, cache(spark, entry("a", "new")), ENCODER)
    assert rows(new, "id", "document") == [("a||ann", "Song: a by Ann\nLyrics:\nnew"), ("b||ann", "Song: b by Ann\nLyrics:\nla la")]
    again = build_index(new, cache(spark, entry("a", "new")), ENCODER)
    assert rows(again, "id", "document") == rows(new, "id", "document")


def test_only_changed_songs_are_encoded(spark, rows):
    index = build_index(spark.createDataFrame([], schemas.INDEX), cache(spark, entry("a"), entry("b"), entry("c")), ENCODER)
    again = cache(spark, entry("a"), entry("B"), entry("c", "other"), entry("d"))
    assert rows(changed_rows(index, again, ENCODER), "id", "track_name") == [("b||ann", "B"), ("c||ann", "c"), ("d||ann", "d")]
    assert changed_rows(index, again, HashingEncoder(8)).count() == 4
    full = index_rows(again, ENCODER)
    assert rows(build_index(index, again, ENCODER)) == rows(full)


def test_documents_do_not_cross_an_exchange_to_find_changes(spark, monkeypatch):
    index = build_index(spark.createDataFrame([], schemas.INDEX), cache(spark, entry("a"), entry("b")), ENCODER)
    plans = []
    monkeypatch.setattr(plans_index, "kept", lambda df: plans.append(df) or df)
    rows = changed_rows(index, cache(spark, entry("a", "new"), entry("b")), ENCODER)
    assert [r.id for r in rows.collect()] == ["a||ann"]
    for df in (plans[0], rows):
        lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
        moved = [lines[i + 1] for i, line in enumerate(lines) if "Exchange" in line]
        assert moved and not any("document" in line for line in moved)


def test_album_comes_from_the_library(spark, rows):
    library = spark.createDataFrame([(2, "a||ann", "Two"), (1, "a||ann", "One")], "seq bigint, key string, album string")
    got = index_rows(with_album(cache(spark, entry("a"), entry("b")), library), ENCODER)
    assert rows(got, "id", "album") == [("a||ann", "One"), ("b||ann", "")]


def test_keyword_search(spark, monkeypatch):
    records = spark.createDataFrame(
        [(3, "Red Rain", "Ann", "A", None, False, "falling", None), (1, "Sun", "Bo", "Rain", None, False, "red red", None),
         (2, "Moon", "Cy", "B", None, True, None, None)],
        schemas.LYRICS,
    )
    one = lambda q, n=5: [(r.rank, r.id, r.score) for r in keyword_search(records, q, n).orderBy("rank").collect()]
    assert one("red RAIN falling!") == [(1, 3, 3), (2, 1, 2)]
    assert one("red rain") == [(1, 1, 2), (2, 3, 2)]
    assert one("red rain", 1) == [(1, 1, 2)]
    assert one("nothing") == one("") == one("red", 0) == []
    many = keyword_search(records, {"x": "red rain", "y": "moon cy", "z": ""}, 1)
    assert sorted((r.query_id, r.rank, r.id) for r in many.collect()) == [("x", 1, 1), ("y", 1, 2)]
    monkeypatch.setattr(keyword, "BROADCAST_HITS", 0)
    again = keyword_search(records, {"x": "red rain", "y": "moon cy", "z": ""}, 1)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, many.collect()))
    with pytest.raises(ValueError):
        keyword_search(records, "red", -1)
