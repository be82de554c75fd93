import pytest

from songloom import schemas
from songloom.operators.enrich import (
    cache_coverage, cache_lookup, enrich, fetch_lyrics, run_summary, save_to_cache,
    songs_to_process, uncached,
)
from songloom.operators.library import with_key, with_lookup

LIKED = "seq bigint, name string, artists array<string>, album string, duration_ms bigint"

# seq, name, artists, album, milliseconds; then what a run without and with ``force`` finds:
# text, instrumental, found, from the cache.
SONGS = [
    ((0, "Rain", ["Ann"], "A", 100_999), ("r1", False, True, False), ("r1", False, True, False)),
    ((1, "rain ", ["ANN", "Cy"], "B", 100_999), ("r1", False, True, True), ("r3", False, True, False)),
    ((2, "Sun", ["Ann"], "A", 120_000), ("old", False, True, True), ("s9", False, True, False)),
    ((3, "Moon", ["Bo"], None, None), (None, False, False, True), ("m5", True, True, False)),
    ((4, "Nowhere", [], "", 0), (None, False, False, False), (None, False, False, False)),
    ((5, "nowhere", [], "", 0), (None, False, False, True), (None, False, False, False)),
    ((6, "Intro", ["Bo"], "Z", 121_500), ("i4", False, True, False), ("i4", False, True, False)),
    ((7, "INTRO", ["Bo"], "", None), ("i4", False, True, True), ("i4", False, True, False)),
    ((8, "Rain", ["Ann"], "C", 500_000), ("r1", False, True, True), ("r2", False, True, False)),
    ((9, "x||y", ["Bo"], "A", 1_000), (None, False, False, False), (None, False, False, False)),
    ((10, "Sun", ["Ann", "Bo"], "B", None), ("old", False, True, True), ("s8", False, True, False)),
]
# id, name, artist, album, seconds, instrumental, text
RECORDS = [
    (1, "rain", "ann", "A", 100.0, False, "r1"), (2, " Rain", "Ann", "A", 119.0, False, "r2"),
    (3, "RAIN", "Ann ", "B", None, False, "r3"), (4, "intro", "bo", "A", 121.0, False, "i4"),
    (5, "Moon", "Bo", "Q", 90.0, True, "m5"), (6, "Intro", "Bo", "B", 122.5, False, "i6"),
    (20, "Intro", "Bo", "", None, False, "i2"), (8, "sun", "Ann", "B", 7.0, False, "s8"),
    (9, "sun", "ann", "A", 300.0, False, "s9"), (11, "Sun", "Ann", "C", 120.0, False, "s11"),
]
CACHED = [
    ("sun||ann", "Sun", "Ann", "old", None, False, True),
    ("moon||bo", "Moon", "Bo", None, None, False, False),
    ("else||bo", "Else", "Bo", "e", None, False, True),
]
# What the run adds to the cache: without force new keys, with force the last song of each.
DELTA = {
    False: [("rain||ann", "Rain", "r1"), ("nowhere||", "Nowhere", None), ("intro||bo", "Intro", "i4"), ("x||y||bo", "x||y", None)],
    True: [
        ("rain||ann", "Rain", "r2"), ("nowhere||", "nowhere", None), ("intro||bo", "INTRO", "i4"),
        ("x||y||bo", "x||y", None), ("sun||ann", "Sun", "s8"), ("moon||bo", "Moon", "m5"),
    ],
}


def expected(force, songs=SONGS):
    return sorted(((song[0], *(forced if force else plain)) for song, plain, forced in songs), key=repr)


@pytest.fixture
def case(spark):
    return (
        spark.createDataFrame([song for song, _, _ in SONGS], LIKED).repartition(5),
        spark.createDataFrame(CACHED, schemas.CACHE),
        spark.createDataFrame([(*r[:6], r[6], None) for r in RECORDS], schemas.LYRICS).repartition(3),
    )


RESULT = ("seq", "plain_lyrics", "instrumental", "lyrics_found", "was_cached")


@pytest.mark.parametrize("force", [False, True])
@pytest.mark.parametrize("hot_rows", [2, 1_000_000])
def test_each_song_gets_its_lyrics(case, rows, force, hot_rows):
    got = enrich(*case, "spotify", force=force, hot_rows=hot_rows)
    assert rows(got.songs, *RESULT) == expected(force)
    assert got.songs.columns[:5] == ["seq", "name", "artists", "album", "duration_ms"]
    assert rows(got.delta, "key", "track_name", "plain_lyrics") == sorted(DELTA[force], key=repr)


def test_a_hot_key_with_many_songs(spark, case, rows):
    """The first song of an uncached key is looked up, all later ones find it cached."""
    many = spark.createDataFrame([(i, "Rain", ["Ann"], "A" if i else "B", 100_000) for i in range(300)], LIKED)
    got = enrich(many, *case[1:], "spotify", hot_rows=20)
    assert rows(got.songs, *RESULT) == sorted(((i, "r3", False, True, i > 0) for i in range(300)), key=repr)
    forced = enrich(many, *case[1:], "spotify", force=True, hot_rows=20)
    assert rows(forced.songs, *RESULT) == sorted(((i, "r1" if i else "r3", False, True, False) for i in range(300)), key=repr)


@pytest.mark.parametrize("force", [False, True])
def test_unique_songs_take_the_short_way(case, rows, force):
    firsts = [s for s in SONGS if s[0][0] in (0, 2, 3, 4, 6, 9)]
    liked = case[0].where(case[0].seq.isin([s[0][0] for s in firsts]))
    got = enrich(liked, *case[1:], "spotify", force=force, unique=True)
    assert rows(got.songs, *RESULT) == expected(force, firsts)


def test_limit_and_new(case, rows):
    assert rows(enrich(*case, "spotify", limit=4).songs, *RESULT) == expected(False, SONGS[:4])
    open_ = [s for s in SONGS if s[0][0] in (0, 1, 4, 5, 6)]
    assert rows(enrich(*case, "spotify", new=5).songs, *RESULT) == expected(False, open_)
    assert rows(enrich(*case, "spotify", new=4, force=True).songs, *RESULT) == expected(True, SONGS[:4])
    for limit in (0, None):
        assert songs_to_process(with_key(case[0], "spotify"), case[1], limit=limit).count() == len(SONGS)


def test_conflicting_and_negative_limits(case):
    frames = case
    for options in ({"limit": 1, "new": 1}, {"limit": -1}, {"new": -1}):
        with pytest.raises(ValueError):
            enrich(*frames, "spotify", **options)
    with pytest.raises(ValueError, match="not tape"):
        enrich(*frames, "tape")


def test_cache_reads(case, rows):
    liked, stored, _ = case
    keyed = with_key(liked, "spotify")
    assert rows(cache_lookup(keyed, stored).where("was_cached"), "seq") == [(10,), (2,), (3,)]
    assert uncached(keyed, stored, hot_rows=2).count() == 8
    assert rows(cache_coverage(keyed, stored)) == [(3, 8)]
    assert rows(cache_coverage(keyed.where("false"), stored)) == [(0, 0)]


def test_plays_are_looked_up_without_a_length(spark, rows):
    plays = spark.createDataFrame([(1, "Rain", "Ann", "B")], "seq bigint, name string, artist string, album string")
    assert rows(with_lookup(plays, "lastfm"), "key", "lookup_album", "lookup_seconds") == [("rain||ann", "B", None)]
    records = [dict(id=i, name="rain", artist="ann", album=a, duration=d) for i, a, d in ((3, "A", 1.0), (2, "B", 9.0), (1, "B", 5.0))]
    lyrics = spark.createDataFrame([(*r.values(), False, f"t{r['id']}", None) for r in records], schemas.LYRICS)
    got = fetch_lyrics(plays, lyrics, "lastfm")
    assert rows(got, "plain_lyrics", "lyrics_found") == [("t1", True)]


def test_summary_adds_up(case):
    frames = case
    s = run_summary(enrich(*frames, "spotify").songs).first()
    assert s.processed == s.found + s.instrumental + s.not_found == s.from_cache + s.lookups


def test_last_save_wins_and_saving_twice_changes_nothing(spark, rows):
    cache = spark.createDataFrame([("a", "A", "x", "old", None, False, True), ("b", "B", "x", None, None, False, False)], schemas.CACHE)
    saved = spark.createDataFrame(
        [("a", "A", "x", "one", None, False, True, 1), ("a", "A2", "x", None, None, True, True, 2), ("c", "C", "x", "c", None, False, True, 3)],
        schemas.CACHE + ", seq bigint",
    )
    once = save_to_cache(cache, saved)
    assert rows(once, "key", "track_name", "plain_lyrics") == [("a", "A2", None), ("b", "B", None), ("c", "C", "c")]
    assert rows(save_to_cache(once, saved)) == rows(once)
