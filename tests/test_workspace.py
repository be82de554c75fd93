import json

import pytest

from songloom import Workspace, schemas
from songloom.operators.encoders import HashingEncoder
from songloom.operators.listings import list_enriched, list_liked, list_plays
from songloom.operators.stats import row_total
from songloom.plans.workspace import NothingStored
from tests.test_sources import pages, play, plays_page, saved

ENCODER = HashingEncoder(32)


@pytest.fixture
def music(spark, tmp_path):
    return Workspace(spark, str(tmp_path / "music"))


def liked_pages(spark):
    songs = [saved("1", name="Rain"), saved("2", name="rain "), saved("3", name="Sun", artists=[{"name": "Cy"}])]
    return pages(spark, {"items": songs})


def play_pages(spark):
    return pages(spark, plays_page([play("Moon", **{"@attr": {"nowplaying": "true"}}), play("rain")]), plays_page(play("moon")))


def records(spark):
    data = [(1, "Rain", "Ann", "Skies", 215.0, False, "rain is falling", None), (2, "Moon", "Ann", "", None, True, None, None)]
    raw = spark.createDataFrame(data, schemas.LYRICS)
    return raw.selectExpr("id", "name trackName", "name", "artist artistName", "album albumName", "duration",
                          "instrumental", "plain_lyrics plainLyrics", "synced_lyrics syncedLyrics")


def test_everything_in_turn(spark, music, rows):
    assert music.stored_sources() == [] and music.cache().count() == 0
    for source in ("auto", "both", "spotify"):
        with pytest.raises(NothingStored):
            music.library(source)
    with pytest.raises(NothingStored):
        music.build_index(ENCODER)
    assert rows(music.status()) == [("cache", m, "0") for m in sorted(("total", "with_lyrics", "instrumental", "not_found"))]

    stored = music.load("all", liked_pages(spark), play_pages(spark))
    assert {k: r.n for k, r in stored.items()} == {"spotify": 3, "raw_plays": 3, "lastfm": 2}
    music.load_lyrics(records(spark))
    assert music.effective_source() == "both"
    library, mapping = music.library()
    assert mapping == "spotify" and rows(library, "key") == [("moon||ann",), ("rain||ann",), ("sun||cy",)]
    assert music.library("spotify")[0].count() == 3 and music.library("lastfm")[0].count() == 2

    run = music.enrich("spotify")
    assert rows(run.songs, "name", "lyrics_found", "was_cached") == [("Rain", True, False), ("Sun", False, False), ("rain ", True, True)]
    assert tuple(music.summary(run).first()) == (3, 2, 0, 1, 1, 2)
    again = music.enrich("auto", new=5)
    assert rows(again.songs, "name", "lyrics_found", "instrumental") == [("Moon", True, True)]
    assert rows(music.cache_stats()) == [(3, 1, 1, 1)]
    folders = [p for r in music.tables.entries("lyrics_cache") for p in r.paths]
    assert len(folders) == 3 and len({p.rpartition("/")[0] for p in folders}) == 2
    assert music.enrich().songs.where("not was_cached").count() == 0
    music.enrich(force=True)
    assert rows(music.cache_stats()) == [(3, 1, 1, 1)]

    assert music.cached_lyrics(" RAIN", "ann ").plain_lyrics == "rain is falling"
    assert music.cached_lyrics("Sun", "Cy").lyrics_found is False and music.cached_lyrics("x", "y") is None
    assert music.get_lyrics("rain", "Ann").id == 1 and music.get_lyrics("sun", "Cy", "A", 3) is None
    assert rows(music.fetch_lyrics("lastfm"), "name", "lyrics_found") == [("Moon", True), ("rain", True)]

    counts = {"total_processed": 2, "indexed": 2, "skipped": 0, "collection_size": 2}
    assert music.build_index(ENCODER) == music.build_index(ENCODER) == counts
    assert [r.n for r in music.tables.manifest().where("name = 'run_index'").orderBy("snapshot").collect()] == [2, 0]
    assert music.index_size(ENCODER.model) == 2 and music.index_size() == 0
    best = music.search("falling rain", 1, ENCODER).first()
    assert (best.track_name, best.album) == ("Rain", "")
    music.build_index(ENCODER, with_album=True)
    assert music.search("falling rain", 1, ENCODER).first().album == "Skies"
    assert music.search_lyrics("falling", 3).first().name == "Rain"

    report = {(s, m): v for s, m, v in rows(music.status())}
    assert report[("spotify", "count")] == "3" and report[("lastfm", "count")] == "2"
    assert report[("cache", "total")] == "3" and report[(f"index {ENCODER.model}", "collection_size")] == "2"
    assert len(report[("spotify", "fetched")]) == 10

    assert music.clear_index(ENCODER.model) == 2 and music.clear_index(ENCODER.model) == 0
    assert music.search("rain", 1, ENCODER).count() == 0
    new = [("Sun", "Cy", "shine", None, False, True, 1), ("sun ", "cy", "shine on", None, False, True, 2)]
    music.save_lyrics(spark.createDataFrame(new, "track_name string, artist_name string, plain_lyrics string, "
                                            "synced_lyrics string, instrumental boolean, lyrics_found boolean, seq bigint"))
    assert music.cached_lyrics("Sun", "Cy").plain_lyrics == "shine on"
    assert music.clear_cache() == 3 and music.cache().count() == 0


def test_rejected_pages_are_stored(spark, music):
    music.load("lastfm", play_pages=pages(spark, plays_page(play("a")), '{"error": 6}', '{"recenttr'))
    assert sorted((r.page, r.reason) for r in music.rejected_pages().collect()) == [(2, "error 6"), (3, "no list of songs")]
    assert music.scrobbles().count() == 1
    music.load("lastfm", play_pages=pages(spark, plays_page(play("a"))))
    assert music.rejected_pages().count() == 0


def test_items_without_a_track_are_counted(spark, music):
    music.load("spotify", pages(spark, {"items": [saved("1"), {"added_at": "x"}, {"track": None}]}, {"items": [saved("2")]}))
    assert [(r.page, r.reason) for r in music.rejected_pages().collect()] == [(1, "2 without a track")]
    assert music.liked_songs().count() == 2


def test_plays_come_in_several_loads(spark, music, rows):
    later = lambda page, df: df.withColumn("page", df.page + page)
    first, second = pages(spark, plays_page([play("Moon"), play("rain")])), pages(spark, plays_page([play("moon "), play("Sun")]))
    music.add_plays(first)
    assert music.play_counts() == (2, 2)
    music.add_plays(later(10, second))
    music.add_plays(later(20, first))
    assert music.play_counts() == (6, 3)
    stepwise = rows(music.library("lastfm")[0], "key", "name", "seq")
    music.load("lastfm", play_pages=first.unionByName(later(10, second)).unionByName(later(20, first)))
    assert rows(music.library("lastfm")[0], "key", "name", "seq") == stepwise and music.play_counts() == (6, 3)


def test_records_without_an_id_are_kept(spark, music):
    row = lambda i, text: (i, "Sun", None, "Cy", "", 9.0, False, text, None)
    records = spark.createDataFrame([row(None, "one"), row(None, "two"), row(None, "two"), row(7, "x"), row(7, "y")], schemas.LYRIC_RECORD)
    for df in (records, records.orderBy("plainLyrics")):
        assert music.load_lyrics(df).n == 3
        kept = {r.plain_lyrics: r.id for r in music.lyrics().collect()}
        assert set(kept) == {"one", "two", "y"} and min(kept["one"], kept["two"]) > 1 << 61


def test_load_checks_its_source(spark, music):
    with pytest.raises(ValueError, match="not tape"):
        music.load("tape")
    with pytest.raises(ValueError, match="no pages"):
        music.load("spotify")
    music.load("lastfm", play_pages=play_pages(spark))
    assert music.effective_source() == "lastfm" and music.effective_source("both") == "both"
    with pytest.raises(NothingStored):
        music.library("spotify")
    assert music.library("both")[0].count() == 2


def test_listings(spark, music, rows):
    music.load("all", liked_pages(spark), play_pages(spark))
    liked, plays = music.library("spotify")[0], music.raw_plays()
    assert rows(list_liked(liked)) == [(1, "Rain", "Ann, Bo", "Skies"), (2, "rain ", "Ann, Bo", "Skies"), (3, "Sun", "Cy", "Skies")]
    assert rows(list_plays(plays), "number", "title", "date") == [(1, "> Moon", "Now playing"), (2, "rain", "14 Nov 2023"), (3, "moon", "14 Nov 2023")]
    assert rows(music.liked_songs(2)) == rows(list_liked(liked))[:2]
    assert rows(music.scrobbles(1), "number", "title") == [(1, "> Moon")]
    assert music.scrobbles().count() == 3
    music.load_lyrics(records(spark))
    assert rows(list_enriched(music.enrich().songs, "spotify")) == [
        (1, "Rain", "Ann", "[found]"), (2, "Sun", "Cy", "[missing]"), (3, "Moon", "Ann", "[instrumental]"),
    ]
    assert rows(row_total(plays)) == [(3,)]


def test_a_library_kept_as_json_can_move_in(spark, music, rows, tmp_path):
    from songloom.sources import stored_json

    path = tmp_path / "liked.json"
    song = {"id": "t", "name": "Rain", "artists": ["Ann"], "album": "S", "added_at": "2025-01-02T03:04:05Z", "duration_ms": 5, "spotify_url": ""}
    path.write_text(json.dumps({"source": "spotify", "fetched_at": "2025-01-02T00:00:00Z", "count": 1, "songs": [song]}))
    music.save_liked(stored_json.read_liked(spark, str(path)))
    assert rows(music.library()[0], "key") == [("rain||ann",)]
