import json

import pytest

from songloom import schemas
from songloom.operators.library import both_sources, unique_plays, with_artist
from songloom.session import shared_dir
from songloom.sources import landed, stored_json
from songloom.sources.tables import TableStore


def pages(spark, *bodies):
    rows = [(i, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies, 1)]
    return spark.createDataFrame(rows, schemas.PAGE)


def saved(track_id, **more):
    track = {
        "id": track_id, "name": "Rain Song", "artists": [{"name": "Ann"}, {"name": "Bo"}],
        "album": {"name": "Skies"}, "duration_ms": 215999, "external_urls": {"spotify": "u1"}, **more,
    }
    return {"added_at": "2025-01-02T03:04:05Z", "track": track}


def play(name, **more):
    return {"name": name, "artist": {"#text": "Ann"}, "album": {"#text": "Skies"}, "url": "u",
            "date": {"uts": "1700000000", "#text": "14 Nov 2023"}, **more}


def plays_page(track, **attr):
    return {"recenttracks": {"@attr": attr, "track": track}}


def test_liked_pages(spark):
    df = landed.normalize_liked(pages(
        spark, {"items": [saved("t1"), saved("t2", external_urls={})]}, {"items": []}, {},
        {"items": [{"added_at": "x", "track": None}, saved("t3", artists=[])]}, "{bad",
    ))
    got = {r.id: r for r in df.collect()}
    assert sorted(got) == ["t1", "t2", "t3"]
    assert got["t1"].artists == ["Ann", "Bo"] and got["t1"].duration_ms == 215999
    assert got["t1"].seq == 1 << 32 and got["t2"].seq == (1 << 32) + 1 and got["t3"].seq == (4 << 32) + 1
    assert got["t2"].spotify_url == "" and got["t3"].artists == []
    assert got["t1"].added_at == "2025-01-02T03:04:05Z" and got["t1"].added_ts.year == 2025


def test_play_pages(spark):
    df = landed.normalize_plays(pages(
        spark,
        plays_page([play("now", **{"@attr": {"nowplaying": "true"}}), play("old")]),
        plays_page(play("alone")), plays_page([]), {}, {"recenttracks": {}},
        plays_page([{}, play("x", **{"@attr": {"nowplaying": "false"}})]),
    ))
    got = sorted(tuple(r) for r in df.drop("played_at").collect())
    at, page = ("1700000000", "14 Nov 2023"), 1 << 32
    assert got == [
        (page, "now", "Ann", "Skies", None, "Now playing", True, "u"),
        (page + 1, "old", "Ann", "Skies", *at, False, "u"),
        (2 * page, "alone", "Ann", "Skies", *at, False, "u"),
        (6 * page, "", "", "", None, None, False, ""),
        (6 * page + 1, "x", "Ann", "Skies", *at, False, "u"),
    ]


def test_page_totals(spark, rows):
    df = pages(spark, plays_page([], total="41", totalPages="3"), plays_page([], total="41", totalPages="3"))
    assert rows(landed.page_totals(df)) == [(41, 3)]
    assert rows(landed.page_totals(pages(spark, {}))) == [(0, 0)]


def test_pages_from_files(spark, rows, tmp_path):
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.json").write_text(json.dumps({"page": 7, "body": plays_page(play("a"))}) + "\n")
    got = landed.normalize_plays(landed.read_pages(spark, str(tmp_path / "lines")))
    assert rows(got, "seq", "name") == [(7 << 32, "a")]
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "2025-page-0012.json").write_text(json.dumps({"items": [saved("t1")]}, indent=1))
    got = landed.normalize_liked(landed.read_page_files(spark, str(tmp_path / "files")))
    assert rows(got, "seq", "id") == [(12 << 32, "t1")]


def test_lyric_records(spark, rows, tmp_path):
    records = [
        {"id": 1, "trackName": "T", "name": "N", "artistName": "A", "albumName": "B", "duration": 9.5,
         "instrumental": True, "plainLyrics": None, "syncedLyrics": "[0] x"},
        {"id": 2, "name": "N"}, {"id": 3},
    ]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, records)))
    got = landed.normalize_lyrics(landed.read_lyric_records(spark, str(tmp_path)))
    assert rows(got) == [
        (1, "T", "A", "B", 9.5, True, None, "[0] x"),
        (2, "N", "", "", None, False, None, None), (3, "", "", "", None, False, None, None),
    ]


def test_stored_json_files(spark, rows, tmp_path):
    liked = {"id": "t", "name": "Rain", "artists": ["Ann"], "album": "S", "added_at": "2025-01-02T03:04:05Z",
             "duration_ms": 5, "spotify_url": ""}
    plays = [{"name": "Now", "artist": "Bo", "album": "", "timestamp": None, "date_text": "Now playing",
              "now_playing": True, "lastfm_url": ""}]
    write = lambda name, data: (tmp_path / name).write_text(json.dumps(data, indent=2))
    write("liked.json", {"source": "spotify", "fetched_at": "2025-02-03T00:00:00+00:00", "count": 2, "songs": [liked, liked]})
    write("plays.json", {"source": "lastfm", "fetched_at": "2025-02-03T00:00:00+00:00", "count": 1, "songs": plays})
    write("cache.json", {"rain||ann": {"track_name": "Rain", "artist_name": "Ann", "plain_lyrics": "x\ny",
                                       "synced_lyrics": None, "instrumental": False, "lyrics_found": True}})
    (tmp_path / "bad.json").write_text("{bad")
    at = lambda name: str(tmp_path / name)
    assert rows(stored_json.read_liked(spark, at("liked.json")), "seq", "id", "artists") == [(0, "t", ["Ann"]), (1, "t", ["Ann"])]
    assert rows(stored_json.read_plays(spark, at("plays.json")), "name", "timestamp", "now_playing") == [("Now", None, True)]
    assert rows(stored_json.read_cache(spark, at("cache.json"))) == [("rain||ann", "Rain", "Ann", "x\ny", None, False, True)]
    assert rows(stored_json.read_store_info(spark, at("liked.json")), "source", "count") == [("spotify", 2)]
    for name in ("bad.json", "none.json"):
        for read in (stored_json.read_liked, stored_json.read_plays, stored_json.read_cache, stored_json.read_store_info):
            assert read(spark, at(name)).count() == 0


def test_scratch_tables_go_to_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark).startswith(base) and shared_dir(spark) != shared_dir(spark)


def test_snapshots(spark, rows, tmp_path):
    tables, schema = TableStore(spark, str(tmp_path / "t")), "a bigint"
    assert tables.read("x", schema).count() == 0 and tables.clear("x", schema) == 0
    first = tables.publish(spark.range(5).toDF("a"), "x")
    before = tables.read("x", schema)
    assert (first.snapshot, first.n) == (1, 5)
    # A table may be rewritten from itself: the old folder stays.
    tables.publish(tables.read("x", schema).where("a > 2"), "x")
    added = tables.publish(spark.range(9, 10).toDF("a"), "x", append=True)
    assert added.n == 3 and rows(tables.read("x", schema)) == [(3,), (4,), (9,)]
    assert before.count() == 5
    assert len(tables.compact("x", schema).paths) == 1
    assert rows(tables.read("x", schema)) == [(3,), (4,), (9,)]
    tables.publish(spark.range(2).toDF("a"), "x", part="p")
    assert rows(tables.read_parts("x", schema)) == [(0,), (1,), (3,), (4,), (9,)]
    assert rows(tables.current(), "name", "part", "n") == [("x", "", 3), ("x", "p", 2)]
    assert tables.clear("x", schema) == 3 and tables.read("x", schema).count() == 0
    assert tables.read("x", schema, "p").count() == 2


def test_sources_and_union(spark, rows):
    liked = spark.createDataFrame(
        [(0, "1", "Rain", ["Ann"], "L", 5), (1, "2", "Sun", [], "L", 6)],
        "seq bigint, id string, name string, artists array<string>, album string, duration_ms bigint",
    )
    plays = spark.createDataFrame(
        [(0, "rain ", "ANN", "P", True), (1, "Moon", "Bo", "P", False), (2, "moon", "bo", "Q", False)],
        "seq bigint, name string, artist string, album string, now_playing boolean",
    )
    assert rows(with_artist(liked, "spotify"), "primary_artist") == [("",), ("Ann",)]
    with pytest.raises(ValueError, match="not tape"):
        with_artist(liked, "tape")
    unique = unique_plays(plays)
    assert rows(unique, "seq", "name") == [(0, "rain "), (1, "Moon")]
    got = both_sources(liked, unique)
    assert rows(got, "source", "name", "artists", "album", "duration_ms") == [
        ("lastfm", "Moon", ["Bo"], "P", None), ("spotify", "Rain", ["Ann"], "L", 5), ("spotify", "Sun", [], "L", 6),
    ]
    order = [r.name for r in got.orderBy("seq").collect()]
    assert order == ["Rain", "Sun", "Moon"]


def test_pages_that_cannot_be_read_are_named(spark, rows):
    sound = json.dumps({"items": [saved("1")]})
    given = [(1, sound), (2, sound[:30]), (3, '{"error": {"status": 429}}'), (None, sound), (5, None), (6, '{"items": []}')]
    df = spark.createDataFrame(given, schemas.PAGE)
    assert rows(landed.rejected_liked(df), "page", "reason") == sorted([
        (2, "no list of songs"), (3, 'error {"status":429}'), (None, "no page number"), (5, "no list of songs"),
    ], key=repr)
    assert rows(landed.normalize_liked(df), "seq", "id") == [(1 << 32, "1")]
    lone = json.dumps(plays_page(play("a")))
    df = spark.createDataFrame([(1, lone), (2, lone[:-3]), (3, '{"error": 6}'), (None, lone)], schemas.PAGE)
    assert rows(landed.rejected_plays(df), "page", "reason") == sorted([
        (2, "no list of songs"), (3, "error 6"), (None, "no page number"),
    ], key=repr)
    assert landed.normalize_plays(df).count() == 1


def test_a_failed_write_blocks_nothing(spark, rows, tmp_path):
    store = TableStore(spark, str(tmp_path))
    one = spark.createDataFrame([(1,)], "a int")
    store.publish(one, "t")
    with pytest.raises(Exception, match="broken"):
        store.publish(one.selectExpr("if(a = 1, raise_error('broken'), a) as a"), "t")
    assert rows(store.read("t", "a int")) == [(1,)]
    store.publish(spark.createDataFrame([(2,)], "a int"), "t")
    store.publish(spark.createDataFrame([(3,)], "a int"), "t", append=True)
    store.publish(one, "u", "p")
    folders = lambda: len(list((tmp_path / "t").glob("snapshot=*")))
    before = folders()
    assert before >= 3 and store.vacuum() == before - 2 and folders() == 2
    assert rows(store.read("t", "a int")) == [(2,), (3,)] and rows(store.read("u", "a int", "p")) == [(1,)]
    assert store.vacuum() == 0
