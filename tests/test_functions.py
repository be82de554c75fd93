from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from songloom.functions import text as tx
from songloom.functions.times import iso_time, unix_time, whole_seconds
from songloom.functions.vectors import cosine, dot, match_percent, norm


def one(spark, value, build, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(build(F.col("x"))).first()[0]


def test_strip_and_key_equal_python(spark):
    names = [
        "Rain", "\t Rain ", "ANN ", "　Rain\xa0", "\x85\x1cRain\x1f", "​Rain", "Rain  Song",
        "a||b", "", "  ", "Straße", "İstanbul", "ΟΔΟΣ ", " x ", "日本 ", "﻿x",
    ]
    df = spark.createDataFrame([(n,) for n in names], "x string")
    got = df.select("x", tx.strip(F.col("x")), tx.song_key(F.col("x"), F.lit(" B "))).collect()
    for raw, stripped, key in got:
        assert stripped == raw.strip()
        assert key == raw.strip().lower() + "||b"


def test_key_keeps_separator_when_a_name_is_missing(spark):
    df = spark.range(1)
    none = F.lit(None).cast(StringType())
    assert df.select(tx.song_key(none, F.lit("A"))).first()[0] == "||a"
    assert df.select(tx.song_key(F.lit("T"), none)).first()[0] == "t||"


def test_first_artist(spark):
    for artists, first in ((["a", "b"], "a"), ([], ""), (None, "")):
        assert one(spark, artists, tx.first_artist, "array<string>") == first


def test_field_takes_the_first_set_column_and_joins_lists(spark):
    df = spark.createDataFrame([(None, "n", ["a", "b"])], "track_name string, name string, artist array<string>")
    got = df.select(tx.field(df, "track_name", "name"), tx.field(df, "artist_name", "artist"), tx.field(df, "album"))
    assert tuple(got.first()) == ("n", "a, b", "")


def test_document_preview_cuts_after_200_characters(spark):
    assert one(spark, "ü" * 200, tx.document_preview) == "ü" * 200
    assert one(spark, "ü" * 201, tx.document_preview) == "ü" * 200 + "..."


def test_lyric_preview(spark):
    eight = "\n a\n\nb\nc\nd\ne\nf\ng \n"
    lines = eight.strip().split("\n")
    assert one(spark, eight, tx.lyric_preview) == "\n".join(lines[:6])
    assert one(spark, eight, tx.further_lines) == len(lines) - 6
    assert one(spark, "x", tx.further_lines) == 0
    assert one(spark, "", tx.lyric_preview) is None
    assert one(spark, None, tx.further_lines) == 0


def test_labels(spark):
    df = spark.createDataFrame(
        [(True, True), (True, False), (False, True), (False, False)], "i boolean, f boolean"
    )
    got = [r[0] for r in df.select(tx.lyric_status(F.col("i"), F.col("f"))).collect()]
    assert got == ["[instrumental]", "[instrumental]", "[found]", "[missing]"]
    assert one(spark, "", tx.has_lyrics_label) == "no"
    assert one(spark, " ", tx.has_lyrics_label) == "yes"
    assert one(spark, True, tx.instrumental_tag, "boolean") == "[instrumental]"


def test_query_text_and_fetch_date(spark):
    assert one(spark, ["sad", "song"], tx.query_text, "array<string>") == "sad song"
    assert one(spark, "2025-01-02T03:04:05+00:00", tx.fetch_date) == "2025-01-02"


def test_words_are_letter_and_digit_runs(spark):
    assert one(spark, "Don't stop—Été 99!", tx.words) == ["don", "t", "stop", "été", "99"]
    assert one(spark, " .. ", tx.words) == []


def test_times(spark):
    assert one(spark, "1700000000", lambda c: F.date_format(unix_time(c), "yyyy-MM-dd HH:mm")) == "2023-11-14 22:13"
    assert one(spark, "soon", unix_time) is None
    assert one(spark, "soon", iso_time) is None
    for ms, seconds in ((215999, 215), (0, None), (None, None), (999, 0)):
        assert one(spark, ms, whole_seconds, "bigint") == seconds


def test_cosine_is_clamped_and_zero_for_zero_vectors(spark):
    df = spark.createDataFrame(
        [([1.0, 2.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0])],
        "a array<float>, b array<float>",
    )
    a, b = F.col("a"), F.col("b")
    got = [r[0] for r in df.select(cosine(dot(a, b), norm(a), norm(b))).collect()]
    assert got[0] <= 1.0 and abs(got[0] - 1) < 1e-9
    assert got[1:] == [0.0, -1.0]
    assert one(spark, 0.12345, match_percent, "double") == 12.3
