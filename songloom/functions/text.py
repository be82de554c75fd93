"""Column functions over names, lyrics and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType

# Patterns, sentences and lengths that results depend on.
# Every character that counts as whitespace: controls, space, NEL, NBSP, Unicode spaces.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WORD_BREAK = r"[^\p{L}\p{N}]+"
KEY_SEPARATOR = "||"
INSTRUMENTAL_SENTENCE = "This is an instrumental track with no vocals or lyrics."
PREVIEW_CHARS = 200
PREVIEW_LINES = 6


def strip(text: Column) -> Column:
    """Cut Unicode whitespace at both ends (``trim`` only knows the space)."""
    return F.btrim(text, F.lit(WHITESPACE))


def non_empty(text: Column) -> Column:
    """True for text that is neither NULL nor ''."""
    return F.coalesce(text, F.lit("")) != ""


def song_key(track: Column, artist: Column) -> Column:
    """The identity of a song: track and artist, trimmed and lower-cased."""
    half = [F.coalesce(F.lower(strip(part)), F.lit("")) for part in (track, artist)]
    return F.concat(half[0], F.lit(KEY_SEPARATOR), half[1])


def first_artist(artists: Column) -> Column:
    """First name of an artist list, '' if there is none."""
    return F.coalesce(F.get(artists, F.lit(0)), F.lit(""))


def field(df: DataFrame, *names: str) -> Column:
    """The first of ``names`` that is set; lists of names become one text."""
    found = []
    for name in names:
        if name in df.columns:
            value = F.col(name)
            if isinstance(df.schema[name].dataType, ArrayType):
                value = F.array_join(value, ", ")
            found.append(value)
    return F.coalesce(*found, F.lit(""))


def words(text: Column) -> Column:
    """Lower-cased letter and digit runs of a text."""
    return F.array_remove(F.split(F.lower(text), WORD_BREAK), "")


def document_preview(document: Column) -> Column:
    """The head of a document, with dots where something was cut."""
    head = F.concat(F.left(document, F.lit(PREVIEW_CHARS)), F.lit("..."))
    return F.when(F.length(document) > PREVIEW_CHARS, head).otherwise(document)


def lyric_lines(lyrics: Column) -> Column:
    return F.split(strip(lyrics), "\n")


def lyric_preview(lyrics: Column) -> Column:
    """The first lines of the trimmed lyrics; NULL where there are none."""
    head = F.array_join(F.slice(lyric_lines(lyrics), 1, PREVIEW_LINES), "\n")
    return F.when(non_empty(lyrics), head)


def further_lines(lyrics: Column) -> Column:
    """How many lines the preview leaves out."""
    left = F.greatest(F.size(lyric_lines(lyrics)) - PREVIEW_LINES, F.lit(0))
    return F.when(non_empty(lyrics), left).otherwise(F.lit(0))


def lyric_status(instrumental: Column, found: Column) -> Column:
    """Label of an enriched song."""
    return (
        F.when(instrumental, "[instrumental]").when(found, "[found]").otherwise("[missing]")
    )


def has_lyrics_label(lyrics: Column) -> Column:
    return F.when(non_empty(lyrics), "yes").otherwise("no")


def instrumental_tag(instrumental: Column) -> Column:
    return F.when(instrumental, "[instrumental]").otherwise("")


def query_text(parts: Column) -> Column:
    """Words of a query as one text."""
    return F.array_join(parts, " ")


def fetch_date(iso_time: Column) -> Column:
    """Day of an ISO time."""
    return F.left(iso_time.cast("string"), F.lit(10))
