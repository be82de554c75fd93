"""Declared schemas of everything that is read; nothing is inferred.

``seq`` is the row order of the source as data. Every order-dependent operator sorts by
it, because Spark rows have no order of their own.
"""

# Landed pages: page number and the service response as JSON text.
PAGE = "page bigint, body string"

# Pages that could not be read.
REJECTED = "page bigint, body string, reason string"

# Bodies of the two song services.
LIKED_BODY = (
    "items array<struct<added_at:string, track:struct<"
    "id:string, name:string, artists:array<struct<name:string>>, album:struct<name:string>,"
    " duration_ms:bigint, external_urls:struct<spotify:string>>>>"
)
PLAYS_BODY = "recenttracks struct<`@attr`:struct<total:string, totalPages:string>, track:string>"
PLAYS_TRACKS = (
    "array<struct<name:string, artist:struct<`#text`:string>, album:struct<`#text`:string>,"
    " date:struct<uts:string, `#text`:string>, `@attr`:struct<nowplaying:string>, url:string>>"
)

# One record of the lyrics service, as landed.
LYRIC_RECORD = (
    "id bigint, trackName string, name string, artistName string, albumName string,"
    " duration double, instrumental boolean, plainLyrics string, syncedLyrics string"
)

LIKED = (
    "seq bigint, id string, name string, artists array<string>, album string,"
    " added_at string, added_ts timestamp, duration_ms bigint, spotify_url string"
)
PLAYS = (
    "seq bigint, name string, artist string, album string, timestamp string,"
    " played_at timestamp, date_text string, now_playing boolean, lastfm_url string"
)
LYRICS = (
    "id bigint, name string, artist string, album string, duration double,"
    " instrumental boolean, plain_lyrics string, synced_lyrics string"
)
KEYED_LYRICS = f"{LYRICS}, key string"
CACHE = (
    "key string, track_name string, artist_name string, plain_lyrics string,"
    " synced_lyrics string, instrumental boolean, lyrics_found boolean"
)
INDEX = (
    "id string, model string, document string, embedding array<float>, norm double,"
    " track_name string, artist_name string, album string, instrumental boolean,"
    " has_lyrics boolean, digest string"
)
MANIFEST = (
    "name string, part string, snapshot bigint, paths array<string>, fetched_at timestamp, n bigint"
)

# The JSON files that a single-machine library keeps.
STORED_LIKED = (
    "source string, fetched_at string, count bigint, songs array<struct<"
    "id:string, name:string, artists:array<string>, album:string, added_at:string,"
    " duration_ms:bigint, spotify_url:string>>"
)
STORED_PLAYS = (
    "source string, fetched_at string, count bigint, songs array<struct<"
    "name:string, artist:string, album:string, timestamp:string, date_text:string,"
    " now_playing:boolean, lastfm_url:string>>"
)
STORED_CACHE = (
    "map<string, struct<track_name:string, artist_name:string, plain_lyrics:string,"
    " synced_lyrics:string, instrumental:boolean, lyrics_found:boolean>>"
)
