"""One schema from the tags of several file formats, given as a map of arrays, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_VORBIS = {
    "artists": ("ARTIST",), "albumartist": ("ALBUMARTIST",), "album": ("ALBUM",), "title": ("TITLE",), "genre": ("GENRE",),
    "date": ("DATE",), "track": ("TRACKNUMBER",), "location": ("LOCATION", "VENUE"),
}
_ID3 = {"artists": ("TPE1",), "albumartist": ("TPE2",), "album": ("TALB",), "title": ("TIT2",), "genre": ("TCON",), "date": ("TDRC", "TYER"), "track": ("TRCK",)}
_PLAIN = {"artists": ("TPE1",), "album": ("TALB",), "title": ("TIT2",)}
_MP4 = {"artists": ("©ART",), "albumartist": ("aART",), "album": ("©alb",), "title": ("©nam",), "genre": ("©gen",), "date": ("©day",), "track": ("trkn",)}
_ASF = {
    "artists": ("Author", "Artist"), "albumartist": ("AlbumArtist",), "album": ("AlbumTitle", "Album"), "title": ("Title",),
    "genre": ("Genre",), "date": ("Year", "ReleaseDate"), "track": ("TrackNumber",),
}
_APE = {
    "artists": ("Artist", "Author"), "albumartist": ("Album Artist", "AlbumArtist"), "album": ("Album",), "title": ("Title",),
    "genre": ("Genre",), "date": ("Year", "Release Date"), "track": ("Track",),
}
#: Where each format's files keep each field; of several keys the first that is there counts.
KEYS = {"flac": _VORBIS, "ogg": _VORBIS, "opus": _VORBIS, "mp3": _ID3, "m4a": _MP4, "mp4": _MP4, "wav": _PLAIN, "aiff": _PLAIN, "wma": _ASF, "ape": _APE}
#: Formats whose artists are split at commas, whose date is kept as text, and keys of pictures.
SPLIT, DATED = ("flac", "ogg", "opus", "ape"), ("flac", "ogg", "opus")
COVERS = {"mp3": "APIC:", "m4a": "covr", "mp4": "covr"}
#: A format that takes a track number only if nothing else is in the field.
STRICT = ("wma",)


def _values(kind: Column, tags: Column, field: str) -> Column:
    """The values under the first key of the field that the format has and that is not empty."""
    out = F.lit(None).cast("array<string>")
    for name, keys in KEYS.items():
        if field in keys:
            found = [F.when(F.size(F.element_at(tags, F.lit(key))) > 0, F.element_at(tags, F.lit(key))) for key in keys[field]]
            out = F.when(kind == name, F.coalesce(*found)).otherwise(out)
    return out


def normalized_tags(kind: Column, tags: Column) -> dict[str, Column]:
    """artists, primary_artist, album, title, genre, year, date, track_number, location and has_cover of files of a `kind`
    (a suffix) with `tags`, a map from keys to arrays of values.

    primary_artist is the album's artist, else the first one; year the four digits that the date begins with; track_number
    the digits that its field begins with. An unknown kind has no fields, and null or empty tags give nulls."""
    kind = F.lower(kind)
    first = lambda field: F.nullif(F.get(_values(kind, tags, field), F.lit(0)), F.lit(""))
    raw = _values(kind, tags, "artists")
    parts = F.array_distinct(F.flatten(F.transform(raw, lambda a: F.when(a.contains(","), F.filter(F.transform(F.split(a, ","), lambda p: F.trim(p)), lambda p: p != "")).otherwise(F.array(a)))))
    artists = F.when(kind.isin(*SPLIT), parts).otherwise(raw)
    number = F.when(kind.isin(*STRICT), F.regexp_extract(first("track"), "^\\s*([+-]?\\d+)\\s*$", 1)).otherwise(F.regexp_extract(first("track"), "^(\\d+)", 1))
    cover = F.lit(False)
    for name, key in COVERS.items():
        cover = F.when(kind == name, F.coalesce(F.map_contains_key(tags, key), F.lit(False))).otherwise(cover)
    return {
        "artists": artists,
        "primary_artist": F.coalesce(first("albumartist"), F.get(artists, F.lit(0))),
        "album": first("album"),
        "title": first("title"),
        "genre": first("genre"),
        "year": F.regexp_extract(first("date"), "^(\\d{4})", 1).try_cast("int"),
        "date": F.when(kind.isin(*DATED), first("date")),
        "track_number": number.try_cast("int"),
        "location": first("location"),
        "has_cover": cover,
    }
