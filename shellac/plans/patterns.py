"""Queries on patterns, whole plans and resolution by strategy, and their equivalents in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellac.operators import curation, organizing, patterns
from shellac.plans.queries import _KEY, _QUALITY, _T, Query, of_tracks
from shellac.tables import written

RULES = [
    patterns.PathRule("old jazz", patterns.Pattern("decade"), 5, genres=("jazz",), years=(1900, 1979)),
    patterns.PathRule("lossless", patterns.Pattern("genre", space=" "), 3, types=("flac", "wav")),
    patterns.PathRule("one artist", patterns.Pattern("artist"), 4, artists=("000000003",)),
    patterns.PathRule("off", patterns.Pattern("flat"), 9, enabled=False),
    patterns.PathRule("rest", patterns.Pattern("custom", "{if:year}{year}/{endif}{album}", "{title} by {artist}{file_extension}"), 0, types=("mp3", "ogg")),
]


def _levels(tracks: DataFrame) -> DataFrame:
    values = patterns.values_of()
    return tracks.select("recording_id", *[patterns.pattern_path(patterns.Pattern(level), values).alias(level) for level in patterns.LEVELS])


def _planned(tracks: DataFrame) -> DataFrame:
    """Rows in folders by rules; of those, files of the first discs are there already."""
    # written, since what is there comes from the same joins and routes
    routes = written(patterns.routed(tracks, RULES, "/lib/", ("disc_number",)))
    first = routes.filter("disc_number = 1").select("target").distinct()
    return patterns.planned(routes, first).select("recording_id", "source", "target", "rule", "conflict", "action")


def _identical(tracks: DataFrame) -> DataFrame:
    """All to folders by artist, where the largest file of each name is: files like it stay."""
    target = F.concat(F.lit("/lib/"), F.col("primary_artist"), F.lit("/"), F.col("title"))
    # written, since the files and what is there come from the same joins
    tracks = written(tracks.select("recording_id", "primary_artist", "title", "size_bytes", "created_at"))
    rows = tracks.select("recording_id", target.alias("target"), F.col("size_bytes").alias("size"), F.col("created_at").alias("mtime"), F.lit(None).cast("string").alias("checksum"))
    there = rows.groupBy("target").agg(F.max("size").alias("size"), F.max_by("mtime", "size").alias("mtime")).withColumn("checksum", F.lit(None).cast("string"))
    plan = rows.select("*", F.lit(True).alias("conflict"), F.lit(None).cast("string").alias("final"), F.lit("skip").alias("strategy"))
    return organizing.resolve_conflicts(organizing.identical_to_target(plan, None, there), "x").select("recording_id", "action", "final")


def _clean(text: str, space: str = "_") -> str:
    bare = f"replace(translate({text}, '/<>:\"|?*', '_'), ' ', '{space}')"
    return f"regexp_replace(regexp_replace({bare}, '[_-]+', '_', 'g'), '^[_-]+|[_-]+$', '', 'g')"


def _joined(*parts: str) -> str:
    return f"array_to_string(list_filter([{', '.join(parts)}], lambda p: p <> ''), '/')"


_ARTIST, _ALBUM = _clean("string_split(artists_raw, ', ')[1]"), _clean("album")
_FILE = _clean("lpad(CAST(track_number AS VARCHAR), 2, '0') || ' ' || title || '.' || file_type")
_DECADE = _clean("coalesce(CAST(CAST(floor(year / 10) * 10 AS INT) AS VARCHAR) || 's', '')")
_PATHS = {
    "flat": _joined(_clean("string_split(artists_raw, ', ')[1] || ' - ' || title || '.' || file_type")),
    "artist": _joined(_ARTIST, _ALBUM, _FILE),
    "genre": _joined(_clean("coalesce(genre, '')"), _ARTIST, _ALBUM, _FILE),
    "year": _joined("coalesce(CAST(year AS VARCHAR), '')", _ARTIST, _ALBUM, _FILE),
    "decade": _joined(_DECADE, _ARTIST, _ALBUM, _FILE),
}
_GENRE = _joined(*[_clean(c, " ") for c in ("coalesce(genre, '')", "string_split(artists_raw, ', ')[1]", "album", "lpad(CAST(track_number AS VARCHAR), 2, '0') || ' ' || title || '.' || file_type")])
_REST = _joined("coalesce(CAST(year AS VARCHAR), '')", _ALBUM, _clean("title || ' by ' || string_split(artists_raw, ', ')[1] || '.' || file_type"))
_CHOICE = (
    "CASE WHEN contains(lower(coalesce(genre, 'jazz')), 'jazz') AND coalesce(year, 1900) <= 1979 THEN 'old jazz' WHEN contains(lower(artists_raw), '000000003') THEN 'one artist' "
    "WHEN file_type IN ('flac', 'wav') THEN 'lossless' WHEN file_type IN ('mp3', 'ogg') THEN 'rest' END"
)
_ORDER = "ord1, ord2, recording_id"
_FILLED = "(3 + (year IS NOT NULL)::INT + (genre IS NOT NULL)::INT)"
_CONTENT = "md5(concat_ws('|', title, primary_artist, CAST(CAST(duration_seconds AS BIGINT) AS VARCHAR)))"


def _resolved(order: str) -> str:
    return (
        f"{_T[:-1]}, k AS (SELECT *, {_KEY} AS key, {_QUALITY} AS quality, {_FILLED} AS filled, {_CONTENT} AS content, len(string_split(path, '/')) AS parts FROM tracks), "
        "s AS (SELECT *, count(*) OVER w AS n, min(content) OVER w = max(content) OVER w AS exact, max(filled) OVER w AS fullest FROM k WINDOW w AS (PARTITION BY key)) "
        f"SELECT recording_id, key, CASE WHEN row_number() OVER (PARTITION BY key ORDER BY {order}) = 1 THEN 'keep' ELSE 'move' END AS action FROM s WHERE n > 1"
    )


#: name: (query, SQL)
PAIRS: dict[str, tuple[Query, str]] = {
    "l4_pattern_paths": (of_tracks(_levels), _T + "SELECT recording_id, " + ", ".join(f"{sql} AS {level}" for level, sql in _PATHS.items()) + " FROM tracks"),
    "l7_plan_organization": (
        of_tracks(_planned),
        _T[:-1] + f", r AS (SELECT *, {_CHOICE} AS rule FROM tracks), p AS MATERIALIZED (SELECT recording_id, disc_number, path AS source, rule, '/lib/' || CASE rule WHEN 'old jazz' THEN {_PATHS['decade']} "
        f"WHEN 'one artist' THEN {_PATHS['artist']} WHEN 'lossless' THEN {_GENRE} ELSE {_REST} END AS target FROM r WHERE rule IS NOT NULL), "
        "c AS (SELECT *, target IN (SELECT target FROM p WHERE disc_number = 1) OR row_number() OVER (PARTITION BY target ORDER BY recording_id) > 1 AS conflict FROM p) "
        "SELECT recording_id, source, target, rule, conflict, CASE WHEN conflict THEN 'resolve' ELSE 'move' END AS action FROM c",
    ),
    "l8_identical_files": (
        of_tracks(_identical),
        _T[:-1] + ", t AS (SELECT primary_artist, title, max(size_bytes) AS size, arg_max(created_at, size_bytes) AS changed FROM tracks GROUP BY 1, 2) SELECT recording_id, "
        "CASE WHEN size_bytes = size AND created_at = changed THEN 'identical' ELSE 'skip' END AS action, CAST(NULL AS VARCHAR) AS final FROM tracks JOIN t USING (primary_artist, title)",
    ),
    "f14_keep_first": (of_tracks(lambda t: curation.resolve_duplicates(t, "first", move=True)), _resolved(_ORDER)),
    "f14_keep_smart": (
        of_tracks(lambda t: curation.resolve_duplicates(t, "smart", move=True)),
        _resolved(f"CASE WHEN exact THEN parts WHEN fullest >= 4 THEN -filled ELSE -quality END, {_ORDER}"),
    ),
}
