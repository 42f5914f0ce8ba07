"""Queries over the given tables, by inventory id, and their equivalents in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shellac.functions import tags
from shellac.operators import curation, statistics
from shellac.sources import catalog

Query = Callable[[SparkSession, str], DataFrame]


def of_tracks(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(catalog.tracks(spark, sf_dir))


def _of_inventories(operator: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(
        catalog.view(spark, sf_dir, catalog.INVENTORY_PREV_SQL), catalog.view(spark, sf_dir, catalog.INVENTORY_CUR_SQL)
    )


def of_log(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(catalog.view(spark, sf_dir, catalog.OP_LOG_SQL))


def _columns(columns: Callable[[], dict[str, Column]]) -> Query:
    """Computed columns beside the id; they are made only when the query is, since that needs a session."""
    return of_tracks(lambda t: t.select("recording_id", *[c.alias(n) for n, c in columns().items()]))


_T = f"WITH tracks AS ({catalog.TRACKS_SQL}) "
_A = f"WITH tracks AS ({catalog.TRACKS_SQL}), artists AS (SELECT *, unnest(list_distinct(string_split(artists_raw, ', '))) AS artist FROM tracks) "
_I = f"WITH p AS ({catalog.INVENTORY_PREV_SQL}), c AS ({catalog.INVENTORY_CUR_SQL}) "
_L = (
    f"WITH op_log AS ({catalog.OP_LOG_SQL}), latest AS (SELECT * FROM op_log "
    "QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, record DESC) = 1) "
)
_KEY = "md5(concat_ws('|', lower(trim(primary_artist)), lower(trim(title)), lower(trim(album)), CAST(coalesce(track_number, 0) AS VARCHAR)))"
_RANK = "CASE file_type WHEN 'flac' THEN 10 WHEN 'wav' THEN 9 WHEN 'm4a' THEN 6 WHEN 'mp3' THEN 5 WHEN 'ogg' THEN 3 WHEN 'wma' THEN 2 ELSE 0 END"
_QUALITY = (
    f"round(0.4::DOUBLE * {_RANK} + 0.25::DOUBLE * (least(1.0::DOUBLE, coalesce(bitrate, 0) / 3200) * 10) + 0.15::DOUBLE * (least(1.0::DOUBLE, sample_rate / 192000) * 10) "
    "+ 0.1::DOUBLE * ((4 + (year IS NOT NULL)::INT + (genre IS NOT NULL)::INT) / 6 * 10) + 0.1::DOUBLE * (least(1.0::DOUBLE, size_bytes / 104857600) * 10), 6)"
)
_SHARE = "SELECT value, count(*) AS tracks, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM (SELECT {} AS value FROM tracks) WHERE value IS NOT NULL GROUP BY value"

#: name: (query, SQL)
PAIRS: dict[str, tuple[Query, str]] = {
    "b2_split_artists": (
        _columns(lambda: dict(artists=F.array_join(tags.split_artists(F.col("artists_raw")), "|"))),
        _T + "SELECT recording_id, replace(artists_raw, ', ', '|') AS artists FROM tracks",
    ),
    "b3_clean_artist": (
        _columns(lambda: dict(artist=tags.clean_artist(F.col("primary_artist")))),
        _T + "SELECT recording_id, regexp_replace(primary_artist, '^The ', '') AS artist FROM tracks",
    ),
    "b5_standard_genre": (
        _columns(lambda: dict(genre=tags.standard_genre(F.col("genre")))),
        _T + "SELECT recording_id, CASE genre WHEN 'electronica' THEN 'Electronic' WHEN 'rock, pop' THEN 'Rock, Pop' ELSE genre END AS genre FROM tracks",
    ),
    "b9_sort_name": (
        _columns(lambda: dict(sort_name=tags.sort_name(F.col("primary_artist")), letter=tags.first_letter(F.col("primary_artist")))),
        _T + "SELECT recording_id, CASE WHEN starts_with(primary_artist, 'The ') THEN concat(substr(primary_artist, 5), ', The') ELSE primary_artist END AS sort_name, "
        "upper(substr(regexp_replace(primary_artist, '^The ', ''), 1, 1)) AS letter FROM tracks",
    ),
    "b12_identity_key": (
        _columns(lambda: dict(key=tags.identity_key(F.col("primary_artist"), F.col("title"), F.col("album"), F.col("track_number")))),
        _T + f"SELECT recording_id, {_KEY} AS key FROM tracks",
    ),
    "b17_completeness": (
        _columns(lambda: dict(score=F.round(tags.completeness([F.col(c) for c in ("title", "primary_artist", "album", "year", "genre", "track_number", "bitrate", "disc_number", "duration_seconds")]), 6))),
        _T + "SELECT recording_id, round((4 + (year IS NOT NULL)::INT + (genre IS NOT NULL)::INT + 0.5 * (2 + (bitrate IS NOT NULL)::INT)) / 7.5, 6) AS score FROM tracks",
    ),
    "c2_by_artist": (
        of_tracks(lambda t: curation.by_artist(t, "supplier#000000003")),
        _T + "SELECT recording_id, title FROM tracks WHERE list_contains(string_split(lower(artists_raw), ', '), 'supplier#000000003')",
    ),
    "c4_search": (
        of_tracks(lambda t: curation.search(t, "greatest hits")),
        _T + "SELECT recording_id, score FROM (SELECT recording_id, "
        + " + ".join(f"CASE WHEN lower({c}) = 'greatest hits' THEN 100 WHEN contains(lower({c}), 'greatest hits') THEN 10 ELSE 0 END" for c in ("title", "primary_artist", "album"))
        + " AS score FROM tracks) WHERE score > 0 ORDER BY score DESC, recording_id LIMIT 20",
    ),
    "d7_usual_genre": (
        of_tracks(statistics.usual_genre),
        _T + "SELECT primary_artist, genre FROM tracks WHERE genre IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY primary_artist ORDER BY count(*) DESC, genre) = 1",
    ),
    "d8_collaborators": (
        of_tracks(statistics.collaborators),
        _A + "SELECT a.artist, b.artist AS other, count(DISTINCT a.recording_id) AS tracks FROM artists a JOIN artists b USING (recording_id) WHERE a.artist <> b.artist GROUP BY 1, 2",
    ),
    "d9_detect_changes": (
        _of_inventories(curation.detect_changes),
        _I + "SELECT path, CASE WHEN p.size IS NULL THEN 'new' WHEN c.size IS NULL THEN 'removed' WHEN p.size = c.size AND p.mtime = c.mtime THEN 'unchanged' ELSE 'modified' END AS change FROM p FULL JOIN c USING (path)",
    ),
    "f1_duplicates_by_tags": (
        of_tracks(curation.duplicates_by_tags),
        _T + f"SELECT {_KEY} AS key, count(*) AS tracks, min(recording_id) AS first FROM tracks GROUP BY 1 HAVING count(*) > 1",
    ),
    "f4_duplicates_by_size": (
        of_tracks(curation.duplicates_by_size),
        _T + "SELECT size_bytes, count(*) AS tracks FROM tracks GROUP BY 1 HAVING count(*) > 1",
    ),
    "f13_quality_score": (of_tracks(curation.quality_score), _T + f"SELECT recording_id, {_QUALITY} AS quality FROM tracks"),
    "f14_keep_best": (
        of_tracks(curation.keep_best),
        _T + f"SELECT recording_id, key, CASE WHEN row_number() OVER (PARTITION BY key ORDER BY quality DESC, recording_id) = 1 THEN 'keep' ELSE 'delete' END AS action "
        f"FROM (SELECT recording_id, {_KEY} AS key, {_QUALITY} AS quality FROM tracks) QUALIFY count(*) OVER (PARTITION BY key) > 1",
    ),
    "g1_library_stats": (
        of_tracks(statistics.library_stats),
        _A + "SELECT count(*) AS tracks, count(DISTINCT (primary_artist, album)) AS albums, CAST(sum(size_bytes) AS BIGINT) AS bytes, CAST(sum(duration_seconds) AS BIGINT) AS seconds, "
        "round(avg(bitrate), 6) AS avg_bitrate, (SELECT count(DISTINCT lower(artist)) FROM artists) AS artists FROM tracks",
    ),
    "g2_format_distribution": (of_tracks(lambda t: statistics.distribution(t, F.col("file_type"))), _T + _SHARE.format("file_type")),
    "g3_genre_distribution": (
        of_tracks(statistics.genre_distribution),
        _T + "SELECT genre, count(*) AS tracks FROM (SELECT trim(unnest(string_split(genre, ','))) AS genre FROM tracks) WHERE genre <> '' GROUP BY 1",
    ),
    "g4_decade_distribution": (
        of_tracks(lambda t: statistics.distribution(t, tags.decade(F.col("year")))),
        _T + _SHARE.format("CAST(CAST(floor(year / 10) * 10 AS BIGINT) AS VARCHAR) || 's'"),
    ),
    "g5_top_artists": (
        of_tracks(statistics.top_artists),
        _T + "SELECT primary_artist, count(*) AS tracks FROM tracks GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    ),
    "g6_quality_distribution": (
        of_tracks(lambda t: statistics.distribution(t, tags.bitrate_band(F.col("bitrate")))),
        _T + _SHARE.format("CASE WHEN bitrate IS NULL THEN 'unknown' WHEN bitrate >= 320 THEN '320+' WHEN bitrate >= 256 THEN '256-319' WHEN bitrate >= 192 THEN '192-255' WHEN bitrate >= 128 THEN '128-191' ELSE 'below 128' END"),
    ),
    "g9_artist_stats": (
        of_tracks(statistics.artist_stats),
        _A + "SELECT artist, count(*) AS tracks, count(DISTINCT album) AS releases, CAST(sum(duration_seconds) AS BIGINT) AS seconds, min(year) AS first_year, max(year) AS last_year, "
        "coalesce(string_agg(DISTINCT genre, '|' ORDER BY genre), '') AS genres FROM artists GROUP BY 1",
    ),
    "g15_releases": (
        of_tracks(statistics.releases),
        _T + "SELECT primary_artist, album, count(*) AS tracks, CAST(sum(duration_seconds) AS BIGINT) AS seconds, CAST(sum(size_bytes) AS BIGINT) AS bytes, min(year) AS year FROM tracks GROUP BY 1, 2",
    ),
    "h7_track_order": (
        of_tracks(curation.track_order),
        _T + "SELECT recording_id, CAST(row_number() OVER (PARTITION BY primary_artist, album ORDER BY track_number, lower(title), recording_id) AS INT) AS place FROM tracks",
    ),
    "h9_latest_operations": (of_log(curation.latest_operations), _L + "SELECT id, session_id, operation_type, status, file_size FROM latest"),
    "h10_session_counters": (
        of_log(curation.session_counters),
        _L + "SELECT session_id, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, CAST(sum(file_size) AS BIGINT) AS bytes FROM latest GROUP BY 1",
    ),
    "i3_top_releases": (
        of_tracks(statistics.top_releases),
        _T + "SELECT primary_artist, album, count(*) AS tracks, CAST(row_number() OVER (PARTITION BY primary_artist ORDER BY count(*) DESC, album) AS INT) AS place FROM tracks GROUP BY 1, 2 QUALIFY place <= 3",
    ),
    "j2_removed_paths": (_of_inventories(curation.removed_paths), _I + "SELECT path FROM p WHERE path NOT IN (SELECT path FROM c)"),
}

QUERIES: dict[str, Query] = {name: query for name, (query, _) in PAIRS.items()}
ORACLE_SQL: dict[str, str] = {name: sql for name, (_, sql) in PAIRS.items()}
