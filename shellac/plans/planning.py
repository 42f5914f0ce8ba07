"""Queries on rules, bulk edits and target paths, and their equivalents in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellac.functions import tags
from shellac.operators import edits, layout, rules
from shellac.operators.edits import Edit
from shellac.operators.rules import Condition, Rule
from shellac.plans.queries import Query, of_tracks
from shellac.sources import catalog

RULES = [
    Rule("compilation", (Condition("album", "matches", "greatest hits|soundtrack"),), 60, tags=("various",)),
    Rule("live", (Condition("title", "contains", "(live)"),), 100, tags=("live", "stage")),
    Rule("old jazz", (Condition("genre", "eq", "JAZZ"), Condition("year", "lt", 1980)), 80, tags=("stage",)),
    Rule("lossless", (Condition("bitrate", "ge", 256), Condition("file_type", "in", ("flac", "wav"))), 40),
    Rule("untagged", (Condition("genre", "is_empty"),), 10),
]

EDITS = [
    Edit("genre map", "genre", "rename", old="electronica", value="Electronic"),
    Edit("default genre", "genre", "set", value="Unknown", strategy="skip"),
    Edit("live mark", "title", "transform", pattern=r"s/ \(live\)$/ [Live]/i"),
    Edit("various", "artists", "add", value="Various", conditions=(Condition("album", "eq", "greatest hits"),)),
    Edit("old year", "year", "clear", conditions=(Condition("year", "lt", 1960),)),
    Edit("no wma", "file_type", "set", value="mp3", conditions=(Condition("file_type", "eq", "wma"),)),
]

#: Edits with what a plan's conditions can say: null, equal, contains, regular expression.
WHERE_EDITS = [
    Edit("no genre", "genre", "copy", source="album", where=(("genre", None),)),
    Edit("hits", "year", "set", value=1990, where=(("album", "Greatest Hits"), ("genre", {"contains": "rock"}))),
    Edit("tracks", "track_number", "transform", pattern=r"s/^(\d)$/10$1/", where=(("track_number", {"regex": "^[1-3]$"}), ("year", {"equals": 1990}))),
    edits.standardize_genre({"rock, pop": "Rock", "electronica": "Electronic"}),
    *edits.capitalize_fields(["title"]),
]

TEMPLATE = "{genre}/{primary_artist}/{if:year}{year} - {else}undated - {endif}{album}/{track_number} {title}.{file_type}"


def _tags(tracks: DataFrame) -> DataFrame:
    columns = ("recording_id", "title", "genre", "album", "year", "file_type")
    return tracks.select(*columns, tags.split_artists(F.col("artists_raw")).alias("artists"))


def _edited(tracks: DataFrame) -> DataFrame:
    out = edits.apply_edits(_tags(tracks), EDITS)
    return out.select("recording_id", "title", "genre", "year", "file_type", *[F.array_join(c, "|").alias(c) for c in ("artists", "applied")])


def _where_edited(tracks: DataFrame) -> DataFrame:
    out = edits.apply_edits(tracks.select("recording_id", "title", "genre", "album", "year", "track_number"), WHERE_EDITS)
    return out.withColumn("applied", F.array_join("applied", "|"))


def _undo(tracks: DataFrame) -> DataFrame:
    before = _tags(tracks)
    return edits.undo_log(before, edits.apply_edits(before, EDITS), "recording_id").select("recording_id", "title", "genre", "year", "file_type")


def _kind() -> Column:
    kind = F.when(F.col("title").contains("(Live)"), "live").when(F.col("album") == "Greatest Hits", "compilation")
    return kind.when(F.col("title").endswith(" Demo"), "rarity").when(F.col("artists_raw").contains(","), "collaboration").otherwise("studio")


def _targets(tracks: DataFrame) -> DataFrame:
    location = F.nullif(F.regexp_extract("album", "^Live at (.+)$", 1), F.lit(""))
    artists, date = tags.split_artists(F.col("artists_raw")), F.date_format("created_at", "yyyy-MM-dd")
    folder = layout.target_folder(_kind(), F.col("primary_artist"), artists, F.col("album"), F.col("year"), date, location)
    return tracks.select("recording_id", folder.alias("folder"), layout.target_file(F.col("track_number"), F.col("title"), F.col("file_type")).alias("file"))


def _moves(tracks: DataFrame) -> DataFrame:
    target = F.concat("album", F.lit("/"), "title", F.lit("."), "file_type")
    return layout.plan_moves(tracks.select("recording_id", target.alias("target")))


def _against_existing(tracks: DataFrame) -> DataFrame:
    target = F.concat("album", F.lit("/"), "title", F.lit("."), "file_type")
    placed = tracks.select("recording_id", "track_number", target.alias("target"))
    return layout.plan_moves(placed.filter("track_number <> 1"), placed.filter("track_number = 1"))


def _rendered(tracks: DataFrame) -> DataFrame:
    names = ("genre", "primary_artist", "year", "album", "track_number", "title", "file_type")
    return tracks.select("recording_id", layout.render_template(TEMPLATE, {n: F.col(n) for n in names}).alias("target"))


_T = f"WITH tracks AS ({catalog.TRACKS_SQL})"
_RULES = {
    "live": "contains(lower(title), '(live)')",
    "old jazz": "(coalesce(genre, '') = 'Jazz' AND coalesce(year < 1980, false))",
    "compilation": "regexp_matches(lower(album), 'greatest hits|soundtrack')",
    "lossless": "(coalesce(bitrate >= 256, false) AND file_type IN ('flac', 'wav'))",
    "untagged": "genre IS NULL",
}
_FIRST = "CASE " + " ".join(f"WHEN {sql} THEN '{name}'" for name, sql in _RULES.items()) + " END"
_ALL = "concat_ws('|', " + ", ".join(f"CASE WHEN {sql} THEN '{name}' END" for name, sql in _RULES.items()) + ")"
_CELLS = " UNION ALL ".join(f"SELECT recording_id, '{name}' AS rule, {sql} AS matched FROM tracks" for name, sql in _RULES.items())
_APPLIED = (
    "concat_ws('|', CASE WHEN genre = 'electronica' THEN 'genre map' END, CASE WHEN genre IS NULL THEN 'default genre' END, "
    "CASE WHEN title LIKE '% (Live)' THEN 'live mark' END, CASE WHEN album = 'Greatest Hits' THEN 'various' END, "
    "CASE WHEN year < 1960 THEN 'old year' END, CASE WHEN file_type = 'wma' THEN 'no wma' END)"
)
_IN_YEAR = "CASE WHEN year IS NOT NULL THEN concat(' (', year, ')') ELSE '' END"

#: name: (query, SQL)
PAIRS: dict[str, tuple[Query, str]] = {
    "d11_first_rule": (of_tracks(lambda t: t.select("recording_id", rules.first_rule(RULES).alias("rule"))), f"{_T} SELECT recording_id, {_FIRST} AS rule FROM tracks"),
    "d11_all_rules": (
        of_tracks(lambda t: t.select("recording_id", F.array_join(rules.all_rules(RULES), "|").alias("rules"))),
        f"{_T} SELECT recording_id, {_ALL} AS rules FROM tracks",
    ),
    "d11_rule_matrix": (of_tracks(lambda t: rules.match_matrix(t, RULES)), f"{_T} {_CELLS}"),
    "g24_rule_usage": (of_tracks(lambda t: rules.rule_usage(t, RULES)), f"{_T} SELECT coalesce({_FIRST}, 'fallback') AS rule, count(*) AS tracks FROM tracks GROUP BY 1"),
    "g24_rule_tags": (
        of_tracks(lambda t: rules.rule_tags(t, RULES)),
        f"{_T} SELECT 'live' AS tag, count(*) AS tracks FROM tracks WHERE {_RULES['live']} UNION ALL SELECT 'stage', count(*) FROM tracks WHERE {_RULES['live']} OR {_RULES['old jazz']} "
        f"UNION ALL SELECT 'various', count(*) FROM tracks WHERE {_RULES['compilation']}",
    ),
    "m1_apply_edits": (
        of_tracks(_edited),
        f"{_T} SELECT recording_id, regexp_replace(title, ' \\(Live\\)$', ' [Live]') AS title, CASE genre WHEN 'electronica' THEN 'Electronic' ELSE coalesce(genre, 'Unknown') END AS genre, "
        "CASE WHEN year >= 1960 THEN year END AS year, CASE file_type WHEN 'wma' THEN 'mp3' ELSE file_type END AS file_type, "
        f"concat(replace(artists_raw, ', ', '|'), CASE WHEN album = 'Greatest Hits' THEN '|Various' ELSE '' END) AS artists, {_APPLIED} AS applied FROM tracks",
    ),
    "m9_conditional_edits": (
        of_tracks(_where_edited),
        f"{_T}, a AS (SELECT *, coalesce(genre, album) AS g1, CASE WHEN album = 'Greatest Hits' AND contains(coalesce(genre, album), 'rock') THEN 1990 ELSE year END AS y1 FROM tracks), "
        "b AS (SELECT *, CASE WHEN track_number <= 3 AND y1 = 1990 THEN 100 + track_number ELSE track_number END AS n1, CASE g1 WHEN 'rock, pop' THEN 'Rock' WHEN 'electronica' THEN 'Electronic' ELSE g1 END AS g2, "
        "array_to_string(list_transform(string_split(title, ' '), lambda w: CASE WHEN w[1] = '(' THEN '(' || upper(w[2]) || w[3:] ELSE upper(w[1]) || w[2:] END), ' ') AS t1 FROM a) "
        "SELECT recording_id, t1 AS title, g2 AS genre, album, y1 AS year, n1 AS track_number, concat_ws('|', CASE WHEN genre IS NULL THEN 'no genre' END, CASE WHEN y1 IS DISTINCT FROM year THEN 'hits' END, "
        "CASE WHEN n1 <> track_number THEN 'tracks' END, CASE WHEN g2 <> g1 THEN 'standardize genre' END, CASE WHEN t1 <> title THEN 'capitalize title' END) AS applied FROM b",
    ),
    "m10_undo_log": (of_tracks(_undo), f"{_T} SELECT recording_id, title, genre, year, file_type FROM tracks WHERE {_APPLIED} <> ''"),
    "g29_edit_result": (
        of_tracks(lambda t: edits.edit_result(edits.apply_edits(_tags(t), EDITS))),
        f"{_T} SELECT unnest(list_append(CASE WHEN {_APPLIED} = '' THEN [] ELSE string_split({_APPLIED}, '|') END, CASE WHEN {_APPLIED} = '' THEN 'skipped' ELSE 'success' END)) AS edit, "
        "count(*) AS changed FROM tracks GROUP BY 1",
    ),
    "l1_render_template": (
        of_tracks(_rendered),
        f"{_T} SELECT recording_id, concat(genre, '/', primary_artist, '/', coalesce(CAST(year AS VARCHAR), 'undated'), ' - ', album, '/', track_number, ' ', title, '.', file_type) AS target FROM tracks",
    ),
    "l3_target_path": (
        of_tracks(_targets),
        f"{_T} SELECT recording_id, CASE WHEN contains(title, '(Live)') THEN concat('Live/', primary_artist, '/', strftime(created_at, '%Y-%m-%d'), ' - ', "
        "CASE WHEN starts_with(album, 'Live at ') THEN substr(album, 9) ELSE 'Unknown Location' END) "
        f"WHEN album = 'Greatest Hits' THEN concat('Compilations/', primary_artist, '/', album, {_IN_YEAR}) WHEN title LIKE '% Demo' THEN concat('Rarities/', primary_artist, '/', album) "
        f"WHEN contains(artists_raw, ',') THEN concat('Collaborations/', album, {_IN_YEAR}, ' - ', artists_raw) ELSE concat('Albums/', primary_artist, '/', album, {_IN_YEAR}) END AS folder, "
        "concat(lpad(CAST(track_number AS VARCHAR), 2, '0'), '. ', title, '.', file_type) AS file FROM tracks",
    ),
    "d13_plan_moves": (
        of_tracks(_moves),
        f"{_T}, p AS (SELECT *, row_number() OVER (PARTITION BY album, title, file_type ORDER BY recording_id) - 1 AS n FROM tracks) "
        "SELECT recording_id, concat(album, '/', title, '.', file_type) AS target, n > 0 AS conflict, concat(album, '/', title, CASE WHEN n > 0 THEN concat(' (', n, ')') ELSE '' END, '.', file_type) AS final FROM p",
    ),
    "g27_directory_tree": (
        of_tracks(layout.directory_tree),
        f"{_T}, p AS (SELECT string_split(path, '/') AS s, size_bytes, unnest([1, 2, 3, 4]) AS n FROM tracks) "
        "SELECT array_to_string(list_slice(s, 1, n + 1), '/') AS directory, CAST(n AS INT) AS depth, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM p GROUP BY 1, 2",
    ),
    "g13_folder_patterns": (
        of_tracks(layout.folder_patterns),
        f"{_T} SELECT concat('/music/', coalesce(genre, 'Unknown')) AS folder, count(*) AS files FROM tracks GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    ),
    "d13_against_existing": (
        of_tracks(_against_existing),
        f"{_T}, p AS (SELECT *, row_number() OVER (PARTITION BY album, title, file_type ORDER BY recording_id) - 1 + CASE WHEN (album, title, file_type) IN (SELECT (album, title, file_type) FROM tracks WHERE track_number = 1) THEN 1 ELSE 0 END AS n FROM tracks WHERE track_number <> 1) "
        "SELECT recording_id, concat(album, '/', title, '.', file_type) AS target, n > 0 AS conflict, concat(album, '/', title, CASE WHEN n > 0 THEN concat(' (', n, ')') ELSE '' END, '.', file_type) AS final FROM p",
    ),
    "a8_playlists": (
        of_tracks(layout.playlist_lines),
        f"{_T} SELECT primary_artist, path, recording_id, concat('#EXTINF:', CAST(duration_seconds AS BIGINT), ',', primary_artist, ' - ', title, chr(10), path) AS line FROM tracks "
        "UNION ALL SELECT DISTINCT primary_artist, '', '', '#EXTM3U' FROM tracks",
    ),
}
