"""Queries on tags, look-ups, duplicates and profiles, and their equivalents in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shellac.functions import tags
from shellac.operators import curation, lookups, profile, resolution, statistics
from shellac.plans.queries import _A, _I, _KEY, _L, _QUALITY, _T, Query, _columns, _of_inventories, of_log, of_tracks
from shellac.sources import catalog

AS_OF = "2001-11-05 00:00:00"
_HASH = "md5(concat_ws('|', title, primary_artist, CAST(CAST(duration_seconds AS BIGINT) AS VARCHAR)))"
_NUMBER = "CASE track_number % 3 WHEN 0 THEN concat(track_number, '/12') WHEN 1 THEN concat('Track ', track_number) ELSE CAST(track_number AS STRING) END"
_DATED = "CASE track_number % 3 WHEN 0 THEN CAST(created_at AS STRING) WHEN 1 THEN concat('(P) ', coalesce(CAST(year AS STRING), 'no year'), ' Label') ELSE album END"
_CREDIT = "concat(primary_artist, CASE track_number WHEN 1 THEN ' feat. Guest' WHEN 2 THEN ' featuring Guest' WHEN 3 THEN ' with Guest' WHEN 4 THEN ' & Guest' WHEN 5 THEN ' x Guest' WHEN 6 THEN ' and Guest' ELSE '' END)"


def _errors() -> Column:
    year = F.when(F.col("ord2") == 2, F.lit(1850)).otherwise(F.col("year"))
    track = F.when(F.col("ord2") == 3, F.lit(-1)).otherwise(F.col("track_number"))
    return F.array_join(tags.metadata_errors(F.nullif(F.col("title"), F.lit("")), F.when(F.col("ord2") != 4, F.col("primary_artist")), year, track, 2000), "|")


def _patterns() -> dict[str, Column]:
    title = F.col("title")
    patterns = dict(exact="demo", contains="(live)", starts="part", ends="remix)", regex="episode$|demo$", fuzzy="part (live)")
    return {kind: lookups.pattern_match(title, pattern, kind) for kind, pattern in patterns.items()}


def _enriched(tracks: DataFrame) -> DataFrame:
    reference = tracks.groupBy("primary_artist", "title").agg(F.max("genre").alias("genre"), F.max("year").alias("year"))
    return lookups.enrich(tracks.select("recording_id", "primary_artist", "title", "genre", "year"), reference, ["primary_artist", "title"], ["genre", "year"])


def _moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = curation.latest_operations(catalog.view(spark, sf_dir, catalog.OP_LOG_SQL)).filter("operation_type = 'move'")
    moves = log.select(F.concat(F.lit("/o/"), "id").alias("source"), F.concat(F.lit("/t/"), "id").alias("target"), "status")
    return lookups.apply_moves(catalog.view(spark, sf_dir, catalog.INVENTORY_PREV_SQL), moves)


def _report(tracks: DataFrame) -> DataFrame:
    usual = statistics.usual_genre(tracks).select("primary_artist", F.col("genre").alias("predicted"))
    found = tracks.filter("genre IS NOT NULL").join(usual, "primary_artist").select(F.col("genre").alias("actual"), "predicted")
    return lookups.classification_report(found)


def _shared_artists(tracks: DataFrame) -> DataFrame:
    artists = statistics.exploded_artists(tracks)
    return artists.filter("genre = 'Rock'").select("artist").intersect(artists.filter("genre = 'Jazz'").select("artist"))


_STRATEGIES = ("skip", "rename", "keep_both", "replace", "append_suffix")
_USUAL = "usual AS (SELECT primary_artist, genre AS predicted FROM tracks WHERE genre IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY primary_artist ORDER BY count(*) DESC, genre) = 1)"
_ACTIONS = (
    f"actions AS (SELECT key, size_bytes, row_number() OVER (PARTITION BY key ORDER BY quality DESC, recording_id) AS place, count(*) OVER (PARTITION BY key) AS n "
    f"FROM (SELECT recording_id, size_bytes, {_KEY} AS key, {_QUALITY} AS quality FROM tracks))"
)

#: name: (query, SQL)
PAIRS: dict[str, tuple[Query, str]] = {
    "b6_parse_artists": (
        _columns(lambda: dict(artists=F.array_join(tags.parse_artists(F.expr(_CREDIT)), "|"), primary=tags.parse_artists(F.expr(_CREDIT))[0])),
        _T + "SELECT recording_id, primary_artist || CASE WHEN track_number BETWEEN 1 AND 6 THEN '|Guest' ELSE '' END AS artists, primary_artist AS primary FROM tracks",
    ),
    "b7_track_number": (
        _columns(lambda: dict(number=tags.parse_track_number(F.expr(_NUMBER)), padded=tags.padded_track(tags.parse_track_number(F.expr(_NUMBER))))),
        _T + "SELECT recording_id, track_number AS number, lpad(CAST(track_number AS VARCHAR), 2, '0') AS padded FROM tracks",
    ),
    "b8_extract_year": (
        _columns(lambda: dict(found=tags.extract_year(F.expr(_DATED)))),
        _T + f"SELECT recording_id, CAST(coalesce(nullif(regexp_extract(t, '^(\\d{{4}})', 1), ''), nullif(regexp_extract(t, '((?:19|20)\\d{{2}})', 1), '')) AS INT) AS found FROM (SELECT recording_id, {_DATED} AS t FROM tracks)",
    ),
    "b10_flags": (
        _columns(lambda: dict(live=F.lower("title").contains("live") | F.lower("album").contains("live"), various=F.lower("album").rlike("greatest hits|soundtrack"), several=F.size(tags.split_artists(F.col("artists_raw"))) > 1)),
        _T + "SELECT recording_id, title ILIKE '%live%' OR album ILIKE '%live%' AS live, album ILIKE '%greatest hits%' OR album ILIKE '%soundtrack%' AS various, contains(artists_raw, ', ') AS several FROM tracks",
    ),
    "b11_display": (
        _columns(lambda: dict(label=F.concat_ws(" - ", "primary_artist", "title"), length=tags.clock(F.col("duration_seconds")), file=F.concat_ws(" ", tags.padded_track(F.col("track_number")), "title"))),
        _T + "SELECT recording_id, primary_artist || ' - ' || title AS label, lpad(CAST(CAST(duration_seconds AS BIGINT) // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(duration_seconds AS BIGINT) % 60 AS VARCHAR), 2, '0') AS length, "
        "lpad(CAST(track_number AS VARCHAR), 2, '0') || ' ' || title AS file FROM tracks",
    ),
    "b13_derived": (
        _columns(lambda: dict(decade=tags.decade(F.col("year")), minutes=F.round(F.col("duration_seconds") / 60, 6), format=F.upper("file_type"))),
        _T + "SELECT recording_id, CAST(CAST(floor(year / 10) * 10 AS BIGINT) AS VARCHAR) || 's' AS decade, round(duration_seconds / 60, 6) AS minutes, upper(file_type) AS format FROM tracks",
    ),
    "b14_validate": (
        _columns(lambda: dict(errors=_errors())),
        _T + "SELECT recording_id, concat_ws('|', CASE WHEN title = '' THEN 'title required' END, CASE WHEN ord2 = 4 THEN 'artist required' END, "
        "CASE WHEN ord2 = 2 OR year > 2000 THEN 'year out of range' END, CASE WHEN ord2 = 3 THEN 'negative track' END) AS errors FROM tracks",
    ),
    "b18_complete": (
        _columns(lambda: dict(complete=tags.given(F.col("title")) & tags.given(F.col("primary_artist")) & tags.given(F.nullif(F.col("album"), F.lit("Greatest Hits"))))),
        _T + "SELECT recording_id, title <> '' AND primary_artist <> '' AND album <> 'Greatest Hits' AS complete FROM tracks",
    ),
    "c3_by_genre": (of_tracks(lambda t: lookups.containing(t, "genre", "ROCK").select("recording_id", "genre")), _T + "SELECT recording_id, genre FROM tracks WHERE genre ILIKE '%rock%'"),
    "c5_by_title": (of_tracks(lambda t: lookups.containing(t, "title", "demo").select("recording_id", "title")), _T + "SELECT recording_id, title FROM tracks WHERE title ILIKE '%demo%'"),
    "c7_artists_like": (
        of_tracks(lambda t: lookups.containing(statistics.exploded_artists(t).select("artist").distinct(), "artist", "00001")),
        _A + "SELECT DISTINCT artist FROM artists WHERE contains(artist, '00001')",
    ),
    "c8_recently_added": (of_tracks(lambda t: lookups.recently_added(t, "1998-06-30 00:00:00").select("recording_id")), _T + "SELECT recording_id FROM tracks WHERE created_at BETWEEN TIMESTAMP '1998-06-30' - INTERVAL 30 DAYS AND TIMESTAMP '1998-06-30'"),
    "c11_needs_enrichment": (
        of_tracks(lambda t: lookups.needs_enrichment(t.withColumns({"albumartist": F.when(F.col("disc_number") == 1, F.col("primary_artist")), "composer": F.when(F.col("artists_raw").contains(","), F.col("title"))}))),
        _T + "SELECT * FROM (SELECT recording_id, concat_ws('|', CASE WHEN year IS NULL THEN 'year' END, CASE WHEN genre IS NULL THEN 'genre' END, CASE WHEN disc_number <> 1 THEN 'albumartist' END, "
        "CASE WHEN NOT contains(artists_raw, ',') THEN 'composer' END) AS missing FROM tracks) WHERE missing <> ''",
    ),
    "c13_pattern_match": (
        _columns(_patterns),
        _T + "SELECT recording_id, t = 'demo' AS exact, contains(t, '(live)') AS contains, starts_with(t, 'part') AS starts, ends_with(t, 'remix)') AS ends, regexp_matches(t, 'episode$|demo$') AS regex, "
        "length(t) <= 16.5 AND length(t) * 1.5 >= 11 AND 1 - levenshtein(t, 'part (live)') / greatest(length(t), 11) >= 0.8 AS fuzzy FROM (SELECT recording_id, lower(title) AS t FROM tracks)",
    ),
    "d4_enrich": (
        of_tracks(_enriched),
        _T + "SELECT recording_id, primary_artist, title, coalesce(r.genre, t.genre) AS genre, coalesce(r.year, t.year) AS year FROM tracks t "
        "LEFT JOIN (SELECT primary_artist, title, max(genre) AS genre, max(year) AS year FROM tracks GROUP BY 1, 2) r USING (primary_artist, title)",
    ),
    "d6_infer_year": (
        of_tracks(lookups.infer_year_from_album),
        _T + ", f AS (SELECT primary_artist, album, year FROM tracks WHERE year IS NOT NULL QUALIFY row_number() OVER (PARTITION BY primary_artist, album ORDER BY ord1, ord2, recording_id) = 1) "
        "SELECT recording_id, coalesce(t.year, f.year) AS year FROM tracks t LEFT JOIN f USING (primary_artist, album)",
    ),
    "d10_verify_manifest": (
        _of_inventories(lookups.verify_manifest),
        _I + "SELECT path, CASE WHEN c.path IS NULL THEN 'missing' ELSE 'size mismatch' END AS problem FROM p LEFT JOIN c USING (path) WHERE c.path IS NULL OR c.size <> p.size",
    ),
    "d17_apply_moves": (
        _moved,
        _L + f", p AS ({catalog.INVENTORY_PREV_SQL}) SELECT path, coalesce('/t/' || id, path) AS moved_to FROM p LEFT JOIN (SELECT * FROM latest WHERE operation_type = 'move' AND status = 'completed') ON path = '/o/' || id",
    ),
    "d19_restorable": (
        _of_inventories(lambda p, c: lookups.restorable(p, c, p.filter("size % 7 = 0"))),
        _I + "SELECT path, CASE WHEN path NOT IN (SELECT path FROM c) THEN 'backup missing' WHEN size % 7 = 0 THEN 'target exists' ELSE 'restorable' END AS state FROM p",
    ),
    "f2_duplicates_by_file": (
        of_tracks(lambda t: resolution.duplicates_by_key(t, resolution.file_hash())),
        _T + f"SELECT {_HASH} AS key, count(*) AS tracks, min(recording_id) AS first FROM tracks GROUP BY 1 HAVING count(*) > 1",
    ),
    "f9_duplicate_likelihood": (
        of_tracks(resolution.duplicate_likelihood),
        _T + "SELECT round(count(*) FILTER (n > 1) / count(*), 6) AS likelihood FROM (SELECT count(*) AS n FROM tracks WHERE title <> '' AND primary_artist <> '' GROUP BY regexp_replace(lower(primary_artist), '[^a-z0-9]', '', 'g') || '_' || regexp_replace(lower(title), '[^a-z0-9]', '', 'g'))",
    ),
    "f10_duplicate_summary": (
        of_tracks(resolution.duplicate_summary),
        _T + ", n AS (" + " UNION ALL ".join(f"SELECT '{kind}' AS kind, count(*) AS n FROM tracks GROUP BY {key} HAVING count(*) > 1" for kind, key in (("tags", _KEY), ("file", _HASH))) + ") "
        "SELECT kind, count(*) AS groups, CAST(sum(n) - count(*) AS BIGINT) AS redundant FROM n GROUP BY 1",
    ),
    "f11_earlier_duplicates": (
        of_tracks(resolution.earlier_duplicates),
        _T + f"SELECT recording_id, CAST(row_number() OVER w - 1 AS INT) AS earlier, lag(recording_id) OVER w AS previous FROM tracks WINDOW w AS (PARTITION BY {_HASH} ORDER BY ord1, ord2, recording_id)",
    ),
    "f15_resolution_summary": (
        of_tracks(lambda t: resolution.resolution_summary(curation.ranked_duplicates(t))),
        _T + f", {_ACTIONS} SELECT count(DISTINCT key) AS groups, count(*) FILTER (place = 1) AS kept, count(*) FILTER (place > 1) AS deleted, CAST(coalesce(sum(size_bytes) FILTER (place > 1), 0) AS BIGINT) AS saved FROM actions WHERE n > 1",
    ),
    "f17_canonical_artists": (
        of_tracks(resolution.canonical_artists),
        _T + ", spread AS (SELECT recording_id, unnest(a) AS artist, generate_subscripts(a, 1) AS spot FROM (SELECT recording_id, string_split(artists_raw, ', ') AS a FROM tracks)), "
        "keyed AS (SELECT *, replace(replace(lower(artist), 'the ', ''), ' ', '') AS key FROM spread), "
        "best AS (SELECT DISTINCT key, first_value(artist) OVER (PARTITION BY key ORDER BY length(artist) DESC, artist) AS canonical FROM keyed) "
        "SELECT recording_id, string_agg(canonical, '|' ORDER BY spot) AS artists FROM keyed JOIN best USING (key) GROUP BY 1",
    ),
    "g7_file_details": (
        of_tracks(profile.file_details),
        _T + "SELECT round(avg(size_bytes), 6) AS avg_size, round(avg(duration_seconds), 6) AS avg_seconds, round(count(*) / (sum(size_bytes) / 1073741824), 6) AS tracks_per_gb, round(sum(duration_seconds) / 3600 / (sum(size_bytes) / 1073741824), 6) AS hours_per_gb FROM tracks",
    ),
    "g11_format_profile": (of_tracks(profile.format_profile), _T + "SELECT file_type, count(*) AS tracks, round(avg(size_bytes), 6) AS avg_size, min(bitrate) AS least, max(bitrate) AS greatest FROM tracks GROUP BY 1"),
    "g11_library_profile": (
        of_tracks(profile.library_profile),
        _T + "SELECT count(*) AS tracks, count(DISTINCT file_type) AS formats, count(DISTINCT primary_artist) AS artists, count(DISTINCT (primary_artist, album)) AS releases, "
        "round((2 * count(*) + count(year) + count(genre)) / count(*) / 4, 6) AS completeness, round(count(*) / count(DISTINCT (primary_artist, album)), 6) AS tracks_per_release FROM tracks",
    ),
    "g17_releases_by_genre": (
        of_tracks(resolution.releases_by_genre),
        _T + ", n AS (SELECT primary_artist, album, genre FROM tracks GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY primary_artist, album ORDER BY count(genre) DESC, genre) = 1) SELECT coalesce(genre, 'Unknown') AS genre, count(*) AS releases FROM n GROUP BY 1",
    ),
    "g20_batch_report": (
        of_log(profile.batch_report),
        _L + ", b AS (SELECT session_id, count(*) FILTER (status = 'completed') / count(*) AS rate FROM latest GROUP BY 1) SELECT count(*) AS batches, round(avg(rate), 6) AS mean, round(min(rate), 6) AS least, round(max(rate), 6) AS greatest, "
        "round(stddev_pop(rate), 6) AS deviation, (SELECT session_id FROM b ORDER BY rate DESC, session_id LIMIT 1) AS best, (SELECT session_id FROM b ORDER BY rate, session_id LIMIT 1) AS worst FROM b",
    ),
    "g21_operation_metrics": (
        of_log(profile.operation_metrics),
        _L + "SELECT operation_type, count(*) AS operations, count(*) FILTER (status = 'failed') AS failed, CAST(sum(file_size) AS BIGINT) AS bytes, round(count(*) FILTER (status = 'failed') / count(*), 6) AS failed_rate FROM latest GROUP BY 1",
    ),
    "g21_conflict_metrics": (
        of_log(lambda log: profile.conflict_metrics(curation.latest_operations(log).select(F.when(F.col("status") == "failed", F.element_at(F.array(*map(F.lit, _STRATEGIES)), (F.col("id") % 5 + 1).cast("int"))).alias("strategy")))),
        _L + "SELECT count(*) AS conflicts, count(*) FILTER (id % 5 = 0) AS skipped, count(*) FILTER (id % 5 IN (1, 2)) AS renamed, count(*) FILTER (id % 5 = 3) AS replaced, "
        "round(100.0::DOUBLE * count(*) FILTER (id % 5 < 4) / count(*), 6) AS rate FROM latest WHERE status = 'failed'",
    ),
    "g30_scan_report": (
        of_tracks(profile.scan_report),
        _T + "SELECT file_type, count(*) AS tracks, count(*) FILTER (genre IS NOT NULL OR year IS NOT NULL) AS tagged, CAST(sum(size_bytes) AS BIGINT) AS bytes, 100 * count(*) FILTER (genre IS NOT NULL OR year IS NOT NULL) // count(*) AS tagged_percent FROM tracks GROUP BY 1",
    ),
    "i1_page": (of_tracks(lambda t: lookups.page(t.select("recording_id", "title"), ["title", "recording_id"], 50, 100)), _T + "SELECT recording_id, title FROM tracks ORDER BY title, recording_id LIMIT 50 OFFSET 100"),
    "j4_distinct_folders": (
        of_tracks(lambda t: t.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct()),
        _T + "SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS folder FROM tracks",
    ),
    "j5_common_artists": (of_tracks(_shared_artists), _A + "SELECT artist FROM artists WHERE genre = 'Rock' INTERSECT SELECT artist FROM artists WHERE genre = 'Jazz'"),
    "k19_classification_report": (
        of_tracks(_report),
        _T + f", {_USUAL}, f AS (SELECT genre AS actual, predicted FROM tracks JOIN usual USING (primary_artist) WHERE genre IS NOT NULL), "
        "l AS (SELECT label, count(*) FILTER (actual = label) AS support, count(*) FILTER (predicted = label) AS given, count(*) FILTER (actual = label AND predicted = label) AS hits "
        "FROM (SELECT actual AS label FROM f UNION SELECT predicted FROM f) JOIN f ON label IN (actual, predicted) GROUP BY 1) "
        "SELECT label, support, round(CASE WHEN given > 0 THEN hits / given ELSE 0 END, 6) AS precision, round(CASE WHEN support > 0 THEN hits / support ELSE 0 END, 6) AS recall, round(2 * hits / (support + given), 6) AS f1 FROM l",
    ),
    "n8_corrections": (
        of_tracks(lambda t: lookups.corrections(t, statistics.usual_genre(t))),
        _T + f", {_USUAL} SELECT recording_id, predicted, genre FROM tracks JOIN usual USING (primary_artist) WHERE genre <> predicted",
    ),
}
