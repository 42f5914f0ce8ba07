"""Queries on likeness, whole releases, covers, layouts, patches and logs, and their equivalents in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shellac.functions import recordings, tags
from shellac.operators import layout, organizing, statistics, upkeep
from shellac.plans.planning import _kind
from shellac.plans.queries import _A, _KEY, _L, _T, Query, of_log, of_tracks
from shellac.sources import catalog

STRATEGIES = {1: "skip", 2: "replace", 3: "rename", 4: "keep_both"}


def _of(sql: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(catalog.view(spark, sf_dir, sql))


def _neighbours(tracks: DataFrame) -> DataFrame:
    """Likeness of each track and the next of its order."""
    rows = tracks.select("ord1", "ord2", "recording_id", "title", tags.split_artists(F.col("artists_raw")).alias("artists"), "album", F.col("duration_seconds").alias("seconds"))
    both = rows.alias("a").join(rows.alias("b"), F.expr("a.ord1 = b.ord1 AND b.ord2 = a.ord2 + 1"))
    score = recordings.recording_likeness(*[{n: F.col(f"{side}.{n}") for n in ("title", "artists", "album", "seconds")} for side in "ab"])
    return both.select(F.col("a.recording_id").alias("one"), F.col("b.recording_id").alias("other"), F.round(score, 6).alias("score"))


def _release_pairs(tracks: DataFrame) -> DataFrame:
    """Likeness of releases of the same artist and year, each pair once."""
    rows = statistics.releases(tracks).select("primary_artist", "album", "year")
    both = rows.alias("a").join(rows.alias("b"), F.expr("a.primary_artist = b.primary_artist AND a.year = b.year AND a.album < b.album"))
    score = recordings.release_likeness(*[dict(title=F.col(f"{s}.album"), artist=F.col(f"{s}.primary_artist"), year=F.col(f"{s}.year")) for s in "ab"])
    return both.select("a.primary_artist", F.col("a.album").alias("one"), F.col("b.album").alias("other"), F.round(score, 6).alias("score"))


def _texts(tracks: DataFrame) -> DataFrame:
    dated = F.concat(F.date_format("created_at", "yyyy-MM-dd"), F.lit(" - "), "album")
    text = F.when(F.col("ord2") % 3 == 0, dated).when(F.col("ord2") % 3 == 1, F.concat(F.col("year").cast("string"), F.lit(" - "), "album")).otherwise(F.col("album"))
    return tracks.select("recording_id", recordings.date_in(text).alias("date"), recordings.place_in(text).alias("place"))


def _folders(tracks: DataFrame) -> DataFrame:
    special = recordings.special_folder(F.col("album") == "Greatest Hits", F.col("title").contains("(Live)"), F.col("genre"))
    levels = [special, F.col("genre"), F.col("primary_artist"), tags.decade(F.col("year"))]
    return tracks.select("recording_id", recordings.folder_levels(levels, depth=3).alias("folder"))


def _moves(tracks: DataFrame) -> DataFrame:
    return layout.plan_moves(tracks.select("recording_id", F.concat("album", F.lit("/"), "title", F.lit("."), "file_type").alias("target")))


def _resolved(tracks: DataFrame) -> DataFrame:
    line, strategy = F.split("recording_id", "-")[1], F.lit("append_suffix")
    for number, name in STRATEGIES.items():
        strategy = F.when(line == str(number), name).otherwise(strategy)
    return organizing.resolve_conflicts(_moves(tracks).withColumn("strategy", strategy), "20011105_000000")


def _by_release(tracks: DataFrame) -> DataFrame:
    in_year = F.coalesce(F.concat(F.lit(" ("), F.col("year").cast("string"), F.lit(")")), F.lit(""))
    return organizing.plan_by_release(tracks, F.concat(_kind(), F.lit("/"), "primary_artist", F.lit(" - "), "album", in_year))


def _preview(tracks: DataFrame) -> DataFrame:
    about = ("size_bytes", "kind", "artists", "title", "primary_artist", "album")
    rows = tracks.select("recording_id", F.col("path").alias("target"), "size_bytes", _kind().alias("kind"), tags.split_artists(F.col("artists_raw")).alias("artists"), *about[3:])
    return organizing.preview_stats(layout.plan_moves(rows, keep=about))


def _covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tracks = catalog.tracks(spark, sf_dir)
    folders = tracks.select(organizing.directory(F.col("path")).alias("d")).distinct()
    names = F.array_compact(F.array(F.when(F.length("d") % 3 == 0, F.lit("/Cover.jpg")), F.when(F.length("d") % 2 == 0, F.lit("/scan.png"))))
    images = folders.select("d", F.explode(names).alias("name")).select(F.concat("d", "name").alias("path"))
    return organizing.attach_cover(tracks, images)


def _layout(tracks: DataFrame) -> DataFrame:
    art = F.concat(F.lit("/art/"), "album", F.lit("/scan.png"))
    loose = F.when(F.col("track_number") == 7, F.concat(F.lit("/"), "title", F.lit(".mp3")))
    # one read of the tracks for their three paths
    files = tracks.select(F.explode(F.array_compact(F.array(F.col("path"), art, loose))).alias("path"))
    return organizing.validate_layout(files, ("music", "incoming"))


def _patched(replace: bool) -> Query:
    def query(tracks: DataFrame) -> DataFrame:
        updates = tracks.filter("ord1 % 3 = 0").select("recording_id", F.when(F.col("ord2") % 2 == 0, "Electronic").alias("genre"), F.lit(2000).alias("year"))
        out = upkeep.patch_metadata(tracks, updates, ("genre", "year"), replace)
        return out.withColumn("changed", F.array_join("changed", "|"))

    return of_tracks(query)


def _words(text: str) -> str:
    return f"list_distinct(regexp_split_to_array({text}, '\\s+'))"


def _likeness(a: str, b: str) -> str:
    x, y = f"trim(lower({a}))", f"trim(lower({b}))"
    shared = f"len(list_intersect({_words(x)}, {_words(y)})) / len(list_distinct(list_concat({_words(x)}, {_words(y)})))"
    return f"CASE WHEN {x} = {y} THEN 1.0::DOUBLE WHEN contains({x}, {y}) OR contains({y}, {x}) THEN 0.8::DOUBLE ELSE {shared} END"


def _artists(a: str, b: str) -> str:
    p, q = f"string_split(lower({a}), ', ')", f"string_split(lower({b}), ', ')"
    bare = [f"string_split(replace(lower({c}), 'the ', ''), ', ')" for c in (a, b)]
    return (
        f"CASE WHEN list_has_any({p}, {q}) THEN len(list_intersect({p}, {q})) / greatest(len({p}), len({q})) "
        f"WHEN list_has_any({bare[0]}, {bare[1]}) THEN 0.8::DOUBLE ELSE 0::DOUBLE END"
    )


_SCORE = (
    f"round(least(1.0::DOUBLE, 0.4::DOUBLE * ({_likeness('a.title', 'b.title')}) + 0.35::DOUBLE * ({_artists('a.artists_raw', 'b.artists_raw')}) "
    f"+ 0.15::DOUBLE * ({_likeness('a.album', 'b.album')}) + 0.1::DOUBLE * greatest(0.0::DOUBLE, 1 - abs(a.duration_seconds - b.duration_seconds) / 30)), 6)"
)
_KIND = (
    "CASE WHEN contains(title, '(Live)') THEN 'live' WHEN album = 'Greatest Hits' THEN 'compilation' WHEN ends_with(title, ' Demo') THEN 'rarity' "
    "WHEN contains(artists_raw, ',') THEN 'collaboration' ELSE 'studio' END"
)
_TEXT = "CASE ord2 % 3 WHEN 0 THEN strftime(created_at, '%Y-%m-%d') || ' - ' || album WHEN 1 THEN year || ' - ' || album ELSE album END"
_FOUND = "nullif(trim(regexp_extract(x, '{}', 1)), '')"
_DATE = ", ".join(_FOUND.format(p) for p in (r"(\d{4}-\d{2}-\d{2})", r"\b((?:19|20)\d{2})\b"))
_PLACE = ", ".join(_FOUND.format(p) for p in (r"\d{4}-\d{2}-\d{2}\s*-\s*(.+)", r"(?i)live at\s+(.+)", r"\d{4}\s*-\s*(.+)", r"([A-Za-z\s]+,\s*[A-Za-z]{2,})"))
_FOLDER = "regexp_replace(path, '/[^/]*$', '')"
_SPANS = "spans AS (SELECT id, CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000) AS BIGINT) AS seconds FROM op_log GROUP BY 1)"
_PATCH = (
    _T + "SELECT recording_id, g AS genre, y AS year, concat_ws('|', CASE WHEN g IS DISTINCT FROM genre THEN 'genre' END, CASE WHEN y IS DISTINCT FROM year THEN 'year' END) AS changed "
    "FROM (SELECT *, CASE WHEN ord1 % 3 <> 0 THEN genre WHEN ord2 % 2 = 0 THEN 'Electronic' {} END AS g, CASE WHEN ord1 % 3 = 0 THEN 2000 ELSE year END AS y FROM tracks)"
)

#: name: (query, SQL)
PAIRS: dict[str, tuple[Query, str]] = {
    "e10_recording_likeness": (
        of_tracks(_neighbours),
        _T + f"SELECT a.recording_id AS one, b.recording_id AS other, {_SCORE} AS score FROM tracks a JOIN tracks b ON a.ord1 = b.ord1 AND b.ord2 = a.ord2 + 1",
    ),
    "e13_release_likeness": (
        of_tracks(_release_pairs),
        _T + ", r AS (SELECT primary_artist, album, min(year) AS year FROM tracks GROUP BY 1, 2) SELECT a.primary_artist, a.album AS one, b.album AS other, "
        f"round(0.5::DOUBLE * (len(list_intersect({_words('lower(a.album)')}, {_words('lower(b.album)')})) / len(list_distinct(list_concat({_words('lower(a.album)')}, {_words('lower(b.album)')})))) "
        "+ 0.3::DOUBLE + 0.2::DOUBLE, 6) AS score FROM r a JOIN r b ON a.primary_artist = b.primary_artist AND a.year = b.year AND a.album < b.album",
    ),
    "d16_similar_to": (
        of_tracks(lambda t: upkeep.similar_to(t, t.orderBy("recording_id").limit(1), 0.5)),
        _T + f", b AS (SELECT * FROM tracks ORDER BY recording_id LIMIT 1) SELECT a.recording_id, {_SCORE} AS score FROM tracks a, b WHERE a.recording_id <> b.recording_id AND score >= 0.5",
    ),
    "b15_dates_places": (of_tracks(_texts), _T + f"SELECT recording_id, coalesce({_DATE}) AS date, coalesce({_PLACE}) AS place FROM (SELECT recording_id, {_TEXT} AS x FROM tracks)"),
    "b16_merge_updates": (_patched(False), _PATCH.format("ELSE genre")),
    "b16_replace_updates": (_patched(True), _PATCH.format("")),
    "c6_releases_by": (
        of_tracks(lambda t: upkeep.releases_by(t, artist="SUPPLIER#000000003")),
        _T + "SELECT primary_artist, album, count(*) AS tracks, CAST(sum(duration_seconds) AS BIGINT) AS seconds, CAST(sum(size_bytes) AS BIGINT) AS bytes, min(year) AS year "
        "FROM tracks WHERE primary_artist = 'Supplier#000000003' GROUP BY 1, 2",
    ),
    "c12_conflicts_only": (
        of_tracks(lambda t: _moves(t).filter("conflict").select("recording_id", "target")),
        _T + "SELECT recording_id, concat(album, '/', title, '.', file_type) AS target FROM tracks QUALIFY row_number() OVER (PARTITION BY target ORDER BY recording_id) > 1",
    ),
    "d14_upsert": (
        of_tracks(lambda t: upkeep.upsert_recordings(t.filter("track_number <> 1"), t.filter("track_number = 1"))),
        _T + "SELECT recording_id, CASE WHEN path IN (SELECT path FROM tracks WHERE track_number <> 1) OR row_number() OVER (PARTITION BY path ORDER BY ord1, ord2, recording_id) > 1 "
        "THEN 'rejected' ELSE 'added' END AS status FROM tracks WHERE track_number = 1",
    ),
    "d12_known_imports": (
        of_tracks(lambda t: upkeep.known_imports(t.filter("track_number > 2"), t.filter("track_number <= 2"))),
        _T + f", k AS (SELECT recording_id, track_number, {_KEY} AS key FROM tracks) SELECT recording_id, key IN (SELECT key FROM k WHERE track_number > 2) "
        "OR row_number() OVER (PARTITION BY key ORDER BY recording_id) > 1 AS known FROM k WHERE track_number <= 2",
    ),
    "d18_attach_cover": (
        _covers,
        _T + "SELECT recording_id, CASE WHEN length(d) % 3 = 0 THEN d || '/Cover.jpg' WHEN length(d) % 2 = 0 THEN d || '/scan.png' END AS cover "
        f"FROM (SELECT recording_id, {_FOLDER} AS d FROM tracks)",
    ),
    "f21_duplicate_preview": (
        of_tracks(upkeep.duplicate_preview),
        _T + f", k AS (SELECT recording_id, {_KEY} AS key FROM tracks), g AS (SELECT key, count(*) AS tracks FROM k GROUP BY 1 HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 10) "
        "SELECT key, tracks, recording_id FROM k JOIN g USING (key)",
    ),
    "g8_diversity": (
        of_tracks(lambda t: upkeep.diversity(t, 3)),
        _A + ", g AS (SELECT count(DISTINCT trim(v)) AS genres FROM (SELECT unnest(string_split(genre, ',')) AS v FROM tracks)) "
        "SELECT genres, round(100 * least(3, genres) / genres, 6) AS concentration, a AS artists, round((SELECT count(*) FROM tracks) / a, 6) AS tracks_per_artist "
        "FROM g, (SELECT count(DISTINCT lower(artist)) AS a FROM artists)",
    ),
    "g14_catalog_stats": (
        of_tracks(upkeep.catalog_stats),
        _T + f", g AS (SELECT {_KEY} AS key, count(*) AS n FROM tracks GROUP BY 1) SELECT count(*) AS tracks, (SELECT CAST(sum(n) AS BIGINT) FROM g WHERE n > 1) AS duplicates, "
        "(SELECT count(*) FROM g WHERE n > 1) AS groups, count(*) FILTER (year IS NULL OR genre IS NULL) AS untagged, round(avg(duration_seconds), 6) AS avg_seconds FROM tracks",
    ),
    "g16_build_artists": (
        of_tracks(upkeep.build_artists),
        _A + "SELECT artist, count(*) AS recordings, count(DISTINCT concat(primary_artist, '|', album)) AS releases, CAST(sum(duration_seconds) AS BIGINT) AS seconds, "
        "coalesce(string_agg(DISTINCT genre, '|' ORDER BY genre), '') AS genres FROM artists GROUP BY 1",
    ),
    "g25_preview_stats": (
        of_tracks(_preview),
        _A + f", s AS (SELECT count(*) AS operations, round(sum(size_bytes) / 1048576.0, 6)::DOUBLE AS megabytes, count(*) - count(DISTINCT path) AS conflicts, count(DISTINCT {_KIND}) AS kinds, "
        "1.0::DOUBLE AS completeness, max(len(string_split(path, '/')) - 1) AS depth, (SELECT count(DISTINCT artist) FROM artists) AS artists FROM tracks) "
        "SELECT *, round(operations * CASE WHEN megabytes / operations < 10 THEN 2 WHEN megabytes / operations < 50 THEN 5 ELSE 10 END / 60, 6) AS minutes, "
        "round(30 + (1 - conflicts / operations) * 20 + CASE WHEN depth BETWEEN 2 AND 4 THEN 20 WHEN depth BETWEEN 1 AND 5 THEN 10 ELSE 0 END "
        "+ CASE WHEN kinds > 1 THEN 20 ELSE 10 END + CASE WHEN artists > 10 THEN 10 WHEN artists > 5 THEN 5 ELSE 0 END, 6) AS score FROM s",
    ),
    "g28_extraction_stats": (
        of_log(upkeep.extraction_stats),
        _L + f", {_SPANS} SELECT count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, "
        "CAST(sum(file_size) FILTER (status = 'completed') AS BIGINT) AS bytes, round(avg(seconds) FILTER (status = 'completed'), 6) AS avg_seconds, "
        "round(bytes / 1048576.0::DOUBLE / sum(seconds) FILTER (status = 'completed'), 9) AS mb_per_second FROM latest JOIN spans USING (id)",
    ),
    "g31_validate_layout": (
        of_tracks(_layout),
        _T + "SELECT 'missing' AS problem, 'incoming' AS path UNION ALL SELECT DISTINCT 'no_media', '/art/' || album FROM tracks "
        "UNION ALL SELECT DISTINCT 'in_root', '/' || title || '.mp3' FROM tracks WHERE track_number = 7",
    ),
    "h11_change_frequency": (
        _of(catalog.ACCESS_LOG_SQL, upkeep.change_frequency),
        f"WITH log AS ({catalog.ACCESS_LOG_SQL}), c AS (SELECT DISTINCT file_path, mtime FROM log), s AS (SELECT file_path, date_diff('day', lag(mtime) OVER (PARTITION BY file_path ORDER BY mtime), mtime) AS days, "
        "row_number() OVER (PARTITION BY file_path ORDER BY mtime DESC) AS back FROM c), f AS (SELECT file_path, round(coalesce(sum(pow(0.5, back) / days), 0), 6) AS frequency FROM s GROUP BY 1) "
        "SELECT file_path, frequency, round(greatest(0.0::DOUBLE, 1 - frequency * 30), 6) AS stability FROM f",
    ),
    "j1_union_catalogs": (
        of_tracks(lambda t: upkeep.union_catalogs(t.filter("track_number = 1").select("recording_id", "title"), t.filter("track_number = 2").select("title", "recording_id", "year"))),
        _T + "SELECT recording_id, title, CASE WHEN track_number = 2 THEN year END AS year FROM tracks WHERE track_number IN (1, 2)",
    ),
    "l5_special_folders": (
        of_tracks(_folders),
        _T + "SELECT recording_id, concat_ws('/', s, genre, primary_artist, CASE WHEN s IS NULL OR genre IS NULL THEN CAST(floor(year / 10) * 10 AS INT) || 's' END) AS folder FROM "
        "(SELECT *, CASE WHEN album = 'Greatest Hits' THEN 'Compilations' WHEN contains(title, '(Live)') THEN 'Live Recordings' END AS s FROM tracks)",
    ),
    "l8_resolve_conflicts": (
        of_tracks(_resolved),
        _T + ", p AS (SELECT recording_id, concat(album, '/', title) AS stem, concat(stem, '.', file_type) AS target, album, row_number() OVER (PARTITION BY target ORDER BY recording_id) AS place, "
        "CASE ord2 WHEN 1 THEN 'skip' WHEN 2 THEN 'replace' WHEN 3 THEN 'rename' WHEN 4 THEN 'keep_both' ELSE 'append_suffix' END AS strategy, title || '.' || file_type AS name, file_type FROM tracks) "
        "SELECT recording_id, target, CASE WHEN place > 1 THEN strategy ELSE 'move' END AS action, CASE WHEN place = 1 OR strategy = 'replace' THEN target WHEN strategy = 'skip' THEN NULL "
        "WHEN strategy = 'rename' THEN concat(stem, ' (', place - 1, ').', file_type) WHEN strategy = 'keep_both' THEN concat(album, '/duplicates/', name) "
        "ELSE concat(stem, '_20011105_000000.', file_type) END AS final FROM p",
    ),
    "l12_group_by_directory": (
        of_tracks(lambda t: organizing.group_by_directory(t.withColumn("target", F.col("path")))),
        _T + f"SELECT {_FOLDER} AS directory, count(*) AS operations, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM tracks GROUP BY 1",
    ),
    "l13_estimate_duration": (
        of_tracks(organizing.estimate_duration),
        _T + "SELECT count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes, round(sum(size_bytes)::DOUBLE / 209715200 + 0.1::DOUBLE * count(*), 6) AS seconds FROM tracks",
    ),
    "l14_plan_by_release": (
        of_tracks(_by_release),
        _T + f"SELECT recording_id, concat(first_value(concat({_KIND}, '/', primary_artist, ' - ', album, ' (' || year || ')')) OVER (PARTITION BY primary_artist, album ORDER BY ord1, ord2, recording_id), "
        "'/', lpad(CAST(track_number AS VARCHAR), 2, '0'), ' ', title, '.', file_type) AS target FROM tracks",
    ),
    "n2_flatten_events": (
        lambda spark, sf_dir: upkeep.flatten_events(spark.read.parquet(f"{sf_dir}/events.parquet")),
        "SELECT event_id, user_id AS aggregate, event_type AS kind, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS payload FROM events",
    ),
    "n5_slow_operations": (of_log(lambda log: upkeep.slow_operations(log, 60)), _L + f", {_SPANS} SELECT id, seconds FROM spans WHERE seconds > 60"),
    "n6_session_list": (of_log(upkeep.session_list), _L + "SELECT session_id, min(ts) AS started, max(ts) AS ended, count(*) AS records FROM op_log GROUP BY 1"),
}
