"""Queries on tag maps, payloads, documents and nested collections, and their equivalents in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shellac.functions import recordings, tag_maps, tags
from shellac.operators import documents, lookups, rollups
from shellac.plans.planning import _kind
from shellac.plans.queries import _L, _T, Query, of_tracks
from shellac.sources import catalog, payloads
from shellac.tables import written

#: Moods that genres stand for.
MOODS = {
    "pop": "happy", "rock": "energetic", "metal": "angry", "classical": "calm", "jazz": "relaxed", "blues": "melancholic",
    "electronic": "energetic", "hip-hop": "energetic", "country": "happy", "ambient": "calm",
}
#: Tracks of a document in the test tables.
PART = 50


def _tag_map(tracks: DataFrame) -> DataFrame:
    """Tags of each track as a file of its type has them: odd tracks name the album's artist, and dates and numbers are full."""
    value = {
        "artists": F.col("artists_raw"), "albumartist": F.when(F.col("track_number") % 2 == 1, F.col("primary_artist")), "album": F.col("album"),
        "title": F.col("title"), "genre": F.col("genre"), "date": F.concat(F.col("year").cast("string"), F.lit("-05-01")),
    }
    value["track"] = F.concat(F.col("track_number").cast("string"), F.when(F.col("file_type") == "wma", "").otherwise("/12"))

    def made(keys: dict[str, tuple[str, ...]]) -> Column:
        # under the last key that the format has for a field
        cells = [F.when(value[field].isNotNull(), F.struct(F.lit(names[-1]), F.array(value[field]))) for field, names in keys.items() if field in value]
        return F.map_from_entries(F.array_compact(F.array(*cells)))

    out = made(tag_maps.KEYS["flac"])
    for kind in ("mp3", "m4a", "wav", "wma"):
        out = F.when(F.col("file_type") == kind, made(tag_maps.KEYS[kind])).otherwise(out)
    return tracks.select("recording_id", "file_type", out.alias("tags"))


def _normalized(tracks: DataFrame) -> DataFrame:
    fields = tag_maps.normalized_tags(F.col("file_type"), F.col("tags"))
    fields["artists"] = F.array_join(fields["artists"], "|")
    return _tag_map(tracks).select("recording_id", *[c.alias(n) for n, c in fields.items()])


def _payload(tracks: DataFrame) -> DataFrame:
    """A lookup's answer for each track: its release with two media, on the second of which it stands, numbered or not."""
    credit = F.array(F.struct(F.struct(F.col("primary_artist").alias("name")).alias("artist"), F.lit("").alias("joinphrase")))
    named = F.when(F.col("ord2") % 2 == 0, F.concat(F.lit("0"), F.col("track_number").cast("string"))).when(F.col("ord2") % 3 == 0, F.lit("A1"))
    other = F.struct(F.lit("7").alias("number"), F.struct(F.lit("none").alias("id")).alias("recording"))
    own = F.struct(named.alias("number"), F.struct(F.col("recording_id").alias("id")).alias("recording"))
    media = F.array(F.struct(F.array(other).alias("tracks")), F.struct(F.array(other, own).alias("tracks")))
    release = F.struct(F.concat(F.col("year").cast("string"), F.lit("-03")).alias("date"), credit.alias("artist-credit"), media.alias("media"))
    names = F.split(F.coalesce("genre", F.lit("")), ", ")
    genres = F.transform(F.filter(names, lambda n: n != ""), lambda n: F.struct(n.alias("name"), F.lit(1).alias("count")))
    return tracks.select("recording_id", F.to_json(F.struct(F.col("recording_id").alias("id"), F.array(release).alias("releases"), genres.alias("tags"))).alias("payload"))


def _flattened(tracks: DataFrame) -> DataFrame:
    parsed = _payload(tracks).select("recording_id", F.inline(F.array(F.struct(F.from_json("payload", payloads.RECORDING).alias("data")))))
    return parsed.select("recording_id", *[c.alias(n) for n, c in payloads.recording_fields(F.col("data")).items()])


def _album_lines(tracks: DataFrame) -> DataFrame:
    docs = documents.album_documents(tracks, PART)
    return docs.select("artist", F.col("title").alias("album"), "part", F.inline("tracks")).select("artist", "album", "part", "place", "number", "title", "seconds")


def _artist_lines(tracks: DataFrame) -> DataFrame:
    docs = documents.artist_documents(tracks, PART)
    return docs.select("name", "part", "genre", F.inline("albums")).select("name", "part", "genre", "place", "title", "year", "tracks")


def _report(tracks: DataFrame) -> DataFrame:
    """Decisions on copies by tags: the largest file stays, files of a lossless type are moved, others deleted."""
    key = tags.identity_key(F.col("primary_artist"), F.col("title"), F.lit(""), F.lit(0))
    best = tracks.groupBy(key.alias("key")).agg(F.max_by("recording_id", F.struct("size_bytes", "recording_id")).alias("leader"), F.count("*").alias("n")).filter("n > 1")
    action = F.when(F.col("recording_id") == F.col("leader"), "keep").when(F.col("file_type").isin("flac", "wav"), "move").otherwise("delete")
    decisions = tracks.withColumn("key", key).join(best, "key").select("leader", "recording_id", action.alias("action"), "size_bytes")
    return documents.resolution_report(decisions)


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as collections, each in that of half its number; their orders as members."""
    customers, orders = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("customer", "orders"))
    half = F.floor(F.col("c_custkey") / 2)
    parents = customers.select(F.col("c_custkey").alias("node"), F.when(half > 0, half).alias("parent"))
    own = orders.select(F.col("o_custkey").alias("node"), F.lit(1).alias("items"), F.round(F.col("o_totalprice") * 100).cast("long").alias("total"))
    return rollups.collection_rollup(parents, own)


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = catalog.view(spark, sf_dir, catalog.OP_LOG_SQL)
    status = F.when(F.bool_and(F.col("status") == "completed"), "completed").otherwise("open")
    sessions = log.groupBy("session_id").agg(F.min("ts").alias("started"), F.count("*").alias("files"), status.alias("status"))
    found = rollups.scan_stats(catalog.view(spark, sf_dir, catalog.INVENTORY_CUR_SQL), sessions)
    return found.withColumn("started", F.col("started").cast("timestamp_ntz"))


def _filled(tracks: DataFrame) -> DataFrame:
    """Year and genre of tracks, from a lookup that has what the tracks of each artist, title and album say at most, and a
    year for those of which none says any."""
    # written, since the lookup and what is filled come from the same joins
    tracks = written(tracks.select("recording_id", "primary_artist", "title", "album", "year", "genre"))
    found = tracks.groupBy(F.col("primary_artist").alias("artist"), "title", "album").agg(F.coalesce(F.min("year"), F.lit(1900)).alias("year"), F.max("genre").alias("genre"))
    return lookups.fill_from_lookup(tracks, found, ("year", "genre")).withColumn("filled", F.array_join("filled", "|"))


def _scored(tracks: DataFrame) -> DataFrame:
    """Scores of each track and the next of its order."""
    rows = tracks.select("ord1", "ord2", "recording_id", "title", tags.split_artists(F.col("artists_raw")).alias("artists"), "album", F.col("duration_seconds").alias("seconds"))
    both = rows.alias("a").join(rows.alias("b"), F.expr("a.ord1 = b.ord1 AND b.ord2 = a.ord2 + 1"))
    scores = recordings.pair_scores(*[{n: F.col(f"{side}.{n}") for n in ("title", "artists", "album", "seconds")} for side in "ab"])
    return both.select(F.col("a.recording_id").alias("one"), F.col("b.recording_id").alias("other"), *[(F.round(c, 6) if n != "is_similar" else c).alias(n) for n, c in scores.items()])


def _share(x: str, y: str) -> str:
    words = "list_distinct(list_filter(string_split(lower({}), ' '), lambda w: w <> ''))"
    return f"CASE WHEN lower({x}) = lower({y}) THEN 1.0::DOUBLE ELSE len(list_intersect({words.format(x)}, {words.format(y)})) / len(list_distinct(list_concat({words.format(x)}, {words.format(y)}))) END"


_BARE = "list_transform(string_split({}.artists_raw, ', '), lambda n: replace(lower(n), 'the ', ''))"
_IN_ORDER = "PARTITION BY primary_artist, album ORDER BY track_number, lower(title), recording_id"
_FULL = "file_type IN ('flac', 'ogg')"

#: name: (query, SQL)
PAIRS: dict[str, tuple[Query, str]] = {
    "b1_normalize_tags": (
        of_tracks(_normalized),
        _T + f"SELECT recording_id, CASE WHEN {_FULL} THEN replace(artists_raw, ', ', '|') ELSE artists_raw END AS artists, "
        f"CASE WHEN file_type <> 'wav' AND track_number % 2 = 1 THEN primary_artist WHEN {_FULL} THEN string_split(artists_raw, ', ')[1] ELSE artists_raw END AS primary_artist, album, title, "
        f"CASE WHEN file_type <> 'wav' THEN genre END AS genre, CASE WHEN file_type <> 'wav' THEN year END AS year, CASE WHEN {_FULL} THEN year || '-05-01' END AS date, "
        "CASE WHEN file_type <> 'wav' THEN track_number END AS track_number, CAST(NULL AS VARCHAR) AS location, false AS has_cover FROM tracks",
    ),
    "a12_flatten_reference": (
        of_tracks(_flattened),
        _T + "SELECT recording_id, year, primary_artist AS albumartist, CASE WHEN ord2 % 2 = 0 THEN track_number WHEN ord2 % 3 <> 0 THEN 2 END AS track_number, genre FROM tracks",
    ),
    "a9_album_documents": (
        of_tracks(_album_lines),
        _T + f"SELECT primary_artist AS artist, album, CAST((place - 1) // {PART} AS INT) AS part, place, track_number AS number, title, duration_seconds AS seconds "
        f"FROM (SELECT *, row_number() OVER ({_IN_ORDER}) AS place FROM tracks)",
    ),
    "a9_artist_documents": (
        of_tracks(_artist_lines),
        _T + "SELECT primary_artist AS name, CAST((place - 1) // 50 AS INT) AS part, g.genre, place, album AS title, year, tracks FROM "
        "(SELECT *, row_number() OVER (PARTITION BY primary_artist ORDER BY year NULLS FIRST, album) AS place FROM (SELECT primary_artist, album, min(year) AS year, count(*) AS tracks FROM tracks GROUP BY 1, 2)) "
        "JOIN (SELECT primary_artist, genre FROM tracks WHERE genre IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY primary_artist ORDER BY count(*) DESC, genre) = 1) g USING (primary_artist)",
    ),
    "a10_resolution_report": (
        of_tracks(_report),
        _T[:-1] + ", k AS (SELECT *, lower(primary_artist) || '|' || lower(title) AS key FROM tracks), b AS (SELECT key, arg_max(recording_id, (size_bytes, recording_id)) AS leader FROM k GROUP BY 1 HAVING count(*) > 1), "
        "d AS (SELECT leader, recording_id, CASE WHEN recording_id = leader THEN 'keep' WHEN file_type IN ('flac', 'wav') THEN 'move' ELSE 'delete' END AS action, size_bytes FROM k JOIN b USING (key)) "
        "SELECT 'summary' AS section, '{\"groups\":' || count(DISTINCT leader) || ',\"kept\":' || count(*) FILTER (action = 'keep') || ',\"moved\":' || count(*) FILTER (action = 'move') || ',\"deleted\":' || "
        "count(*) FILTER (action = 'delete') || ',\"saved\":' || coalesce(sum(size_bytes) FILTER (action = 'delete'), 0) || '}' AS content FROM d UNION ALL "
        "SELECT 'decision', '{\"leader\":\"' || leader || '\",\"recording_id\":\"' || recording_id || '\",\"action\":\"' || action || '\",\"size_bytes\":' || size_bytes || '}' FROM d",
    ),
    "d5_fill_from_lookup": (
        of_tracks(_filled),
        _T + "SELECT recording_id, primary_artist, title, album, coalesce(year, y) AS year, coalesce(genre, g) AS genre, concat_ws('|', CASE WHEN year IS NULL THEN 'year' END, "
        "CASE WHEN genre IS NULL AND g IS NOT NULL THEN 'genre' END) AS filled FROM (SELECT *, coalesce(min(year) OVER w, 1900) AS y, max(genre) OVER w AS g FROM tracks WINDOW w AS (PARTITION BY primary_artist, title, album))",
    ),
    "g32_estimate": (
        of_tracks(lambda t: lookups.estimate_from_sample(t, _kind(), 100)),
        _T + "SELECT kind, count(*) AS sampled, round(count(*) * (SELECT count(*) FROM tracks) / 100, 2) AS files, round(sum(size_bytes) / 1048576 * ((SELECT count(*) FROM tracks) / 100), 2) AS megabytes FROM "
        "(SELECT size_bytes, CASE WHEN contains(title, '(Live)') THEN 'live' WHEN album = 'Greatest Hits' THEN 'compilation' WHEN title LIKE '% Demo' THEN 'rarity' WHEN contains(artists_raw, ',') THEN 'collaboration' ELSE 'studio' END AS kind "
        "FROM tracks ORDER BY recording_id LIMIT 100) GROUP BY 1",
    ),
    "d15_genre_moods": (
        of_tracks(lambda t: t.select("recording_id", tags.genre_mood(F.col("genre"), MOODS).alias("mood")).filter("mood IS NOT NULL")),
        _T + "SELECT recording_id, CASE lower(genre) WHEN 'rock' THEN 'energetic' WHEN 'jazz' THEN 'relaxed' END AS mood FROM tracks WHERE lower(genre) IN ('rock', 'jazz')",
    ),
    "e11_pair_scores": (
        of_tracks(_scored),
        _T[:-1] + f", s AS (SELECT a.recording_id AS one, b.recording_id AS other, {_share('a.title', 'b.title')} AS title, len(list_filter({_BARE.format('a')}, lambda n: list_contains({_BARE.format('b')}, n))) "
        f"/ greatest(len(string_split(a.artists_raw, ', ')), len(string_split(b.artists_raw, ', '))) AS artist, {_share('a.album', 'b.album')} AS album, "
        "greatest(0::DOUBLE, 1 - abs(a.duration_seconds - b.duration_seconds) / 30) AS duration FROM tracks a JOIN tracks b ON a.ord1 = b.ord1 AND b.ord2 = a.ord2 + 1) "
        "SELECT one, other, round(title, 6) AS title, round(artist, 6) AS artist, round(album, 6) AS album, round(duration, 6) AS duration, round(0.4::DOUBLE * title + 0.35::DOUBLE * artist + 0.15::DOUBLE * album + 0.1::DOUBLE * duration, 6) AS overall, "
        "0.4::DOUBLE * title + 0.35::DOUBLE * artist + 0.15::DOUBLE * album + 0.1::DOUBLE * duration >= 0.85 AND title >= 0.8 AND artist >= 0.9 AS is_similar FROM s",
    ),
    "g18_collection_rollup": (
        _nested,
        "WITH RECURSIVE own AS (SELECT c_custkey AS node, count(o_custkey) AS items, CAST(coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)), 0) AS BIGINT) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1), "
        "up AS (SELECT c_custkey AS node, c_custkey AS above FROM customer UNION ALL SELECT node, above // 2 FROM up WHERE above // 2 > 0) "
        "SELECT a.node, a.items, a.total, CAST(sum(o.items) AS BIGINT) AS nested_items, CAST(sum(o.total) AS BIGINT) AS nested_total, false AS in_cycle FROM own a JOIN up ON up.above = a.node JOIN own o ON o.node = up.node GROUP BY 1, 2, 3",
    ),
    "g23_scan_stats": (
        _scans,
        f"{_L.split(', latest AS')[0]}, c AS ({catalog.INVENTORY_CUR_SQL}), s AS (SELECT session_id, min(ts) AS started, count(*) AS files, bool_and(status = 'completed') AS done FROM op_log GROUP BY 1) "
        "SELECT 'tracked' AS kind, NULL AS session_id, NULL AS started, count(DISTINCT path) AS files FROM c UNION ALL "
        "(SELECT 'last completed', session_id, started, files FROM s WHERE done ORDER BY started DESC, session_id LIMIT 1) UNION ALL (SELECT 'recent', session_id, started, files FROM s ORDER BY started DESC, session_id LIMIT 10)",
    ),
}
