"""Queries on advice, previews, all types of a track and named functions, and their equivalents in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shellac.functions import named
from shellac.operators import advice, classify, recommend, resolution
from shellac.plans.classifying import _has
from shellac.plans.measures import _lev
from shellac.plans.planning import _kind
from shellac.plans.queries import _T, Query, of_tracks
from shellac.plans.recommending import _FACTS, _POINTS, _STRATEGIES
from shellac.plans.upkeep import _KIND
from shellac.sources import catalog

SAMPLE = 20
#: Titles and the same with two letters swapped and the next left out.
_SWAPPED_SQL = f"SELECT DISTINCT title AS a, concat(substr(title, 2, 1), substr(title, 1, 1), substr(title, 4)) AS b FROM ({catalog.TRACKS_SQL}) t"


def _swapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = catalog.view(spark, sf_dir, _SWAPPED_SQL)
    return pairs.select("a", "b", F.round(named.damerau_similarity(F.col("a"), F.col("b")), 6).alias("score"))


def _by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    named.register_functions(spark)
    text = "SELECT a, b, round(levenshtein_similarity(a, b), 6) AS lev, round(damerau_similarity(a, b), 6) AS damerau, round(word_jaccard(a, b), 6) AS jaccard FROM {pairs}"
    return spark.sql(text, pairs=catalog.view(spark, sf_dir, _SWAPPED_SQL))


def _advice(tracks: DataFrame) -> DataFrame:
    facts = recommend.library_facts(tracks, _kind())
    best = recommend.recommend_strategies(facts, 1)
    return advice.advise(facts, best, resolution.duplicate_likelihood(tracks), advice.mixture(tracks, _kind()))


def _preview(tracks: DataFrame) -> DataFrame:
    best = recommend.recommend_strategies(recommend.library_facts(tracks, _kind()), 1)
    return advice.preview(tracks, best, _kind(), SAMPLE)


def _all_types(tracks: DataFrame) -> DataFrame:
    found = classify.all_types(F.col("title"), F.col("album"), F.col("primary_artist"), F.col("genre"), F.col("duration_seconds"), F.expr("CASE WHEN ord2 % 2 = 0 THEN album END"))
    rows = tracks.select("recording_id", found.alias("f"))
    return rows.select("recording_id", F.array_join("f.kind", "|").alias("kinds"), F.round(F.col("f.score")[0], 6).alias("score"))


_BEST = _FACTS + f", best AS (SELECT strategy, complexity, folders FROM facts, {_STRATEGIES} ORDER BY round(least(1.0, {_POINTS})::DOUBLE, 6) DESC, strategy DESC LIMIT 1) "
_ALIKE = (
    ", alike AS (SELECT count(*) FILTER (n > 1) / count(*) AS likelihood FROM (SELECT count(*) AS n FROM tracks "
    "GROUP BY regexp_replace(lower(primary_artist), '[^a-z0-9]', '', 'g') || '_' || regexp_replace(lower(title), '[^a-z0-9]', '', 'g'))) "
)
_MIXED = (
    ", mixed AS (SELECT count(DISTINCT file_type) AS formats, (SELECT file_type FROM tracks GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS commonest, "
    f"count(*) FILTER (file_type IN ('flac', 'wav', 'aiff')) AS lossless, count(*) FILTER ({_KIND} = 'live') AS live, count(*) FILTER ({_KIND} = 'compilation') AS compilation FROM tracks) "
)
_ADVICE = (
    ("quick_win", "completeness < 0.8", "'Fix missing metadata using MusicBrainz enhancement'"),
    ("quick_win", "likelihood > 0.1", "'Remove duplicates to clean up the library'"),
    ("quick_win", "chaos > 0.5", "'Consolidate scattered files into logical folders'"),
    ("quick_win", "formats > 3", "'Convert or organize different audio formats consistently'"),
    ("quick_win", "contains(folders, 'genre') AND genres < 3", "'Add genre tags for better categorization'"),
    ("issue", "completeness < 0.6", "'Low metadata quality may result in poor organization'"),
    ("issue", "tracks > 50000 AND complexity = 'complex'", "'Complex organization may be slow with very large libraries'"),
    ("issue", "genres > 20 AND contains(folders, 'genre')", "'Too many genres may create deep folder structures'"),
    ("issue", "likelihood > 0.2", "'High likelihood of duplicates may waste space'"),
    ("issue", "chaos > 0.8", "'Very disorganized library may need manual cleanup first'"),
    ("rule", "compilation > 5", "'Compilation Handling: Compilations/{albumartist}/{album} ({year})'"),
    ("rule", "live > 5", "'Live Recordings: Live/{artist}/{album} ({year})'"),
    ("rule", "compilation > tracks * 0.1", "'Various Artists: Compilations/{albumartist}/{album} ({year})'"),
    ("rule", "lossless > tracks * 0.3", "'High Quality Separation: High Quality/{artist}/{album} ({year})'"),
    ("step", "likelihood > 0.1", "'Run duplicate detection and remove/rename duplicates'"),
    ("step", "completeness < 0.7", "'Run MusicBrainz metadata enhancement'"),
    ("step", "formats > 2", "'Consider converting non-' || commonest || ' files for consistency'"),
    ("step", "chaos > 0.6", "'Manual cleanup of folder structure inconsistencies'"),
    ("step", "true", "'Normalize filenames to consistent pattern'"),
)
_ADVICE_SQL = " UNION ALL ".join(f"SELECT '{kind}' AS kind, {i} AS spot, {text} AS text FROM w WHERE {condition}" for i, (kind, condition, text) in enumerate(_ADVICE))
_Y = "coalesce(CAST(year AS VARCHAR), '')"
_G = "coalesce(genre, 'Unknown')"
_FOLDER = (
    f"CASE strategy WHEN 'artist_album' THEN concat(primary_artist, '/', album, ' (', {_Y}, ')') WHEN 'genre_artist_album' THEN concat({_G}, '/', primary_artist, '/', album, ' (', {_Y}, ')') "
    f"WHEN 'decade_artist_album' THEN concat(coalesce(CAST(year // 10 * 10 AS VARCHAR) || 's', 'unknown'), '/', primary_artist, '/', album, ' (', {_Y}, ')') "
    f"WHEN 'smart_content_type' THEN concat({_KIND}, '/', primary_artist, '/', album, ' (', {_Y}, ')') "
    "WHEN 'flat_smart' THEN concat(upper(left(primary_artist, 1)), '/', primary_artist, ' - ', album, ' - ', title) "
    f"ELSE concat({_G}, '/', {_KIND}, '/', primary_artist, '/', album, ' (', {_Y}, ')') END"
)


def _matched(text: str, patterns: tuple[str, ...], points: str) -> str:
    return _has(text, ";".join(patterns), points)


_KINDS_SQL = (
    "low AS (SELECT recording_id, ord2, lower(title) AS t, lower(album) AS a, lower(primary_artist) AS w, lower(coalesce(genre, '')) AS g, "
    "CASE WHEN ord2 % 2 = 0 THEN CASE WHEN contains(a, 'soundtrack') THEN 'soundtrack' WHEN contains(a, 'live') THEN 'live_recording' END END AS hint FROM tracks), "
    f"s AS (SELECT recording_id, hint, {_matched('t', classify.ALL_REMIX, '0.3')} + {_matched('a', classify.ALL_REMIX, '0.2')} + CASE WHEN contains(g, 'electronic') THEN 0.1::DOUBLE ELSE 0 END AS remix, "
    f"{_matched('t', classify.ALL_PODCAST, '0.25')} AS podcast, {_matched('t', classify.ALL_SPOKEN, '0.3')} + {_matched('a', classify.ALL_SPOKEN, '0.3')} AS spoken_word, "
    f"{_matched('a', classify.ALL_SCREEN, '0.35')} + {_matched('t', classify.ALL_SCREEN, '0.2')} AS soundtrack FROM low), "
    "r AS (SELECT recording_id, hint AS kind, 0 AS spot, 0.9::DOUBLE AS score FROM s WHERE hint IS NOT NULL "
    + "".join(f"UNION ALL SELECT recording_id, '{kind}', {i}, least(1.0::DOUBLE, {kind}) * 0.8 FROM s WHERE {kind} > 0 AND hint IS DISTINCT FROM '{kind}' " for i, kind in enumerate(("remix", "podcast", "spoken_word", "soundtrack"), 1))
    + "), g AS (SELECT recording_id, string_agg(kind, '|' ORDER BY round(score, 9) DESC, spot) AS kinds, max(score) AS score FROM r GROUP BY 1) "
)

#: name: (query, SQL)
PAIRS: dict[str, tuple[Query, str]] = {
    "e2_damerau_similarity": (_swapped, f"SELECT a, b, round(1 - damerau_levenshtein(a, b) / greatest(length(a), length(b)), 6) AS score FROM ({_SWAPPED_SQL})"),
    "p5_named_functions": (
        _by_name,
        f"SELECT a, b, round({_lev('a', 'b')}, 6) AS lev, round(1 - damerau_levenshtein(a, b) / greatest(length(a), length(b)), 6) AS damerau, "
        "round(len(list_intersect(x, y)) / len(list_distinct(x || y)), 6) AS jaccard "
        f"FROM (SELECT a, b, string_split(lower(a), ' ') AS x, string_split(lower(b), ' ') AS y FROM ({_SWAPPED_SQL}))",
    ),
    "k6_all_types": (
        of_tracks(_all_types),
        f"{_T}, {_KINDS_SQL} SELECT recording_id, coalesce(kinds, 'unknown') AS kinds, round(coalesce(score, 0.5::DOUBLE), 6) AS score FROM low LEFT JOIN g USING (recording_id)",
    ),
    "l10_advise": (
        of_tracks(_advice),
        _BEST + _ALIKE + _MIXED + ", w AS (SELECT * FROM facts, best, alike, mixed) "
        f"SELECT kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY spot) AS INT) AS place, text FROM ({_ADVICE_SQL})",
    ),
    "l11_magic_preview": (
        of_tracks(_preview),
        _BEST + f"SELECT recording_id, path, concat({_FOLDER}, '/', lpad(CAST(track_number AS VARCHAR), 2, '0'), '. ', title, '.', file_type) AS target FROM tracks, best ORDER BY recording_id LIMIT {SAMPLE}",
    ),
}
