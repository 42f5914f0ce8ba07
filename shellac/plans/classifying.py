"""Queries on content types, genres and moods, and their equivalents in DuckDB's SQL.

The SQL repeats the rules with values of its own, written out from the same fixed tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shellac.functions import tags
from shellac.operators import classify
from shellac.plans.queries import _T, Query, of_tracks

_NAMES = ("valence", "energy", "danceability", "acousticness")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of each vector: its first four components, spread over 0 to 1; every 13th row has none."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    value = lambda i: F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + 2 * F.element_at("embedding", i).cast("double")))
    return vectors.select("vec_id", *[F.when(F.col("vec_id") % 13 != 0, value(i + 1)).alias(n) for i, n in enumerate(_NAMES)])


def _content(tracks: DataFrame) -> DataFrame:
    artists = tags.split_artists(F.col("artists_raw"))
    none = F.lit(None).cast("string")
    scores = classify.content_scores(*map(F.col, ("title", "album", "primary_artist")), artists, F.col("genre"), F.col("path"), none)
    typed = tracks.select("recording_id", "title", "album", artists.alias("artists"), classify.content_type(scores).alias("found"))
    return typed.select("recording_id", "title", "album", "artists", "found.kind", "found.score")


def _extended(tracks: DataFrame) -> DataFrame:
    found = classify.extended_type(*map(F.col, ("title", "album", "primary_artist", "genre", "duration_seconds")))
    return tracks.select("recording_id", found.alias("f")).select("recording_id", "f.kind", F.round("f.score", 6).alias("score"))


def _genres(tracks: DataFrame) -> DataFrame:
    found = classify.genres_of(*map(F.col, ("title", "album", "primary_artist", "genre")))
    return tracks.select("recording_id", found.alias("f")).select("recording_id", F.array_join("f.genres", "|").alias("genres"), "f.confidence")


def _moods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify.moods_of_features(*map(F.col, _NAMES))
    rows = features(spark, sf_dir).select("vec_id", found.alias("m"))
    return rows.select("vec_id", F.array_join(F.col("m.mood"), "|").alias("moods"), F.round(F.col("m")[0]["score"], 6).alias("best"))


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir)
    return rows.select("vec_id", classify.energy_level(F.col("energy")).alias("level"), (F.coalesce("acousticness", F.lit(0.0)) > 0.5).alias("acoustic"))


def _quadrant(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features(spark, sf_dir).filter("valence IS NOT NULL")
    return rows.select("vec_id", classify.mood_quadrant(F.col("valence"), F.col("energy")).alias("mood"))


def _has(text: str, patterns: str, points: str, whole: bool = False) -> str:
    """Points for each of the patterns (parted by ;) that a text matches."""
    edge = "\\b" if whole else ""
    return " + ".join(f"CASE WHEN regexp_matches({text}, '{edge}{p}{edge}') THEN {points}::DOUBLE ELSE 0 END" for p in patterns.split(";"))


_LIVE_SQL = "\\blive\\b;live at;live in;bootleg;recording;concert;performance;show;festival"
_DATES_SQL = "\\d{4}-\\d{2}-\\d{2};\\d{2}/\\d{2}/\\d{4};\\d{1,2}\\.\\d{1,2}\\.\\d{4}"
_HITS_SQL = "greatest hits;best of;the best;essential;collection;anthology;gold;platinum;ultimate;hits;singles;the very best"
_RARE_SQL = "demo;rare;unreleased;bonus;extra;special edition;limited edition;anniversary;deluxe;remastered;expanded;bootleg"
_LOW = "low AS (SELECT *, lower(title) AS t, lower(album) AS a, lower(primary_artist) AS w, lower(coalesce(genre, '')) AS g, lower(path) AS p, regexp_extract(lower(path), '([^/]*)$', 1) AS f, string_split(artists_raw, ', ') AS names FROM tracks)"
_SCORES = (
    f"{_LOW}, scored AS (SELECT recording_id, t, a, names, "
    + "least(1.0::DOUBLE, " + " + ".join(f"{_has(x, _LIVE_SQL, '0.3')} + {_has(x, _DATES_SQL, '0.2')}" for x in "atf")
    + " + 0.2::DOUBLE * len(list_filter(string_split(path, '/'), lambda x: regexp_matches(x, '\\b\\d{4}\\s+-\\s+.+\\b|,\\s*[A-Z]{2}$|,\\s*[A-Za-z\\s]+$')))) AS live, "
    "greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE len(names) WHEN 2 THEN 0.7::DOUBLE WHEN 3 THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(a, ' with | and | & | featuring | feat |featuring |presents') THEN 0.4::DOUBLE ELSE 0 END "
    "+ CASE WHEN contains(f, ' & ') OR contains(f, ' and ') THEN 0.4::DOUBLE ELSE 0 END - CASE WHEN contains(g, 'jazz') THEN 0.2::DOUBLE ELSE 0 END)) AS together, "
    f"least(1.0::DOUBLE, {_has('a', _HITS_SQL, '0.4', True)} + {_has('t', _HITS_SQL, '0.4', True)}) AS hits, "
    f"least(1.0::DOUBLE, {_has('a', _RARE_SQL, '0.3', True)} + {_has('t', _RARE_SQL, '0.3', True)} + {_has('p', _RARE_SQL, '0.2', True)}) AS rare FROM low), "
    "typed AS (SELECT *, CASE WHEN together > 0.6::DOUBLE THEN 'collaboration' WHEN live > 0.5::DOUBLE THEN 'live' WHEN hits > 0.6::DOUBLE THEN 'compilation' WHEN rare > 0.6::DOUBLE THEN 'rarity' ELSE 'studio' END AS kind, "
    "CASE WHEN together > 0.6::DOUBLE THEN together WHEN live > 0.5::DOUBLE THEN live WHEN hits > 0.6::DOUBLE THEN hits WHEN rare > 0.6::DOUBLE THEN rare ELSE 0.5 END AS score FROM scored)"
)
_SIGNS = " + ".join(
    f"(regexp_matches(a || ' ' || t, '{'|'.join(p if raw else f'{chr(92)}b{p}{chr(92)}b' for p in patterns.split(';'))}'))::INT"
    for patterns, raw in ((_LIVE_SQL, True), (_HITS_SQL, False), (_RARE_SQL, False))
)
_GENRE = "CASE WHEN genre IN ('Rock', 'rock, pop') THEN 'rock' WHEN genre = 'R&B' THEN 'rnb' WHEN genre = 'electronica' THEN 'electronic' WHEN genre = 'Jazz' THEN 'jazz' END"
_WORDS_SQL = {
    "electronic": "remix|dj|club|techno|house|trance|edm",
    "rock": "rock|metal|punk|grunge|alternative",
    "hiphop": "hip|hop|rap|trap",
    "jazz": "jazz|swing|fusion",
    "classical": "classical|symphony|orchestra|concerto",
    "country": "country|folk|bluegrass",
    "reggae": "reggae|dancehall",
    "blues": "blues",
    "ambient": "ambient|chillout|downtempo",
    "soundtrack": "soundtrack|ost|score",
}
_FOUND = f"list_sort(list_distinct(list_filter([{_GENRE}, " + ", ".join(f"CASE WHEN regexp_matches(x, '\\b({p})\\b') THEN '{g}' END" for g, p in _WORDS_SQL.items()) + "], lambda z: z IS NOT NULL)))"
_REMIX_SQL = "remix;mix;edit;version;bootleg;mashup;flip;refix;rework"
_POD_SQL = "podcast;episode;ep\\.\\s*\\d+;pt\\.\\s*\\d+;feat\\.;interview;season\\s+\\d+"
_SPOKEN_SQL = "spoken\\s*word;audiobook;book\\s*\\d+;chapter\\s*\\d+;narrat;speech;lecture;standup?;comedy"
_SCREEN_SQL = "soundtrack;\\bost\\b;score;original\\s*motion\\s*picture;from\\s+the\\s+movie;from\\s+the\\s+film"
_FEATURES = "f AS (SELECT vec_id, " + ", ".join(f"CASE WHEN vec_id % 13 <> 0 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.5::DOUBLE + 2 * embedding[{i + 1}]::DOUBLE)) END AS {n}" for i, n in enumerate(_NAMES)) + " FROM embeddings)"
_MOODS_SQL = (
    "(0, 'happy', .6, 1, .5, 1, .5, 1, NULL, NULL), (1, 'sad', 0, .4, 0, .5, 0, .5, NULL, NULL), (2, 'energetic', .4, 1, .7, 1, .6, 1, NULL, NULL), (3, 'calm', .4, .8, 0, .4, 0, .4, NULL, NULL), "
    "(4, 'angry', 0, .4, .6, 1, .3, .8, NULL, NULL), (5, 'relaxed', .5, 1, 0, .4, NULL, NULL, .3, 1), (6, 'melancholic', .2, .5, 0, .5, NULL, NULL, .2, 1), (7, 'uplifting', .7, 1, .5, 1, .4, 1, NULL, NULL), "
    "(8, 'dark', 0, .4, .3, .8, NULL, NULL, 0, .6), (9, 'bright', .6, 1, .3, .8, NULL, NULL, NULL, NULL)"
)
_POINTS = [f"CASE WHEN {v} BETWEEN {c}0 AND {c}1 THEN {w}::DOUBLE * (1 - least(abs({v} - ({c}0 + {c}1) / 2) / (({c}1 - {c}0) / 2 + 0.01::DOUBLE), 1.0::DOUBLE)) ELSE 0 END" for v, c, w in zip(_NAMES, "vedk", (2, 2, 1, 1), strict=True)]
_WEIGHTS = [f"CASE WHEN {v} BETWEEN {c}0 AND {c}1 THEN {w}::DOUBLE ELSE 0 END" for v, c, w in zip(_NAMES, "vedk", (2, 2, 1, 1), strict=True)]
_BOUNDS = ", ".join(f"{c}{i}::DOUBLE AS {c}{i}" for c in "vedk" for i in (0, 1))
_MOOD_WORDS_SQL = {
    "happy": "happy joy celebration upbeat fun party",
    "sad": "sad cry tears heartbreak lonely melancholy",
    "energetic": "energy power blast intense fierce",
    "calm": "calm peace serenity gentle quiet",
    "angry": "angry rage fury hate aggressive",
    "relaxed": "relax chill lounge mellow easy",
    "melancholic": "melanchol nostalgia wistful longing",
    "uplifting": "uplift inspire hope rise ascend",
    "dark": "dark gloomy bleak shadow nightmare",
    "bright": "bright light sunny radiant shine",
}
_MOOD_ROWS = ", ".join(f"({i}, '{m}', '{w}')" for i, (m, w) in enumerate(_MOOD_WORDS_SQL.items()))

#: name: (query, SQL)
PAIRS: dict[str, tuple[Query, str]] = {
    "k1_content_type": (
        of_tracks(lambda t: _content(t).select("recording_id", "kind", F.round("score", 6).alias("score"))),
        f"{_T}, {_SCORES} SELECT recording_id, kind, round(score, 6) AS score FROM typed",
    ),
    "k2_ambiguous": (
        of_tracks(lambda t: _content(t).select("recording_id", classify.is_ambiguous(*map(F.col, ("kind", "score", "title", "album", "artists"))).alias("ambiguous"))),
        f"{_T}, {_SCORES}, s AS (SELECT *, {_SIGNS} AS signs FROM typed) SELECT recording_id, NOT (kind = 'studio' AND score = 0.5 AND signs <= 1) AND "
        "((score < 0.6::DOUBLE AND score <> 0.5) OR signs + (len(names) > 1)::INT > 1 OR contains(a, 'greatest hits')) AS ambiguous FROM s",
    ),
    "k3_genre_rules": (
        of_tracks(_genres),
        f"{_T}, x AS (SELECT *, lower(concat_ws(' ', title, album, primary_artist)) AS x FROM tracks), n AS (SELECT recording_id, genre, {_FOUND} AS g FROM x) "
        "SELECT recording_id, array_to_string(g, '|') AS genres, CASE WHEN len(g) = 0 THEN 0.0::DOUBLE WHEN len(g) > 1 THEN 0.5::DOUBLE WHEN genre IS NOT NULL THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS confidence FROM n",
    ),
    "k4_normal_genre": (of_tracks(lambda t: t.select("recording_id", classify.normal_genre(F.col("genre")).alias("genre"))), f"{_T} SELECT recording_id, {_GENRE} AS genre FROM tracks"),
    "k5_extended_type": (
        of_tracks(_extended),
        f"{_T}, {_LOW}, s AS (SELECT recording_id, {_has('t', _REMIX_SQL, '0.3', True)} + {_has('a', _REMIX_SQL, '0.2', True)} + CASE WHEN contains(g, 'electronic') THEN 0.1::DOUBLE ELSE 0 END AS remix, {_has('t', _POD_SQL, '0.25')} AS podcast, "
        f"{_has('t', _SPOKEN_SQL, '0.3')} + {_has('a', _SPOKEN_SQL, '0.3')} AS spoken, {_has('a', _SCREEN_SQL, '0.35')} + {_has('t', _SCREEN_SQL, '0.2')} AS screen FROM low) "
        "SELECT recording_id, CASE WHEN remix >= 0.5 THEN 'remix' WHEN podcast >= 0.5 THEN 'podcast' WHEN spoken >= 0.5 THEN 'spoken_word' WHEN screen >= 0.5 THEN 'soundtrack' END AS kind, "
        "round(least(1.0::DOUBLE, CASE WHEN remix >= 0.5 THEN remix WHEN podcast >= 0.5 THEN podcast WHEN spoken >= 0.5 THEN spoken WHEN screen >= 0.5 THEN screen ELSE 0.0::DOUBLE END), 6) AS score FROM s",
    ),
    "k7_moods": (
        _moods,
        f"WITH {_FEATURES}, m AS (SELECT spot, mood, {_BOUNDS} FROM (VALUES {_MOODS_SQL}) v(spot, mood, v0, v1, e0, e1, d0, d1, k0, k1)), "
        f"s AS (SELECT vec_id, spot, mood, ({' + '.join(_POINTS)}) AS points, ({' + '.join(_WEIGHTS)}) AS weight FROM f, m WHERE valence IS NOT NULL), "
        "r AS (SELECT vec_id, mood, points / weight AS score, row_number() OVER (PARTITION BY vec_id ORDER BY points / weight DESC, spot) AS n FROM s WHERE weight > 0), "
        "g AS (SELECT vec_id, string_agg(mood, '|' ORDER BY n) AS moods, max(score) AS best FROM r WHERE n <= 3 GROUP BY 1) "
        "SELECT vec_id, CASE WHEN best >= 0.3::DOUBLE THEN moods ELSE 'unknown' END AS moods, round(CASE WHEN best >= 0.3::DOUBLE THEN best ELSE 1.0::DOUBLE END, 6) AS best FROM f LEFT JOIN g USING (vec_id)",
    ),
    "k8_moods_of_text": (
        of_tracks(lambda t: t.select("recording_id", F.array_join(classify.moods_of_text(F.concat_ws(" ", "title", "album"))["mood"], "|").alias("moods"))),
        f"{_T}, m AS (SELECT recording_id, spot, mood, len(list_filter(string_split(words, ' '), lambda w: contains(lower(title || ' ' || album), w))) AS n FROM tracks, (VALUES {_MOOD_ROWS}) v(spot, mood, words)) "
        "SELECT recording_id, coalesce(string_agg(mood, '|' ORDER BY least(n, 2) DESC, spot) FILTER (n > 0), 'unknown') AS moods FROM m GROUP BY 1",
    ),
    "k9_mood_quadrant": (
        _quadrant,
        f"WITH {_FEATURES} SELECT vec_id, CASE WHEN valence > 0.5 AND energy > 0.5 THEN 'happy' WHEN valence > 0.5 THEN 'relaxed' WHEN energy > 0.5 THEN 'angry' ELSE 'sad' END AS mood FROM f WHERE valence IS NOT NULL",
    ),
    "k10_energy_level": (
        _flags,
        f"WITH {_FEATURES} SELECT vec_id, CASE WHEN energy IS NULL THEN 'medium' WHEN energy < 0.2::DOUBLE THEN 'very_low' WHEN energy < 0.4::DOUBLE THEN 'low' WHEN energy < 0.6::DOUBLE THEN 'medium' WHEN energy < 0.8::DOUBLE THEN 'high' ELSE 'very_high' END AS level, "
        "coalesce(acousticness, 0) > 0.5 AS acoustic FROM f",
    ),
    "k11_energy_of_genre": (
        of_tracks(lambda t: t.select("recording_id", classify.energy_of_genre(F.col("genre")).alias("energy"))),
        f"{_T} SELECT recording_id, CASE WHEN genre IN ('Rock', 'rock, pop', 'electronica') THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS energy FROM tracks",
    ),
    "g10_content_types": (
        of_tracks(lambda t: _content(t).groupBy("kind").agg(F.count(F.lit(1)).alias("tracks"))),
        f"{_T}, {_SCORES} SELECT kind, count(*) AS tracks FROM typed GROUP BY 1",
    ),
}
