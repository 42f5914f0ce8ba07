"""Queries on genre votes and confidence, and their equivalents in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shellac.operators import votes
from shellac.operators.rules import Condition, Rule
from shellac.plans.classifying import features
from shellac.plans.queries import _T, Query, of_tracks


def _voted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column, Column]:
    """Features, a genre for every third of the rows, and the votes; every fifth and seventh row has a rule's vote."""
    rows = features(spark, sf_dir)
    genre = F.when(F.col("vec_id") % 3 == 0, "Rock")
    voters = [(F.col("vec_id") % 5 == 0, "Blues", 0.75), (F.col("vec_id") % 7 == 0, "Soul", 0.6)]
    return rows, genre, votes.genre_votes(genre, {n: F.col(n) for n in ("acousticness", "danceability")}, voters)


def _genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, found = _voted(spark, sf_dir)
    out = rows.select("vec_id", found.alias("v"))
    return out.select("vec_id", "v.primary", *[F.array_join(f"v.{c}", "|").alias(c) for c in ("secondary", "sub")], F.round("v.confidence", 6).alias("confidence"))


def _confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, genre, found = _voted(spark, sf_dir)
    level = F.when(F.col("vec_id") % 4 == 0, "low").when(F.col("vec_id") % 4 == 1, "high").otherwise("medium")
    score = votes.overall_confidence(F.lit(0.9), found["confidence"], F.col("energy").isNotNull(), level)
    tags = F.when(F.col("vec_id") % 2 == 0, F.array(F.lit("Soul"), F.lit("mine")))
    own = F.when(F.col("vec_id") % 11 == 0, "Ska")
    genres = F.array_compact(F.concat(F.array(found["primary"]), found["secondary"], found["sub"]))
    return rows.select("vec_id", F.round(score, 6).alias("confidence"), F.array_join(votes.corrected_genres(genres, own, tags), "|").alias("genres"))


KINDS = [
    (Rule("concert", (Condition("title", "contains", "(live)"),)), "live", 0.9),
    (Rule("old rock", (Condition("genre", "eq", "rock"), Condition("year", "lt", 1980))), "rarity", 0.6),
    (Rule("best of", (Condition("album", "eq", "greatest hits"),)), "compilation", 0.9),
]


def _kinds(tracks: DataFrame) -> DataFrame:
    return tracks.select("recording_id", votes.best_kind(KINDS).alias("found")).select("recording_id", "found.kind", "found.confidence", "found.rule")


_VALUE = "least(1.0::DOUBLE, greatest(0.0::DOUBLE, 0.5 + 2 * embedding[{}]::DOUBLE))"
_VOTES = (
    f"WITH f AS (SELECT vec_id, vec_id % 13 <> 0 AS has, {_VALUE.format(3)} AS dance, {_VALUE.format(4)} AS acoustic FROM embeddings), "
    "v AS (SELECT vec_id, has, CASE WHEN vec_id % 3 = 0 THEN 'Rock' WHEN vec_id % 5 = 0 THEN 'Blues' END AS \"primary\", "
    "concat_ws('|', CASE WHEN vec_id % 15 = 0 THEN 'Blues' END, CASE WHEN vec_id % 7 = 0 THEN 'Soul' END) AS secondary, "
    "concat_ws('|', CASE WHEN has AND acoustic > 0.7 THEN 'acoustic' END, CASE WHEN has AND dance > 0.7 THEN 'dance' END) AS sub, "
    "round(0.2::DOUBLE * ((vec_id % 3 = 0 OR vec_id % 5 = 0)::INT + (vec_id % 15 = 0)::INT + (vec_id % 7 = 0)::INT + (has AND acoustic > 0.7)::INT + (has AND dance > 0.7)::INT), 6) AS confidence FROM f) "
)

#: name: (query, SQL)
PAIRS: dict[str, tuple[Query, str]] = {
    "k13_best_kind": (
        of_tracks(_kinds),
        _T + "SELECT recording_id, CASE r WHEN 1 THEN 'live' WHEN 2 THEN 'compilation' WHEN 3 THEN 'rarity' END AS kind, CASE WHEN r < 3 THEN 0.9 WHEN r = 3 THEN 0.6 END::DOUBLE AS confidence, "
        "CASE r WHEN 1 THEN 'concert' WHEN 2 THEN 'best of' WHEN 3 THEN 'old rock' END AS rule FROM (SELECT recording_id, "
        "CASE WHEN contains(title, '(Live)') THEN 1 WHEN album = 'Greatest Hits' THEN 2 WHEN genre = 'Rock' AND year < 1980 THEN 3 END AS r FROM tracks)",
    ),
    "k14_genre_votes": (_genres, _VOTES + 'SELECT vec_id, "primary", secondary, sub, confidence FROM v'),
    "k15_confidence": (
        _confidence,
        _VOTES + "SELECT vec_id, round(least(1.0::DOUBLE, (0.9::DOUBLE * 0.4 + confidence * 0.4 + CASE WHEN has THEN 0.3 ELSE 0 END) * CASE vec_id % 4 WHEN 0 THEN 0.7 WHEN 1 THEN 1.2 ELSE 1 END), 6) AS confidence, "
        "concat_ws('|', CASE WHEN vec_id % 11 = 0 THEN 'Ska' ELSE nullif(concat_ws('|', \"primary\", nullif(secondary, ''), nullif(sub, '')), '') END, "
        "CASE WHEN vec_id % 2 = 0 AND (vec_id % 11 = 0 OR vec_id % 7 <> 0) THEN 'Soul' END, CASE WHEN vec_id % 2 = 0 THEN 'mine' END) AS genres FROM v",
    ),
}
