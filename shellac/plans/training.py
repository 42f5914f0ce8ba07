"""Queries that learn genres and moods; only their texts have equivalents in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shellac.functions import tags
from shellac.operators import classify, training
from shellac.plans.classifying import features
from shellac.plans.queries import _T, Query, of_tracks
from shellac.sources import catalog


def _text() -> Column:
    return training.genre_text(F.col("title"), F.col("album"), F.col("primary_artist"), F.col("year"), F.col("duration_seconds"))


def _genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalog.tracks(spark, sf_dir).select("recording_id", _text().alias("text"), tags.standard_genre(F.col("genre")).alias("genre"))
    split = training.split_rows(rows, "genre", ["recording_id"])
    found = training.predict_genre(training.train_genre(split), split)
    return found.select("recording_id", "held_out", "genre", F.array_join("genres.label", "|").alias("genres"), F.round(F.get("genres", F.lit(0))["chance"], 3).alias("chance"))


def _moods(spark: SparkSession, sf_dir: str) -> DataFrame:
    quadrant = F.when(F.col("valence").isNotNull(), classify.mood_quadrant(F.col("valence"), F.col("energy")))
    split = training.split_rows(features(spark, sf_dir).withColumn("mood", quadrant), "mood", ["vec_id"])
    found = training.predict_mood(training.train_mood(split), split)
    return found.select("vec_id", "held_out", "mood", F.array_join("moods.label", "|").alias("moods"), F.round(F.get("moods", F.lit(0))["chance"], 3).alias("chance"))


_BARE = "regexp_replace(regexp_replace({}, '\\([^)]*\\)', '', 'g'), '\\[[^\\]]*\\]', '', 'g')"

#: name: (query, SQL)
PAIRS: dict[str, tuple[Query, str]] = {
    "k16_genre_text": (
        of_tracks(lambda t: t.select("recording_id", _text().alias("text"))),
        _T + f"SELECT recording_id, concat_ws(' ', {_BARE.format('title')}, {_BARE.format('album')}, primary_artist, 'decade_' || CAST(floor(year / 10) * 10 AS INT), "
        "CASE WHEN duration_seconds < 120 THEN 'very_short' WHEN duration_seconds < 240 THEN 'short' WHEN duration_seconds < 360 THEN 'medium' WHEN duration_seconds < 600 THEN 'long' ELSE 'extended' END) AS text FROM tracks",
    ),
}

WITHOUT_SQL: dict[str, Query] = {"k17_genre_predictions": _genres, "k18_mood_predictions": _moods}
