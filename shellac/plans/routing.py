"""Queries on routing, signatures and like names, and their equivalents in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shellac.functions import tags
from shellac.operators import fuzzy, routing
from shellac.operators.rules import Condition, Rule
from shellac.plans.queries import _T, Query, of_tracks

RULES = [
    Rule("jazz", (Condition("genre", "eq", "jazz"),), 50, template="Jazz/{if:year}{year}/{endif}{title}.{file_type}"),
    Rule("live", (Condition("title", "contains", "(live)"),), 100, template="Live/{primary_artist}/{title}.{file_type}"),
]
FALLBACK = "{primary_artist}/{title}.{file_type}"


def _columns() -> dict[str, Column]:
    return {n: F.col(n) for n in ("genre", "year", "title", "primary_artist", "file_type")}


def _signature(tracks: DataFrame) -> DataFrame:
    patterns = [("title", "\\(live", 1.0), ("artist", "customer", 0.5), ("album", "live at", 0.8)]
    artists = tags.split_artists(F.col("artists_raw"))
    score = routing.signature_score(F.col("title"), artists, F.col("album"), F.col("genre"), patterns, ("live", "jazz"), ("remix",))
    return tracks.select("recording_id", F.round(score, 6).alias("score"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of customers, suppliers and parts."""
    tables = {"customer": "c_name", "supplier": "s_name", "part": "p_name"}
    columns = [spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(c).alias("name")) for table, c in tables.items()]
    return columns[0].unionAll(columns[1]).unionAll(columns[2])


_LEV = "1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name))"
_ROUTE = (
    "CASE WHEN contains(title, '(Live)') THEN concat('Live/', primary_artist, '/', title, '.', file_type) "
    "WHEN genre = 'Jazz' THEN concat('Jazz/', coalesce(year || '/', ''), title, '.', file_type) ELSE concat(primary_artist, '/', title, '.', file_type) END AS target"
)

#: name: (query, SQL)
PAIRS: dict[str, tuple[Query, str]] = {
    "d3_similar_pairs": (
        lambda spark, sf_dir: fuzzy.similar_pairs(_names(spark, sf_dir), "name", 0.9),
        "WITH n AS (SELECT c_name AS name FROM customer UNION SELECT s_name FROM supplier UNION SELECT p_name FROM part) SELECT a.name AS one, b.name AS other, "
        f"round({_LEV}, 6) AS score FROM n a JOIN n b ON a.name < b.name AND {_LEV} >= 0.9 - 1e-9",
    ),
    "k12_signature_score": (
        of_tracks(_signature),
        _T + ", x AS (SELECT *, lower(concat_ws(' ', title, artists_raw, album, genre)) AS t, contains(artists_raw, ', ')::INT AS more FROM tracks) SELECT recording_id, "
        "round(greatest(0.0::DOUBLE, (contains(lower(title), '(live')::INT + 0.5::DOUBLE * more + 0.8::DOUBLE * contains(lower(album), 'live at')::INT + contains(t, 'live')::INT "
        "+ contains(t, 'jazz')::INT - 2 * contains(t, 'remix')::INT) / (3.8::DOUBLE + 0.5::DOUBLE * (1 + more))), 6) AS score FROM x",
    ),
    "l6_route_by_rules": (
        of_tracks(lambda t: t.select("recording_id", routing.route_by_rules(RULES, FALLBACK, _columns()).alias("target"))),
        _T + f"SELECT recording_id, {_ROUTE} FROM tracks",
    ),
    "l15_rule_preview": (
        of_tracks(lambda t: routing.rule_preview(t, RULES, FALLBACK, _columns(), 50)),
        _T + f"SELECT recording_id, path AS source, {_ROUTE}, CASE WHEN contains(title, '(Live)') THEN 'live' WHEN genre = 'Jazz' THEN 'jazz' END AS rule FROM tracks ORDER BY 1 LIMIT 50",
    ),
}
