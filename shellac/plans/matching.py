"""Queries on best matches and chroma features, and their equivalents in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shellac.operators import covers, matching
from shellac.plans.queries import _T, Query, of_tracks

K = 10
LEAST = 0.2


def _matches(tracks: DataFrame) -> DataFrame:
    """Artists as an outside list spells them, without "The " and the last letter, against the catalog's."""
    names = tracks.select("primary_artist").distinct()
    outside = names.select(F.expr("regexp_replace(left(primary_artist, length(primary_artist) - 1), '^The ', '')").alias("text"))
    numbered = tracks.groupBy(F.col("primary_artist").alias("text")).agg(F.min(F.col("ord1") * 100 + F.col("ord2")).alias("place"))
    return matching.best_matches(outside, numbered)


def _chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight frames of eight features a track, from the embeddings."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    frames = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
    return rows.select(F.col("vec_id").alias("id"), (30 + F.col("vec_id") % 300).cast("double").alias("seconds"), frames.alias("frames"))


def _queried(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tracks = _chroma(spark, sf_dir)
    return tracks.filter("id % 50 = 0"), tracks


def _similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = covers.similar_tracks(*_queried(spark, sf_dir), "correlation", 0.0, k=K)
    return found.select("query", "track", F.round("score", 6).alias("score"), F.round("ratio", 6).alias("ratio"))


def _covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = covers.find_covers(*_queried(spark, sf_dir), "correlation", LEAST, LEAST)
    return found.select("query", "track", F.round("score", 6).alias("score"), F.round("ratio", 6).alias("ratio"), "confidence")


def _chroma_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = covers.chroma_matches(*_queried(spark, sf_dir))
    return found.select("query", "track", F.round("score", 6).alias("score"), F.round("ratio", 6).alias("ratio"), "is_cover")


#: CTE `m`: each query with every other track of nearly its length, and their correlation.
_PAIRS_SQL = (
    "WITH c AS (SELECT vec_id AS id, 30 + vec_id % 300 AS seconds, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), z AS (SELECT id, seconds, list_transform(e, lambda v: v - list_avg(e)) AS d FROM c), "
    "m AS (SELECT q.id AS query, t.id AS track, greatest(0, list_dot_product(q.d, t.d) / sqrt(list_dot_product(q.d, q.d) * list_dot_product(t.d, t.d))) AS s, "
    "least(q.seconds, t.seconds) / greatest(q.seconds, t.seconds) AS ratio FROM z q JOIN z t ON q.id % 50 = 0 AND q.id <> t.id WHERE ratio >= 0.5) "
)

#: name: (query, SQL)
PAIRS: dict[str, tuple[Query, str]] = {
    "d2_best_matches": (
        of_tracks(_matches),
        _T[:-1] + ", n AS (SELECT primary_artist AS text, min(ord1 * 100 + ord2) AS place FROM tracks GROUP BY 1), t AS (SELECT DISTINCT regexp_replace(left(text, length(text) - 1), '^The ', '') AS target FROM n), "
        "s AS (SELECT target, text, place, 1 - levenshtein(target, text) / greatest(length(target), length(text)) AS score FROM t, n) "
        "SELECT target, text AS match, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY target ORDER BY score DESC, place) = 1",
    ),
    "f20_similar_tracks": (_similar, _PAIRS_SQL + f"SELECT query, track, round(s, 6) AS score, round(ratio, 6) AS ratio FROM m QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, track) <= {K}"),
    "f18_covers": (
        _covers,
        _PAIRS_SQL + f"SELECT query, track, round(s, 6) AS score, round(ratio, 6) AS ratio, CASE WHEN s >= 0.75 THEN 'high' WHEN s >= 0.6 THEN 'medium' ELSE 'low' END AS confidence FROM m WHERE s >= {LEAST}",
    ),
}

#: Warping has no form in SQL; tests hold it against a plain table.
WITHOUT_SQL: dict[str, Query] = {"f19_chroma_matches": _chroma_matches}
