"""Library, artist and release statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shellac.functions import tags


def exploded_artists(tracks: DataFrame) -> DataFrame:
    """A row for each track and artist."""
    return tracks.withColumn("artist", F.explode(tags.split_artists(F.col("artists_raw"))))


def library_stats(tracks: DataFrame) -> DataFrame:
    """One row: tracks, artists, albums, gigabytes, hours, mean bitrate."""
    artists = exploded_artists(tracks.select("artists_raw")).agg(F.countDistinct(F.lower("artist")).alias("artists"))
    totals = tracks.agg(
        F.count(F.lit(1)).alias("tracks"),
        F.countDistinct("primary_artist", "album").alias("albums"),
        F.sum("size_bytes").alias("bytes"),
        F.sum("duration_seconds").cast("long").alias("seconds"),
        F.round(F.avg("bitrate"), 6).alias("avg_bitrate"),
    )
    return totals.crossJoin(artists)  # two tables of one row


def distribution(tracks: DataFrame, value: Column) -> DataFrame:
    """(value, tracks, percent) without nulls."""
    counts = tracks.select(value.alias("value")).filter("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("tracks"))
    percent = F.round(100 * F.col("tracks") / F.sum("tracks").over(Window.partitionBy()), 6)
    return counts.withColumn("percent", percent)


def genre_distribution(tracks: DataFrame, min_count: int = 1) -> DataFrame:
    """(genre, tracks) of comma-separated genres."""
    genres = tracks.select(F.explode(F.split("genre", ",")).alias("genre")).select(F.trim("genre").alias("genre")).filter("genre <> ''")
    return genres.groupBy("genre").agg(F.count(F.lit(1)).alias("tracks")).filter(F.col("tracks") >= min_count)


def top_artists(tracks: DataFrame, k: int = 10) -> DataFrame:
    """The k artists with most tracks, by name among equals."""
    counts = tracks.groupBy("primary_artist").agg(F.count(F.lit(1)).alias("tracks"))
    return counts.orderBy(F.desc("tracks"), "primary_artist").limit(k)


def artist_stats(tracks: DataFrame) -> DataFrame:
    """(artist, tracks, releases, seconds, first_year, last_year, genres) of every artist; genres sorted."""
    return exploded_artists(tracks).groupBy("artist").agg(
        F.count(F.lit(1)).alias("tracks"),
        F.countDistinct("album").alias("releases"),
        F.sum("duration_seconds").cast("long").alias("seconds"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.array_join(F.sort_array(F.collect_set("genre")), "|").alias("genres"),
    )


def releases(tracks: DataFrame) -> DataFrame:
    """(primary_artist, album, tracks, seconds, bytes, year: the least)."""
    return tracks.groupBy("primary_artist", "album").agg(
        F.count(F.lit(1)).alias("tracks"),
        F.sum("duration_seconds").cast("long").alias("seconds"),
        F.sum("size_bytes").alias("bytes"),
        F.min("year").alias("year"),
    )


def top_releases(tracks: DataFrame, k: int = 3) -> DataFrame:
    """The k releases with most tracks of each artist, by name among equals."""
    rank = F.row_number().over(Window.partitionBy("primary_artist").orderBy(F.desc("tracks"), "album"))
    return releases(tracks).select("primary_artist", "album", "tracks").withColumn("place", rank).filter(F.col("place") <= k)


def collaborators(tracks: DataFrame) -> DataFrame:
    """(artist, other, tracks) of artists on the same recording, each way."""
    both = exploded_artists(tracks.filter(F.col("artists_raw").contains(","))).select("recording_id", "artist")
    pairs = both.join(both.withColumnRenamed("artist", "other"), "recording_id").filter("artist <> other")
    return pairs.groupBy("artist", "other").agg(F.countDistinct("recording_id").alias("tracks"))


def usual_genre(tracks: DataFrame) -> DataFrame:
    """(primary_artist, genre): the most frequent genre of each artist, the lesser name among equals."""
    counts = tracks.filter("genre IS NOT NULL").groupBy("primary_artist", "genre").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("primary_artist").agg(F.min_by("genre", F.struct(-F.col("n"), "genre")).alias("genre"))
