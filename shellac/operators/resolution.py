"""What duplicates there are, which came first, and what resolving them saves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shellac.functions import tags


def tag_key() -> Column:
    return tags.identity_key(F.col("primary_artist"), F.col("title"), F.col("album"), F.col("track_number"))


def file_hash() -> Column:
    """Stands for a hash of the content: equal for the same title, artist and length."""
    return F.md5(F.concat_ws("|", "title", "primary_artist", F.col("duration_seconds").cast("long").cast("string")))


def duplicates_by_key(tracks: DataFrame, key: Column) -> DataFrame:
    """(key, tracks, first) of keys that several tracks have."""
    groups = tracks.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("tracks"), F.min("recording_id").alias("first"))
    return groups.filter("tracks > 1")


def duplicate_likelihood(tracks: DataFrame, least: int = 10) -> DataFrame:
    """One row: the share of signatures of title and main artist that several tracks have; 0 below `least` tracks. Tracks
    without title or artist have no signature and don't count as each other's duplicates."""
    tagged = tags.given(F.col("title")) & tags.given(F.col("primary_artist"))
    bare = [F.regexp_replace(F.lower(c), "[^a-z0-9]", "") for c in ("primary_artist", "title")]
    counts = tracks.groupBy(F.when(tagged, F.concat_ws("_", *bare)).alias("signature")).agg(F.count(F.lit(1)).alias("n"))
    share = F.count_if(F.col("signature").isNotNull() & (F.col("n") > 1)) / F.nullif(F.count("signature"), F.lit(0))
    return counts.agg(F.round(F.when(F.sum("n") >= least, F.coalesce(share, F.lit(0.0))).otherwise(0.0), 6).alias("likelihood"))


def duplicate_summary(tracks: DataFrame) -> DataFrame:
    """(kind, groups, redundant) of duplicates by tags and by file, in one pass over the tracks."""
    keys = F.array(F.struct(F.lit("tags").alias("kind"), tag_key().alias("key")), F.struct(F.lit("file").alias("kind"), file_hash().alias("key")))
    counts = tracks.select(F.explode(keys).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return counts.groupBy("k.kind").agg(F.count(F.lit(1)).alias("groups"), (F.sum("n") - F.count(F.lit(1))).alias("redundant"))


def earlier_duplicates(tracks: DataFrame) -> DataFrame:
    """(recording_id, earlier, previous) in order of arrival: how many tracks with the same file came before, and the
    last of them. Running counts instead of lists keep a large group linear."""
    arrival = Window.partitionBy(file_hash()).orderBy("ord1", "ord2", "recording_id")
    return tracks.select("recording_id", (F.row_number().over(arrival) - 1).alias("earlier"), F.lag("recording_id").over(arrival).alias("previous"))


def resolution_summary(ranked: DataFrame) -> DataFrame:
    """One row for (key, size_bytes, place): groups, kept and deleted tracks, bytes that deleting them saves."""
    gone = F.col("place") > 1
    return ranked.agg(
        F.count_if(~gone).alias("groups"),
        F.count_if(~gone).alias("kept"),
        F.count_if(gone).alias("deleted"),
        F.coalesce(F.sum(F.when(gone, F.col("size_bytes"))), F.lit(0)).alias("saved"),
    )


def canonical_artists(tracks: DataFrame) -> DataFrame:
    """(recording_id, artists): each artist in the longest of its spellings, the least among equals; spellings are
    those that agree but for case, spaces and "the"; artists joined by a bar, in order."""
    rows = tracks.select("recording_id", F.posexplode(tags.split_artists(F.col("artists_raw"))).alias("at", "artist"))
    rows = rows.withColumn("key", F.regexp_replace(F.regexp_replace(F.lower("artist"), "the ", ""), " ", ""))
    best = rows.groupBy("key").agg(F.min_by("artist", F.struct(-F.length("artist"), "artist")).alias("canonical"))
    placed = F.sort_array(F.collect_list(F.struct("at", "canonical")))
    return rows.join(best, "key").groupBy("recording_id").agg(F.array_join(placed["canonical"], "|").alias("artists"))


def releases_by_genre(tracks: DataFrame) -> DataFrame:
    """(genre, releases): a release has the genre of most of its tracks, the least among equals, or Unknown."""
    counts = tracks.groupBy("primary_artist", "album", "genre").agg(F.count("genre").alias("n"))
    usual = counts.groupBy("primary_artist", "album").agg(F.min_by("genre", F.struct(-F.col("n"), "genre")).alias("genre"))
    return usual.groupBy(F.coalesce("genre", F.lit("Unknown")).alias("genre")).agg(F.count(F.lit(1)).alias("releases"))
