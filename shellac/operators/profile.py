"""Profiles of a library and reports on batches of operations; each of few rows, from partially aggregated groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellac.functions import tags
from shellac.operators.curation import latest_operations

GIGABYTE = 1 << 30


def _share(part: Column, whole: Column) -> Column:
    return F.round(F.when(whole > 0, part / whole).otherwise(0.0), 6)


def file_details(tracks: DataFrame) -> DataFrame:
    """One row: mean size and length, tracks and hours in a gigabyte; 0 for an empty library."""
    n, size, seconds = F.count(F.lit(1)), F.coalesce(F.sum("size_bytes"), F.lit(0)), F.coalesce(F.sum("duration_seconds"), F.lit(0.0))
    gigabytes = size / GIGABYTE
    return tracks.agg(_share(size, n).alias("avg_size"), _share(seconds, n).alias("avg_seconds"), _share(n, gigabytes).alias("tracks_per_gb"), _share(seconds / 3600, gigabytes).alias("hours_per_gb"))


def format_profile(tracks: DataFrame) -> DataFrame:
    """(file_type, tracks, avg_size, least and greatest bitrate) of each format."""
    return tracks.groupBy("file_type").agg(
        F.count(F.lit(1)).alias("tracks"), F.round(F.avg("size_bytes"), 6).alias("avg_size"), F.min("bitrate").alias("least"), F.max("bitrate").alias("greatest")
    )


def library_profile(tracks: DataFrame) -> DataFrame:
    """One row: tracks, formats, main artists, releases, tracks in a release, mean completeness of four fields."""
    filled = sum((tags.given(F.col(c)).cast("int") for c in ("title", "primary_artist", "year", "genre")), F.lit(0))
    out = tracks.agg(
        F.count(F.lit(1)).alias("tracks"),
        F.count_distinct("file_type").alias("formats"),
        F.count_distinct("primary_artist").alias("artists"),
        F.count_distinct("primary_artist", "album").alias("releases"),
        F.round(F.sum(filled) / F.count(F.lit(1)) / 4, 6).alias("completeness"),
    )
    return out.withColumn("tracks_per_release", _share(F.col("tracks"), F.col("releases")))


def scan_report(tracks: DataFrame) -> DataFrame:
    """(file_type, tracks, tagged, tagged_percent, bytes): tagged ones have a genre or a year; whole percent."""
    tagged = F.count_if(F.col("genre").isNotNull() | F.col("year").isNotNull())
    counts = tracks.groupBy("file_type").agg(F.count(F.lit(1)).alias("tracks"), tagged.alias("tagged"), F.sum("size_bytes").alias("bytes"))
    return counts.withColumn("tagged_percent", F.floor(100 * F.col("tagged") / F.col("tracks")).cast("long"))


def batch_report(log: DataFrame) -> DataFrame:
    """One row over sessions as batches: mean, least, greatest and population deviation of their success rates, and
    the best and the worst of them, by name among equals."""
    batches = latest_operations(log).groupBy("session_id").agg((F.count_if(F.col("status") == "completed") / F.count(F.lit(1))).alias("rate"))
    rate = F.col("rate")
    return batches.agg(
        F.count(F.lit(1)).alias("batches"),
        F.round(F.avg(rate), 6).alias("mean"),
        F.round(F.min(rate), 6).alias("least"),
        F.round(F.max(rate), 6).alias("greatest"),
        F.round(F.stddev_pop(rate), 6).alias("deviation"),
        F.min_by("session_id", F.struct(-rate, "session_id")).alias("best"),
        F.min_by("session_id", F.struct(rate, "session_id")).alias("worst"),
    )


def operation_metrics(log: DataFrame) -> DataFrame:
    """(operation_type, operations, failed, failed_rate, bytes) over the last record of each operation."""
    counts = latest_operations(log).groupBy("operation_type").agg(
        F.count(F.lit(1)).alias("operations"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("file_size").alias("bytes")
    )
    return counts.withColumn("failed_rate", _share(F.col("failed"), F.col("operations")))


def conflict_metrics(plan: DataFrame) -> DataFrame:
    """One row for a plan with a column strategy, null without a conflict: conflicts, and how many were skipped, renamed
    (or both kept) and replaced; percent resolved, 100 without conflicts."""
    conflicts = F.count("strategy")
    skipped, replaced = F.count_if(F.col("strategy") == "skip"), F.count_if(F.col("strategy") == "replace")
    renamed = F.count_if(F.col("strategy").isin("rename", "keep_both"))
    rate = F.when(conflicts == 0, 100.0).otherwise(F.round(100 * (skipped + renamed + replaced) / conflicts, 6))
    return plan.agg(conflicts.alias("conflicts"), skipped.alias("skipped"), renamed.alias("renamed"), replaced.alias("replaced"), rate.alias("rate"))
