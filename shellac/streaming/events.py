"""Structured Streaming over event files: each stream is drained once, its result written and read as a table."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shellac.tables import shared_folder


def new_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, as in tests on a local master, a temporary one."""
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def read_files(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files as a stream; new files below `path`, or `path` itself, come in later batches."""
    # as a pattern, so that a single file is taken as well as a folder
    pattern = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)


def read_events(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Event files as a stream (see read_files). Times without a zone are those of the session's zone, since watermarks
    need instants."""
    return read_files(spark, path, files_per_batch).withColumn("ts", F.col("ts").cast("timestamp"))


class Continued(NamedTuple):
    """A stream of which each batch gives rows of the schema `shape`, made from the batch and from all rows that the batches
    before it gave (None for the first); `columns` are those to return, the others are for later batches."""

    stream: DataFrame
    step: Callable[[DataFrame, DataFrame | None], DataFrame]
    shape: str
    columns: list[str]


def _continued(stream: Continued, folder: str) -> DataFrame:
    """Each batch's rows stand in a folder of its number, and a batch that is repeated after a failure replaces them."""
    spark = stream.stream.sparkSession

    def rows(session: SparkSession, numbers: list[int]) -> DataFrame | None:
        return session.read.schema(stream.shape).parquet(*[f"{folder}/rows/{v}" for v in numbers]) if numbers else None

    def put(batch: DataFrame, number: int) -> None:
        before = rows(batch.sparkSession, [v for v in versions(batch.sparkSession, f"{folder}/rows") if v < number])
        stream.step(batch, before).write.mode("overwrite").parquet(f"{folder}/rows/{number}")

    writer = stream.stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    found = rows(spark, versions(spark, f"{folder}/rows"))
    return (spark.createDataFrame([], stream.shape) if found is None else found).select(*stream.columns)


def drained(stream: DataFrame | Continued, folder: str | None = None) -> DataFrame:
    """All that an append-mode stream has given for the files there now. With the folder of an earlier call it goes on
    from there, state included, and returns what both have given; else it starts in a new one."""
    if isinstance(stream, Continued):
        return _continued(stream, folder or new_folder(stream.stream.sparkSession))
    folder = folder or new_folder(stream.sparkSession)
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete versions of a table in a folder, rising; a version that was cut short has no mark."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        return []
    found = [int(status.getPath().getName()) for status in system.listStatus(place)]
    return sorted(v for v in found if system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{v}/_SUCCESS")))


def _last_version(stream: DataFrame, mode: str, merge: Callable[[DataFrame, DataFrame | None], DataFrame], folder: str | None = None) -> DataFrame:
    """A table that each batch replaces by merge(batch, table before); a batch that is repeated after a failure
    starts from the same version, so its effect is the same. Versions stand in the folder, from which a later call goes on."""
    spark, folder = stream.sparkSession, folder or new_folder(stream.sparkSession)

    def put(batch: DataFrame, number: int) -> None:
        earlier = [v for v in versions(batch.sparkSession, f"{folder}/rows") if v < number]
        before = batch.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows/{earlier[-1]}") if earlier else None
        merge(batch, before).write.mode("overwrite").parquet(f"{folder}/rows/{number}")

    writer = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    there = versions(spark, f"{folder}/rows")
    if not there:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows/{there[-1]}")


def events_of_type(events: DataFrame, kind: str) -> DataFrame:
    return drained(events.filter(F.col("event_type") == kind))


def running_counts(events: DataFrame, folder: str | None = None) -> DataFrame:
    """(event_type, events, total) as of the last batch; goes on from an earlier call's folder."""
    counts = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 2).alias("total"))
    return _last_version(counts, "complete", lambda batch, before: batch, folder)


def rates(events: DataFrame, window: str = "1 hour", slide: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(started, events) of sliding windows that are closed; rows later than `late` no longer count."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", window, slide).alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return drained(counts.select(F.col("w.start").cast("timestamp_ntz").alias("started"), "events"))


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """(user_id, started, events, purchases, errors) of sessions that a gap has closed."""
    counts = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count_if(F.col("event_type") == "error").alias("errors")
    )
    return drained(counts.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("started"), "events", "purchases", "errors"))


def last_events(events: DataFrame, n: int = 1000, folder: str | None = None) -> DataFrame:
    """The n latest events, by id among equals: each batch is cut to n before it is merged with the table. Goes on from an
    earlier call's folder."""

    def merge(batch: DataFrame, before: DataFrame | None) -> DataFrame:
        top = batch.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)
        return (top if before is None else top.unionByName(before)).orderBy(F.desc("ts"), F.desc("event_id")).limit(n)

    return _last_version(events, "append", merge, folder)
