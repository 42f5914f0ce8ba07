"""Access logs, operation logs and domain events in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shellac.operators.curation import latest_operations

#: Days of an entry's life: default, bounds, and the stability above which it is prolonged.
TTL_DAYS, MIN_TTL_DAYS, MAX_TTL_DAYS, STABLE = 30.0, 1.0, 365.0, 0.8

#: Inverse of each operation in a rollback.
INVERSE = {"move": "move_back", "copy": "delete_copy", "create_dir": "remove_dir", "move_cover": "move_back"}


def _days(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 86400000000.0


def access_frequency(log: DataFrame, as_of: str) -> DataFrame:
    """(file_path, frequency): accesses a day over the 30 days before `as_of`, over one day at least."""
    end = F.lit(as_of).cast("timestamp_ntz")
    recent = log.filter((F.col("ts") > end - F.expr("INTERVAL 30 DAYS")) & (F.col("ts") <= end))
    span = F.greatest(F.lit(1.0), _days(F.max("ts"), F.min("ts")))
    return recent.groupBy("file_path").agg((F.count(F.lit(1)) / span).alias("frequency"))


def stability(log: DataFrame, as_of: str, versions: int = 10) -> DataFrame:
    """(file_path, stability) from each file's last versions: days since the oldest of them over 90, at most 1, and
    half of that if most of them differ from the one before. Ties in time go by `record`."""
    by_file = Window.partitionBy("file_path").orderBy(F.desc("ts"), F.desc("record"))
    last = log.select("file_path", "mtime", F.row_number().over(by_file).alias("n"), F.lag("mtime").over(by_file).alias("newer")).filter(F.col("n") <= versions)
    facts = last.groupBy("file_path").agg(
        F.count(F.lit(1)).alias("rows"), F.max_by("mtime", "n").alias("oldest"), F.count_if(F.col("mtime") != F.col("newer")).alias("changes")
    )
    steady = F.least(F.lit(1.0), _days(F.lit(as_of).cast("timestamp_ntz"), F.col("oldest")) / 90)
    restless = (F.col("rows") > 1) & (F.col("changes") > 0.5 * F.col("rows"))
    return facts.select("file_path", F.when(restless, 0.5 * steady).otherwise(steady).alias("stability"))


def adaptive_ttl(log: DataFrame, as_of: str) -> DataFrame:
    """(file_path, frequency, stability, ttl_days, priority): stable files live longer, files in use up to three times
    as long; priority ranks what to warm first."""
    both = stability(log, as_of).join(access_frequency(log, as_of), "file_path", "left")
    f, s = F.coalesce("frequency", F.lit(0.0)), F.col("stability")
    base = TTL_DAYS * (1 + F.greatest(F.lit(0.0), s - STABLE))
    ttl = F.when(f > 0.1, base * (1 + F.least(2 * f, F.lit(2.0)))).otherwise(base)
    ttl = F.least(F.lit(MAX_TTL_DAYS), F.greatest(F.lit(MIN_TTL_DAYS), ttl))
    return both.select("file_path", F.round(f, 6).alias("frequency"), F.round(s, 6).alias("stability"), F.round(ttl, 6).alias("ttl_days"), F.round(10 * f + 5 * s, 6).alias("priority"))


def access_summary(log: DataFrame, as_of: str) -> DataFrame:
    """One row: files, mean and greatest frequency, files in use, mean stability, stable files."""
    return adaptive_ttl(log, as_of).agg(
        F.count(F.lit(1)).alias("files"),
        F.round(F.avg("frequency"), 4).alias("avg_frequency"),
        F.max("frequency").alias("max_frequency"),
        F.count_if(F.col("frequency") > 0.1).alias("in_use"),
        F.round(F.avg("stability"), 4).alias("avg_stability"),
        F.count_if(F.col("stability") > STABLE).alias("stable"),
    )


def instant_rate(samples: DataFrame, rows: int = 10) -> DataFrame:
    """(session_id, record, rate): records a second over each session's last samples; null for a span of no time."""
    frame = Window.partitionBy("session_id").orderBy("ts", "record").rowsBetween(1 - rows, 0)
    seconds = _days(F.col("ts"), F.first("ts").over(frame)) * 86400
    done = F.count(F.lit(1)).over(frame) - 1
    return samples.select("session_id", "record", F.round(F.when(seconds > 0, done / seconds), 6).alias("rate"))


def session_summary(log: DataFrame) -> DataFrame:
    """(session_id, counts by type, bytes completed) over the last record of each operation."""
    counts = [F.count_if(F.col("operation_type") == kind).alias(kind) for kind in INVERSE]
    done = F.coalesce(F.sum(F.when(F.col("status") == "completed", F.col("file_size"))), F.lit(0)).alias("bytes_completed")
    return latest_operations(log).groupBy("session_id").agg(*counts, done)


def rollback_plan(log: DataFrame) -> DataFrame:
    """(session_id, step, id, action): completed operations of each session undone, the latest first."""
    last = log.groupBy("id").agg(F.max_by(F.struct("session_id", "operation_type", "status", "ts", "record"), F.struct("ts", "record")).alias("last"))
    completed = last.select("id", "last.*").filter("status = 'completed'")
    action = F.coalesce(*[F.when(F.col("operation_type") == kind, F.lit(inverse)) for kind, inverse in INVERSE.items()])
    step = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("record")))
    return completed.select("session_id", step.alias("step"), "id", action.alias("action"))


def recent_sessions(log: DataFrame, limit: int = 10) -> DataFrame:
    """(session_id, started) of the sessions that started last."""
    return log.groupBy("session_id").agg(F.min("ts").alias("started")).orderBy(F.desc("started"), "session_id").limit(limit)


def retain(log: DataFrame, as_of: str, days: int) -> DataFrame:
    return log.filter(F.col("ts") >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))


def events_where(events: DataFrame, kind: str | None = None, since: str | None = None) -> DataFrame:
    """Events of a kind, from a time on; both reach the scan as pushed filters where the columns are stored ones."""
    if kind is not None:
        events = events.filter(F.col("event_type") == kind)
    if since is not None:
        events = events.filter(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    return events


def library_from_events(events: DataFrame) -> DataFrame:
    """(aggregate_id, added, removed, balance): additions and removals folded with their signs."""
    added, removed = F.count_if(F.col("kind") == "RecordingAdded"), F.count_if(F.col("kind") == "RecordingRemoved")
    return events.groupBy("aggregate_id").agg(added.alias("added"), removed.alias("removed"), (added - removed).alias("balance"))


def field_changes(events: DataFrame) -> DataFrame:
    """(record, aggregate_id, before, after): updates whose value differs from the update before it."""
    before = F.lag("value").over(Window.partitionBy("aggregate_id").orderBy("ts", "record"))
    updates = events.filter("kind = 'MetadataUpdated'").select("record", "aggregate_id", before.alias("before"), F.col("value").alias("after"))
    return updates.filter("before IS NOT NULL AND before <> after")
