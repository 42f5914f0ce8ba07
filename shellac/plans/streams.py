"""Streams over the events, drained, and their batch equivalents in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shellac.operators import resolution
from shellac.plans.queries import _I, _T, Query
from shellac.sources import catalog
from shellac.streaming import events, state


def _of_events(stream: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: stream(events.read_events(spark, f"{sf_dir}/events.parquet"))


def _earlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks as a stream of their lines, joined with the other tables as they are; keys as bytes, half as long as their digits."""
    lines = events.read_files(spark, f"{sf_dir}/lineitem.parquet")
    tracks = catalog.tracks(spark, sf_dir, lineitem=lines)
    keyed = tracks.select(F.unhex(resolution.file_hash()).alias("key"), "recording_id", (F.col("ord1") * 100 + F.col("ord2")).alias("place"))
    return events.drained(state.earlier_duplicates(keyed))


def _reads(stream: DataFrame) -> DataFrame:
    stored = F.when(F.col("event_type") == "purchase", F.col("value"))
    rows = stream.filter(F.col("event_type").isin("purchase", "view")).select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("record"), stored.alias("value"))
    found = events.drained(state.reads_with_ttl(rows, TTL_SECONDS))
    return found.select("key", "record", F.round("value", 2).alias("value"), "hit")


def _retried(stream: DataFrame) -> DataFrame:
    tries = stream.filter(F.col("event_type").isin("purchase", "error", "click"))
    return events.drained(state.retried(tries.select(F.col("user_id").alias("key"), F.col("event_id").alias("record"), (F.col("event_type") == "purchase").alias("ok"))))


def _new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two listings, one after the other into the same folder; what the second one changed or added."""
    folder = events.new_folder(spark)
    for source, sql in (("before", catalog.INVENTORY_PREV_SQL), ("now", catalog.INVENTORY_CUR_SQL)):
        listing = catalog.view(spark, sf_dir, sql, orders=events.read_files(spark, f"{sf_dir}/orders.parquet"))
        found = state.new_files(listing, folder, source)
    return found.groupBy("path").agg(F.count("*").alias("times"), F.max_by("size", F.struct(F.col("change") == "modified", "size")).alias("size"), F.max(F.col("change") == "modified").alias("modified"))


#: How long a stored value counts in the test tables, whose events are far apart.
TTL_SECONDS = 86_400

#: Windows count once the watermark has passed their end; it keeps milliseconds.
_CLOSED = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)"

#: name: (query, SQL)
PAIRS: dict[str, tuple[Query, str]] = {
    "o1_stream_events": (
        _of_events(lambda s: events.events_of_type(s, "view").select("event_id", "user_id", "value")),
        "SELECT event_id, user_id, value FROM events WHERE event_type = 'view'",
    ),
    "o2_stream_counts": (_of_events(events.running_counts), "SELECT event_type, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY 1"),
    "o5_stream_sessions": (
        _of_events(events.sessions),
        "WITH s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOURS THEN 0 ELSE 1 END AS fresh FROM events)) "
        "SELECT user_id, min(ts) AS started, count(*) AS events, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (event_type = 'error') AS errors "
        f"FROM s GROUP BY user_id, n HAVING max(ts) + INTERVAL 2 HOURS <= {_CLOSED}",
    ),
    "o6_stream_rates": (
        _of_events(events.rates),
        "WITH w AS (SELECT time_bucket(INTERVAL 30 MINUTES, ts) - k * INTERVAL 30 MINUTES AS started FROM events, (VALUES (0), (1)) v(k)) "
        f"SELECT started, count(*) AS events FROM w GROUP BY 1 HAVING started + INTERVAL 1 HOUR <= {_CLOSED}",
    ),
    "o9_last_events": (
        _of_events(lambda s: events.last_events(s, 1000).select("event_id", "user_id", "event_type")),
        "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000",
    ),
    "o3_new_files": (
        _new_files,
        _I + "SELECT path, count(*) AS times, arg_max(size, (changed, size)) AS size, max(changed::INT) = 1 AS modified FROM (SELECT path, size, false AS changed FROM p "
        "UNION ALL SELECT c.path, c.size, p.path IS NOT NULL FROM c LEFT JOIN p USING (path) WHERE p.path IS NULL OR p.size <> c.size OR p.mtime <> c.mtime) GROUP BY path",
    ),
    "o4_stream_earlier_duplicates": (
        _earlier,
        _T + "SELECT recording_id, row_number() OVER w - 1 AS earlier, lag(recording_id) OVER w AS previous FROM tracks "
        "WINDOW w AS (PARTITION BY md5(concat_ws('|', title, primary_artist, CAST(CAST(duration_seconds AS BIGINT) AS VARCHAR))) ORDER BY ord1, ord2, recording_id)",
    ),
    "o7_reads_with_ttl": (
        _of_events(_reads),
        "WITH s AS (SELECT user_id AS key, ts, event_id AS record, event_type, value, last_value(CASE WHEN event_type = 'purchase' THEN struct_pack(v := value, t := ts) END IGNORE NULLS) "
        "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM events WHERE event_type IN ('purchase', 'view')) "
        f"SELECT key, record, CASE WHEN hit THEN round(last.v, 2) END AS value, hit FROM (SELECT *, coalesce(ts < last.t + INTERVAL {TTL_SECONDS} SECONDS, false) AS hit FROM s WHERE event_type = 'view')",
    ),
    "o8_retried": (
        _of_events(_retried),
        "WITH a AS (SELECT user_id AS key, event_id AS record, event_type = 'purchase' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt FROM events WHERE event_type IN ('purchase', 'error', 'click')), "
        "f AS (SELECT *, min(CASE WHEN ok OR attempt > 3 THEN attempt END) OVER (PARTITION BY key) AS final FROM a) "
        "SELECT key, record, attempt, CASE WHEN attempt > final THEN 'ignored' WHEN ok THEN 'delivered' WHEN attempt > 3 THEN 'given_up' ELSE 'retry' END AS status FROM f",
    ),
}
