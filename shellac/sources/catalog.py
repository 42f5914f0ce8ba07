"""The `tracks` table and its companions, as views over the given star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shellac.tables import if_small

#: One row per track. The same text runs on Spark and, for the oracle, on DuckDB.
TRACKS_SQL = """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS recording_id,
  l_orderkey AS ord1, l_linenumber AS ord2,
  concat(p_name, CASE (l_orderkey + l_linenumber) % 11 WHEN 0 THEN ' (Live)' WHEN 1 THEN ' (Club Remix)' WHEN 2 THEN ' Demo' WHEN 3 THEN ' Podcast Episode' ELSE '' END) AS title,
  concat(CASE WHEN l_suppkey % 7 = 0 THEN 'The ' ELSE '' END, s_name) AS primary_artist,
  concat(CASE WHEN l_suppkey % 7 = 0 THEN 'The ' ELSE '' END, s_name, CASE WHEN l_linenumber % 3 = 0 THEN concat(', ', c_name) ELSE '' END) AS artists_raw,
  CASE l_partkey % 8 WHEN 0 THEN concat('Live at ', n_name) WHEN 1 THEN 'Greatest Hits' WHEN 2 THEN concat(p_brand, ' (Deluxe Edition)')
    WHEN 3 THEN concat(p_brand, ' with ', c_name) WHEN 4 THEN concat(p_brand, ' Soundtrack') ELSE p_brand END AS album,
  CASE WHEN l_orderkey % 23 <> 0 THEN CAST(year(o_orderdate) - l_partkey % 40 AS INT) END AS year,
  CASE split_part(p_type, ' ', 1) WHEN 'STANDARD' THEN 'Rock' WHEN 'ECONOMY' THEN 'rock, pop' WHEN 'MEDIUM' THEN 'R&B' WHEN 'SMALL' THEN 'electronica' WHEN 'LARGE' THEN 'Jazz' END AS genre,
  CAST(l_linenumber AS INT) AS track_number, CAST(1 + l_partkey % 2 AS INT) AS disc_number,
  CAST(p_size * 12 + l_linenumber AS DOUBLE) AS duration_seconds,
  CASE WHEN l_orderkey % 17 <> 0 THEN CAST(l_quantity * 8 AS INT) END AS bitrate,
  CASE l_linestatus WHEN 'F' THEN 44100 ELSE 96000 END AS sample_rate,
  CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'flac' WHEN 'AO' THEN 'wav' WHEN 'NF' THEN 'mp3' WHEN 'NO' THEN 'm4a' WHEN 'RF' THEN 'ogg' ELSE 'wma' END AS file_type,
  CAST(round(l_extendedprice * 1000) AS BIGINT) AS size_bytes,
  concat('/music/', coalesce(genre, 'Unknown'), '/', primary_artist, '/', album, '/', title, '.', file_type) AS path,
  l_shipdate AS created_at
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
JOIN nation ON n_nationkey = s_nationkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
"""

#: The same joins in an order that moves less: customers meet the orders before the lines do; suppliers come last, with their nation.
_TRACKS_JOINS = """
FROM lineitem JOIN (SELECT o_orderkey, o_orderdate, c_name FROM orders JOIN customer ON c_custkey = o_custkey) ON o_orderkey = l_orderkey
JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
"""
_SUPPLIERS = "SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey"
_TRACKS_VIEW = TRACKS_SQL[: TRACKS_SQL.rindex("\nFROM lineitem")] + _TRACKS_JOINS

#: Inventory snapshots: the current one loses, changes and gains rows against the previous one.
INVENTORY_PREV_SQL = "SELECT concat('/o/', o_orderkey) AS path, CAST(round(o_totalprice * 100) AS BIGINT) AS size, o_orderdate AS mtime FROM orders"
INVENTORY_CUR_SQL = """
SELECT concat('/o/', o_orderkey) AS path, CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderkey % 10 = 1 THEN 1 ELSE 0 END AS size, o_orderdate AS mtime
FROM orders WHERE o_orderkey % 10 <> 0
UNION ALL SELECT concat('/new/', o_orderkey), CAST(round(o_totalprice * 100) AS BIGINT), o_orderdate FROM orders WHERE o_orderkey % 10 = 2
"""

#: Operation log; two records may share an id, of which the later counts.
OP_LOG_SQL = """
SELECT CAST(floor(event_id / 2) AS BIGINT) AS id, event_id AS record, concat(user_id, '-', CAST(CAST(ts AS DATE) AS STRING)) AS session_id, ts,
  CASE user_id % 4 WHEN 0 THEN 'move' WHEN 1 THEN 'copy' WHEN 2 THEN 'create_dir' ELSE 'move_cover' END AS operation_type,
  CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'in_progress' WHEN 'view' THEN 'pending' ELSE 'rolled_back' END AS status,
  CAST(floor(value * 1000) AS BIGINT) AS file_size
FROM events
"""

#: Accesses of files; a file's version is the day.
ACCESS_LOG_SQL = "SELECT concat('/u/', user_id) AS file_path, event_id AS record, ts, date_trunc('day', ts) AS mtime FROM events"

#: Domain events of each aggregate, with the number of their payload.
DOMAIN_EVENTS_SQL = """
SELECT event_id AS record, user_id AS aggregate_id, ts, event_type,
  CASE event_type WHEN 'signup' THEN 'RecordingAdded' WHEN 'view' THEN 'MetadataUpdated' WHEN 'error' THEN 'RecordingRemoved'
    WHEN 'click' THEN 'ClassificationCompleted' ELSE 'FileMoved' END AS kind,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS value
FROM events
"""

#: Pairs of texts that share some words.
TEXT_PAIRS_SQL = f"SELECT DISTINCT title AS a, concat(split_part(title, ' ', 2), ' ', album) AS b FROM ({TRACKS_SQL}) t"

_TABLES = ("lineitem", "part", "supplier", "nation", "orders", "customer", "events")


def view(spark: SparkSession, sf_dir: str, sql: str, **instead: DataFrame) -> DataFrame:
    """`sql` over the tables in `sf_dir`, or those given instead, such as streams; only tables that it names are opened."""
    frames = {name: instead[name] if name in instead else spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in _TABLES if name in sql}
    for name, frame in frames.items():
        sql = sql.replace(f" {name} ", f" {{{name}}} ").replace(f" {name}\n", f" {{{name}}}\n")
        if sql.endswith(f" {name}"):
            sql = sql[: -len(name)] + f"{{{name}}}"
    return spark.sql(sql, **frames)


def tracks(spark: SparkSession, sf_dir: str, **instead: DataFrame) -> DataFrame:
    """TRACKS_SQL with its joins in an order that shuffles the lines twice at most, each time without what later joins add, as
    long as suppliers are few enough to be broadcast, which is measured."""
    suppliers = if_small(view(spark, sf_dir, _SUPPLIERS))
    return view(spark, sf_dir, _TRACKS_VIEW, **{"supplier": suppliers} | instead)
