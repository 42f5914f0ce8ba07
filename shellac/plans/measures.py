"""Queries on text similarity and logs, and their equivalents in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellac.functions import similarity, tags
from shellac.operators import logs
from shellac.plans.queries import Query, of_log
from shellac.sources import catalog

#: The time that trailing periods end at.
AS_OF = "2024-01-31 00:00:00"


def _of(sql: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(catalog.view(spark, sf_dir, sql))


def _fuzzy(pairs: DataFrame) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    measures = dict(lev=tags.levenshtein_similarity, jaro=similarity.jaro, jaro_winkler=similarity.jaro_winkler)
    measures |= dict(jaccard=tags.word_jaccard, cosine=similarity.word_cosine, dice=similarity.dice_bigrams)
    return pairs.select("a", "b", *[F.round(f(a, b), 6).alias(name) for name, f in measures.items()])


def _metadata(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b", F.round(similarity.metadata_similarity(F.col("a"), F.col("b")), 6).alias("score"))


def _lev(a: str, b: str) -> str:
    return f"(1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})))"


def _winkler(a: str, b: str) -> str:
    prefix = "CASE " + " ".join(f"WHEN left({a}, {n}) = left({b}, {n}) THEN {n}" for n in (4, 3, 2, 1)) + " ELSE 0 END"
    return f"(jaro_similarity({a}, {b}) + 0.1 * {prefix} * (1 - jaro_similarity({a}, {b})))"


def _dice(a: str, b: str) -> str:
    x, y = (f"list_distinct([substr({t}, i, 2) for i in range(1, length({t}))])" for t in (a, b))
    return f"(2 * len(list_intersect({x}, {y})) / (len({x}) + len({y})))"


_P = f"WITH pairs AS ({catalog.TEXT_PAIRS_SQL})"
_BARE = "trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '^(the|a|an) ', ''), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g'))"
_D = f"WITH log AS ({catalog.DOMAIN_EVENTS_SQL})"
_O = f"WITH log AS ({catalog.OP_LOG_SQL}), latest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY id ORDER BY ts DESC, record DESC) = 1)"
_TTL = f"""WITH log AS ({catalog.ACCESS_LOG_SQL}), placed AS (SELECT file_path, mtime, row_number() OVER w AS n, lag(mtime) OVER w AS newer
  FROM log WINDOW w AS (PARTITION BY file_path ORDER BY ts DESC, record DESC)),
facts AS (SELECT file_path, count(*) AS versions, arg_max(mtime, n) AS oldest, count(*) FILTER (mtime <> newer) AS changes FROM placed WHERE n <= 10 GROUP BY 1),
steady AS (SELECT file_path, least(1.0, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(oldest)) / 86400000000.0 / 90) * CASE WHEN versions > 1 AND changes > 0.5 * versions THEN 0.5 ELSE 1 END AS s FROM facts),
used AS (SELECT file_path, count(*) / greatest(1.0, (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0) AS f FROM log
  WHERE ts > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAYS AND ts <= TIMESTAMP '{AS_OF}' GROUP BY 1),
merged AS (SELECT file_path, s, coalesce(f, 0) AS f, 30.0 * (1 + greatest(0.0, s - 0.8)) AS base FROM steady LEFT JOIN used USING (file_path)),
ttl AS (SELECT file_path, round(f, 6) AS frequency, round(s, 6) AS stability, round(least(365.0, greatest(1.0, CASE WHEN f > 0.1 THEN base * (1 + least(2 * f, 2.0)) ELSE base END)), 6) AS ttl_days,
  round(10 * f + 5 * s, 6) AS priority FROM merged)"""

#: name: (query, SQL)
PAIRS: dict[str, tuple[Query, str]] = {
    "e9_fuzzy_match": (
        _of(catalog.TEXT_PAIRS_SQL, _fuzzy),
        f"{_P}, w AS (SELECT a, b, string_split(a, ' ') AS x, string_split(b, ' ') AS y, string_split(lower(a), ' ') AS lx, string_split(lower(b), ' ') AS ly FROM pairs), "
        "counts AS (SELECT a, b, word, count(*) FILTER (side = 1) AS m, count(*) FILTER (side = 2) AS n FROM "
        "(SELECT a, b, unnest(x) AS word, 1 AS side FROM w UNION ALL SELECT a, b, unnest(y), 2 FROM w) GROUP BY 1, 2, 3), "
        "cosines AS (SELECT a, b, sum(m * n) / sqrt(sum(m * m) * sum(n * n)) AS cosine FROM counts GROUP BY 1, 2) "
        f"SELECT a, b, round({_lev('a', 'b')}, 6) AS lev, round(jaro_similarity(a, b), 6) AS jaro, round({_winkler('a', 'b')}, 6) AS jaro_winkler, "
        f"round(len(list_intersect(lx, ly)) / len(list_distinct(lx || ly)), 6) AS jaccard, round(cosine, 6) AS cosine, round({_dice('a', 'b')}, 6) AS dice FROM w JOIN cosines USING (a, b)",
    ),
    "e8_metadata_similarity": (
        _of(catalog.TEXT_PAIRS_SQL, _metadata),
        f"{_P}, n AS (SELECT a, b, {_BARE.format('a')} AS x, {_BARE.format('b')} AS y FROM pairs) "
        f"SELECT a, b, round(CASE WHEN x = y THEN 1 ELSE 0.3 * {_lev('x', 'y')} + 0.5 * {_winkler('x', 'y')} + 0.2 * {_dice('x', 'y')} END, 6) AS score FROM n",
    ),
    "h4_adaptive_ttl": (_of(catalog.ACCESS_LOG_SQL, lambda log: logs.adaptive_ttl(log, AS_OF)), f"{_TTL} SELECT * FROM ttl"),
    "g22_access_summary": (
        _of(catalog.ACCESS_LOG_SQL, lambda log: logs.access_summary(log, AS_OF)),
        f"{_TTL} SELECT count(*) AS files, round(avg(frequency), 4) AS avg_frequency, max(frequency) AS max_frequency, count(*) FILTER (frequency > 0.1) AS in_use, "
        "round(avg(stability), 4) AS avg_stability, count(*) FILTER (stability > 0.8) AS stable FROM ttl",
    ),
    "h5_instant_rate": (
        of_log(logs.instant_rate),
        f"{_O} SELECT session_id, record, round(CASE WHEN ts > first_value(ts) OVER w THEN (count(*) OVER w - 1) / ((epoch_us(ts) - epoch_us(first_value(ts) OVER w)) / 1000000.0) END, 6) AS rate "
        "FROM log WINDOW w AS (PARTITION BY session_id ORDER BY ts, record ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)",
    ),
    "g19_session_summary": (
        of_log(logs.session_summary),
        f"{_O} SELECT session_id, count(*) FILTER (operation_type = 'move') AS move, count(*) FILTER (operation_type = 'copy') AS copy, count(*) FILTER (operation_type = 'create_dir') AS create_dir, "
        "count(*) FILTER (operation_type = 'move_cover') AS move_cover, CAST(coalesce(sum(file_size) FILTER (status = 'completed'), 0) AS BIGINT) AS bytes_completed FROM latest GROUP BY 1",
    ),
    "h8_rollback_plan": (
        of_log(logs.rollback_plan),
        f"{_O} SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, record DESC) AS INT) AS step, id, "
        "CASE operation_type WHEN 'copy' THEN 'delete_copy' WHEN 'create_dir' THEN 'remove_dir' ELSE 'move_back' END AS action FROM latest WHERE status = 'completed'",
    ),
    "i4_recent_sessions": (of_log(logs.recent_sessions), f"{_O} SELECT session_id, min(ts) AS started FROM log GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
    "n7_retain": (
        of_log(lambda log: logs.retain(log, AS_OF, 10).select("id", "record", "status")),
        f"{_O} SELECT id, record, status FROM log WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 10 DAYS",
    ),
    "n1_events_where": (
        _of(catalog.DOMAIN_EVENTS_SQL, lambda log: logs.events_where(log, "view", "2024-01-10 00:00:00").select("record", "aggregate_id", "kind", "value")),
        f"{_D} SELECT record, aggregate_id, kind, value FROM log WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-10 00:00:00'",
    ),
    "n3_library_from_events": (
        _of(catalog.DOMAIN_EVENTS_SQL, logs.library_from_events),
        f"{_D} SELECT aggregate_id, count(*) FILTER (kind = 'RecordingAdded') AS added, count(*) FILTER (kind = 'RecordingRemoved') AS removed, added - removed AS balance FROM log GROUP BY 1",
    ),
    "n4_field_changes": (
        _of(catalog.DOMAIN_EVENTS_SQL, logs.field_changes),
        f"{_D} SELECT record, aggregate_id, lag(value) OVER (PARTITION BY aggregate_id ORDER BY ts, record) AS before, value AS after FROM log WHERE kind = 'MetadataUpdated' QUALIFY before <> after",
    ),
}
