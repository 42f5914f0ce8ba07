"""All catalog queries by name, and their SQL."""

from __future__ import annotations

from shellac.plans import advising, classifying, grouping, matching, measures, nesting, patterns, planning, playlists, queries, recommending, resolving, routing, streams, training, upkeep, voting

#: name: (query, SQL)
PAIRS: dict[str, tuple[queries.Query, str]] = queries.PAIRS | planning.PAIRS | measures.PAIRS | resolving.PAIRS | streams.PAIRS | classifying.PAIRS | upkeep.PAIRS | routing.PAIRS | voting.PAIRS | recommending.PAIRS | grouping.PAIRS | matching.PAIRS | nesting.PAIRS | training.PAIRS | patterns.PAIRS | playlists.PAIRS | advising.PAIRS

#: What SQL can't express is tested against brute force.
WITHOUT_SQL: dict[str, queries.Query] = matching.WITHOUT_SQL | training.WITHOUT_SQL

QUERIES: dict[str, queries.Query] = {name: query for name, (query, _) in PAIRS.items()} | WITHOUT_SQL
ORACLE_SQL: dict[str, str] = {name: sql for name, (_, sql) in PAIRS.items()}
