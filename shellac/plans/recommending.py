"""Queries on the state of a library and structures for it, and their equivalents in DuckDB's SQL."""

from __future__ import annotations

from shellac.operators import recommend
from shellac.plans.planning import _kind
from shellac.plans.queries import _T, Query, of_tracks
from shellac.plans.upkeep import _KIND

_FACTS = (
    _T + ", folders AS (SELECT len(string_split(d, '/')) > 2 AS deep FROM (SELECT regexp_replace(path, '/[^/]*$', '') AS d, count(*) AS n FROM tracks GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)), "
    "formats AS (SELECT count(*) / (SELECT count(*) FROM tracks) AS share FROM tracks GROUP BY file_type), "
    "base AS (SELECT count(*) AS tracks, round((2 * count(*) + count(year) + count(genre)) / count(*) / 4, 6) AS completeness, "
    f"count(DISTINCT {_KIND}) AS kinds, count(DISTINCT genre) AS genres, count(DISTINCT floor(year / 10)) AS decades FROM tracks), "
    "facts AS (SELECT *, round(least(1.0::DOUBLE, (1 - completeness) * 0.3 + coalesce((SELECT sum(share) FROM formats WHERE share < 0.7), 0) * 0.2 + least(0.2::DOUBLE, kinds / 6 * 0.1) "
    "+ (1 - (SELECT avg(deep::INT) FROM folders)) * 0.4), 6) AS chaos FROM base) "
)
_STRATEGIES = (
    "(VALUES ('artist_album', 'simple', '{artist}/{album} ({year})', 1.0), ('genre_artist_album', 'moderate', '{genre}/{artist}/{album} ({year})', 1.5), "
    "('decade_artist_album', 'moderate', '{decade}/{artist}/{album} ({year})', 1.5), ('smart_content_type', 'complex', '{content_type}/{artist}/{album} ({year})', 2.0), "
    "('flat_smart', 'simple', '{artist_first_letter}/{artist} - {album} - {title}', 1.0), "
    "('collection_based', 'complex', '{main_genre}/{content_type}/{artist}/{album} ({year})', 2.0)) s(strategy, complexity, folders, pace)"
)
_POINTS = (
    "0.5 + CASE WHEN completeness > 0.8 AND strategy IN ('artist_album', 'genre_artist_album', 'smart_content_type') THEN 0.3 WHEN completeness < 0.5 AND strategy = 'flat_smart' THEN 0.2 ELSE 0 END "
    "+ CASE WHEN tracks > 10000 AND strategy IN ('collection_based', 'genre_artist_album') THEN 0.2 WHEN tracks > 10000 AND strategy = 'flat_smart' THEN -0.1 "
    "WHEN tracks < 1000 AND strategy IN ('flat_smart', 'artist_album') THEN 0.2 WHEN tracks < 1000 AND strategy = 'collection_based' THEN -0.1 ELSE 0 END "
    "+ CASE WHEN strategy <> 'genre_artist_album' THEN 0 WHEN genres > 8 THEN 0.25 WHEN genres < 3 THEN -0.1 ELSE 0 END "
    "+ CASE WHEN strategy <> 'smart_content_type' THEN 0 WHEN kinds > 3 THEN 0.3 WHEN kinds = 1 THEN -0.1 ELSE 0 END "
    "+ CASE WHEN strategy = 'decade_artist_album' AND decades > 4 THEN 0.2 ELSE 0 END "
    "+ CASE WHEN chaos > 0.7 AND complexity <> 'simple' THEN 0.2 WHEN chaos < 0.3 AND complexity = 'simple' THEN 0.1 ELSE 0 END"
)

#: name: (query, SQL)
PAIRS: dict[str, tuple[Query, str]] = {
    "g12_chaos_score": (of_tracks(lambda t: recommend.library_facts(t, _kind())), _FACTS + "SELECT * FROM facts"),
    "l9_recommend_strategies": (
        of_tracks(lambda t: recommend.recommend_strategies(recommend.library_facts(t, _kind()))),
        _FACTS + f"SELECT strategy, complexity, folders, round(least(1.0, {_POINTS})::DOUBLE, 6) AS score, "
        f"CAST(floor(greatest(1.0::DOUBLE, tracks / 100) * pace * (1 + chaos * 0.5)) AS BIGINT) AS minutes FROM facts, {_STRATEGIES} ORDER BY score DESC, strategy DESC LIMIT 5",
    ),
}
