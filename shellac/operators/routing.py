"""Targets by rules, and how well a signature fits a recording."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellac.functions.tags import given
from shellac.operators import layout, rules


def route_by_rules(table: list[rules.Rule], fallback: str, columns: dict[str, Column]) -> Column:
    """The target from the template of the rule that counts (see rules.first_rule), or from `fallback` without one; rules
    without a template use the fallback's too."""
    ordered = sorted(table, key=lambda rule: -rule.priority)
    routes = [F.when(rules.holds(rule), layout.render_template(rule.template or fallback, columns)) for rule in ordered]
    return F.coalesce(*routes, layout.render_template(fallback, columns))


def rule_preview(tracks: DataFrame, table: list[rules.Rule], fallback: str, columns: dict[str, Column], k: int = 10, unmatched: bool = True) -> DataFrame:
    """(recording_id, source, target, rule) of the first k tracks by id; `rule` is null where none holds, and such
    tracks are left out unless `unmatched`."""
    out = tracks.select("recording_id", F.col("path").alias("source"), route_by_rules(table, fallback, columns).alias("target"), rules.first_rule(table).alias("rule"))
    return (out if unmatched else out.filter("rule IS NOT NULL")).orderBy("recording_id").limit(k)


def _matching(pattern: str) -> Callable[[Column], Column]:
    return lambda text: F.coalesce(text.rlike(f"(?i){pattern}"), F.lit(False))


def signature_score(
    title: Column, artists: Column, album: Column, genre: Column, patterns: list[tuple[str, str, float]], keywords: tuple[str, ...], excluded: tuple[str, ...] = ()
) -> Column:
    """Share of the weights that fit. Patterns are (title, artist, album or all; expression; weight), tried on the title,
    on each artist and on the album if there is one; a keyword in all texts together weighs 1, an excluded one takes 2
    off. Never below 0; 0 without patterns and keywords."""
    artists = F.coalesce(artists, F.array().cast("array<string>"))
    points, most = F.lit(0.0), F.lit(0.0)

    def add(fits: Column, weight: Column | float) -> None:
        nonlocal points, most
        points, most = points + fits.cast("double"), most + weight

    for where, pattern, weight in patterns:
        fits = _matching(pattern)
        if where in ("title", "all"):
            add(weight * fits(title).cast("int"), weight)
        if where in ("artist", "all"):
            add(weight * F.size(F.filter(artists, fits)), weight * F.size(artists))
        if where in ("album", "all"):
            add(weight * (given(album) & fits(album)).cast("int"), F.when(given(album), weight).otherwise(0.0))
    text = F.lower(F.concat_ws(" ", title, F.array_join(artists, " "), album, genre))
    for word in keywords:
        add(text.contains(word.lower()).cast("int"), 1.0)
    for word in excluded:
        add(-2 * text.contains(word.lower()).cast("int"), 0.0)
    return F.when(most > 0, F.greatest(F.lit(0.0), points / most)).otherwise(0.0)
