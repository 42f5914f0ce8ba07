"""Genres by votes of tags, rules and features, and how sure a classification is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shellac.functions.tags import given
from shellac.operators.rules import Rule, holds

#: Fixed values: (feature, genre, confidence) of features above 0.7; weaker hints have no band and count nothing.
FEATURE_HINTS = (("acousticness", "acoustic", 0.4), ("danceability", "dance", 0.4))


def genre_votes(genre: Column, features: dict[str, Column], voters: list[tuple[Column, str, float]]) -> Column:
    """Struct of `primary`, `secondary`, `sub` and `confidence`. The tag's genre votes with 0.8, then each voter (where it
    holds, genre, confidence) in turn, then the features. The first vote above 0.7 is primary, others above 0.5 are
    secondary and those above 0.3 sub genres, each once and in order; confidence is a fifth for each genre, 1 at most."""
    hints = [(F.coalesce(features[name] > 0.7, F.lit(False)), found, confidence) for name, found, confidence in FEATURE_HINTS if name in features]
    votes = [(given(genre), genre, 0.8)] + [(F.coalesce(holds, F.lit(False)), F.lit(name), confidence) for holds, name, confidence in voters]
    votes += [(holds, F.lit(name), confidence) for holds, name, confidence in hints]
    cast = F.array_compact(F.array(*[F.when(holds, F.struct(name.alias("genre"), F.lit(confidence).alias("confidence"), F.lit(at).alias("at"))) for at, (holds, name, confidence) in enumerate(votes)]))
    first = F.get(F.filter(cast, lambda v: v["confidence"] > 0.7), F.lit(0))
    rest = F.filter(cast, lambda v: F.coalesce(v["at"] != first["at"], F.lit(True)))
    band = lambda low, high: F.array_distinct(F.transform(F.filter(rest, lambda v: (v["confidence"] > low) & (v["confidence"] <= high)), lambda v: v["genre"]))
    secondary, sub = band(0.5, 1.0), band(0.3, 0.5)
    count = first.isNotNull().cast("int") + F.size(secondary) + F.size(sub)
    confidence = F.least(F.lit(1.0), count * 0.2)
    return F.struct(first["genre"].alias("primary"), secondary.alias("secondary"), sub.alias("sub"), confidence.alias("confidence"))


def overall_confidence(kind: Column, genre: Column, has_features: Column, level: Column) -> Column:
    """0.4 of the confidences of content type and genre each, and 0.3 with features; times 0.7 for a `low`, 1.2 for a
    `high` level, 1 at most. A null confidence counts 0."""
    sure = F.coalesce(kind, F.lit(0.0)) * 0.4 + F.coalesce(genre, F.lit(0.0)) * 0.4 + F.when(has_features, 0.3).otherwise(0.0)
    return F.least(F.lit(1.0), sure * F.when(level == "low", 0.7).when(level == "high", 1.2).otherwise(1.0))


def corrected_genres(genres: Column, own: Column, own_tags: Column) -> Column:
    """A user's own genre, if given, instead of `genres`, then the user's tags that aren't there yet."""
    chosen = F.coalesce(F.when(given(own), F.array(own)), genres, F.array().cast("array<string>"))
    more = F.filter(F.coalesce(own_tags, F.array().cast("array<string>")), lambda tag: ~F.array_contains(chosen, tag))
    return F.concat(chosen, more)


def best_kind(table: list[tuple[Rule, str, float]]) -> Column:
    """Struct of `kind`, `confidence` and `rule` of the rule that holds with the greatest confidence, 1 at most, the
    first among equals; null where none holds. Each row of the table is a rule, its content type and confidence."""
    found = [
        F.when(holds(rule), F.struct(F.least(F.lit(1.0), F.lit(sure)).alias("confidence"), F.lit(-at).alias("turn"), F.lit(kind).alias("kind"), F.lit(rule.name).alias("rule")))
        for at, (rule, kind, sure) in enumerate(table)
    ]
    best = F.array_max(F.array_compact(F.array(*found)))
    return F.when(best.isNotNull(), F.struct(best["kind"].alias("kind"), best["confidence"].alias("confidence"), best["rule"].alias("rule")))
