"""Rule tables compiled to Columns, so that matching them takes no join and no shuffle."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Condition:
    """One comparison of a column with a value; see `condition` for the operators."""

    column: str
    operator: str
    value: object = None
    case_sensitive: bool = False


@dataclass(frozen=True)
class Rule:
    """A rule holds where all its conditions do; of several, the one of highest priority counts, then the first."""

    name: str
    conditions: tuple[Condition, ...]
    priority: int = 0
    template: str = ""
    tags: tuple[str, ...] = field(default=())


def condition(c: Condition) -> Column:
    """The comparison as a boolean Column that is never null: null counts as empty text, and a text that isn't a number
    fails every comparison of size."""
    raw = F.coalesce(F.col(c.column).cast("string"), F.lit(""))
    if c.operator in ("is_empty", "is_not_empty"):
        empty = F.trim(raw) == ""
        return empty if c.operator == "is_empty" else ~empty
    if c.operator in ("gt", "lt", "ge", "le"):
        number, bound = raw.try_cast("double"), float(str(c.value))
        sizes = {"gt": number > bound, "lt": number < bound, "ge": number >= bound, "le": number <= bound}
        return F.coalesce(sizes[c.operator], F.lit(False))
    if c.operator in ("matches", "not_matches"):
        found = raw.rlike(str(c.value) if c.case_sensitive else f"(?i){c.value}")
        return found if c.operator == "matches" else ~found
    text = raw if c.case_sensitive else F.lower(raw)
    if c.operator in ("in", "not_in"):
        values = c.value if isinstance(c.value, (list, tuple)) else str(c.value).split(",")
        inside = text.isin([str(v) if c.case_sensitive else str(v).lower() for v in values])
        return inside if c.operator == "in" else ~inside
    value = str(c.value) if c.case_sensitive else str(c.value).lower()
    plain = {"eq": text == value, "ne": text != value, "contains": text.contains(value), "not_contains": ~text.contains(value)}
    plain |= {"starts": text.startswith(value), "ends": text.endswith(value)}
    return plain[c.operator]


def holds(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule.conditions:
        out = out & condition(c)
    return out


def _ordered(rules: list[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda rule: -rule.priority)


def first_rule(rules: list[Rule]) -> Column:
    """Name of the rule that counts, null where none holds."""
    return F.coalesce(*[F.when(holds(rule), F.lit(rule.name)) for rule in _ordered(rules)], F.lit(None).cast("string"))


def all_rules(rules: list[Rule]) -> Column:
    """Names of all rules that hold, in order of priority."""
    return F.array_compact(F.array(*[F.when(holds(rule), F.lit(rule.name)) for rule in _ordered(rules)]))


def match_matrix(tracks: DataFrame, rules: list[Rule]) -> DataFrame:
    """(recording_id, rule, matched): a row for each track and rule."""
    cells = F.array(*[F.struct(F.lit(rule.name).alias("rule"), holds(rule).alias("matched")) for rule in _ordered(rules)])
    return tracks.select("recording_id", F.inline(cells))


def rule_usage(tracks: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, tracks) by the rule that counts; tracks without one under `fallback`."""
    return tracks.groupBy(F.coalesce(first_rule(rules), F.lit("fallback")).alias("rule")).agg(F.count(F.lit(1)).alias("tracks"))


def rule_tags(tracks: DataFrame, rules: list[Rule]) -> DataFrame:
    """(tag, tracks) over all rules that hold."""
    tags = F.flatten(F.array_compact(F.array(*[F.when(holds(r), F.array(*[F.lit(t) for t in r.tags])) for r in rules if r.tags])))
    return tracks.select(F.explode(F.array_distinct(tags)).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("tracks"))


def validate_rules(rules: DataFrame) -> DataFrame:
    """(name, problem) of a rule table with columns name, field and pattern: names used twice, empty fields or patterns."""
    empty = [F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"empty {c}")) for c in ("name", "field", "pattern")]
    own = rules.select("name", F.explode(F.array_compact(F.array(*empty))).alias("problem"))
    twice = rules.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name", F.lit("name used twice").alias("problem"))
    return own.unionByName(twice)
