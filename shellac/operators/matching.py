"""The best match of each text among many, found by growing edit distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellac.functions.tags import levenshtein_similarity
from shellac.tables import written

#: Bounds of the edit distance, one a round after equal texts; then whatever shares a letter is compared.
BOUNDS = (1, 2, 4, 8)


def _grams(text: str, size: Column) -> Column:
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - size + 1))
    grams = F.transform(places, lambda i: F.substr(F.col(text), i, size))
    return F.when(F.length(text) >= size, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def best_matches(targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """(target, match, score): for each distinct text of `targets` (a column `text`) the candidate (`text`, `place`) of the
    highest edit similarity, the first place among equals, the least text at one place; the first candidate with score 0 if
    none has a letter in common.

    Texts within d edits share one of any d + 1 disjoint pieces of the target. So in each round the targets still open meet the
    candidates that hold one of their pieces, and the exact distance is tested; a target is done once its best score is
    above what a larger distance can give, n / (n + d + 1) for n letters. Targets that are like nothing get to the last
    round, in which the pieces are letters. Null texts are left out; without candidates there are no rows."""
    rest = targets.select(F.col("text").alias("target")).filter("target IS NOT NULL").distinct()
    known = written(candidates.filter("text IS NOT NULL").groupBy("text").agg(F.min("place").alias("place")).withColumnRenamed("text", "match"))
    first = known.agg(F.min(F.struct("place", "match")).alias("f")).select("f.match", "f.place").filter("match IS NOT NULL")
    equal = known.select(F.col("match").alias("target"), F.col("place").alias("own"))
    rest = rest.join(equal, "target", "left").crossJoin(F.broadcast(first))
    start = F.col("own").isNotNull()
    rest = written(rest.select("target", F.when(start, F.col("target")).otherwise(F.col("match")).alias("match"), F.coalesce("own", "place").alias("place"), start.cast("double").alias("score")))
    done = [rest.filter("score = 1")]
    rest = rest.filter("score < 1")
    for bound in (*BOUNDS, None):
        size = F.lit(1) if bound is None else F.floor(F.length("target") / (bound + 1)).cast("int")
        pieces = _grams("target", size) if bound is None else F.transform(F.sequence(F.lit(0), F.lit(bound)), lambda i: F.substr(F.col("target"), i * F.col("size") + 1, F.col("size")))
        # pieces of one letter are left to the last round, but for short texts
        played = (size > 0) & ((size > 1) | F.lit(bound is None) | (F.length("target") <= 3))
        open_ = rest.withColumn("size", size).filter(played)
        sizes = [r.size for r in open_.select("size").distinct().collect()]  # as many as texts have letters at most
        if sizes:
            keyed = open_.select("target", "size", F.explode(F.array_distinct(pieces)).alias("piece"))
            held = known.select("match", "place", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size")).withColumn("piece", F.explode(_grams("match", F.col("size"))))
            met = keyed.join(held, ["size", "piece"])
            if bound is not None:
                met = met.filter((F.abs(F.length("target") - F.length("match")) <= bound) & (F.levenshtein("target", "match", bound) >= 0))
            scored = met.select("target", "match", "place", levenshtein_similarity(F.col("target"), F.col("match")).alias("score"))
            best = rest.unionByName(scored).groupBy("target").agg(F.min(F.struct((-F.col("score")).alias("minus"), "place", "match")).alias("b"))
            rest = written(best.select("target", "b.match", "b.place", (-F.col("b.minus")).alias("score")))
        if bound is not None:
            over = played & (F.col("score") > F.length("target") / (F.length("target") + bound + 1) + 1e-12)
            done.append(rest.filter(over))
            rest = rest.filter(~over)
            if rest.isEmpty():
                break
    out = rest
    for part in done:
        out = out.unionByName(part)
    return out.select("target", "match", F.round("score", 6).alias("score"))
