"""Pairs of like texts without comparing all with all."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellac.functions.tags import levenshtein_similarity


def _shorter(texts: Column) -> Column:
    """All texts that lack one letter of one of `texts`."""
    cut = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substr(t, F.lit(1), i - 1), F.substr(t, i + 1)))
    return F.array_distinct(F.flatten(F.transform(F.filter(texts, lambda t: F.length(t) > 0), cut)))


def similar_pairs(texts: DataFrame, column: str, least: float) -> DataFrame:
    """(one, other, score) of different texts with an edit similarity of at least `least`, each pair once, one < other.

    No pair is lost: texts within d edits have a text in common that each becomes by leaving out d letters at most, and
    d follows from the length of the longer one. So texts meet in an equi-join on what is left of them and on that
    length, whose groups hold only texts of nearly that similarity, and the exact test follows. A text of n letters has
    about n ** d / d! forms: this is for tags and names, not for long texts. Null texts are left out; equal ones count
    once."""
    if not 0.5 < least <= 1:
        raise ValueError("least must be above 0.5 and at most 1")
    distinct = texts.select(F.col(column).cast("string").alias("text")).filter("text IS NOT NULL").distinct()
    longest = distinct.agg(F.coalesce(F.max(F.length("text")), F.lit(0))).first()[0]
    room = lambda length: F.floor((1 - least) * length + 1e-9).cast("int")
    levels = [F.array("text")]
    for _ in range(math.floor((1 - least) * longest + 1e-9)):
        levels.append(_shorter(levels[-1]))
    forms = [F.when(F.lit(cuts) <= room(F.length("text") / least), level) for cuts, level in enumerate(levels)]
    cut = distinct.select("text", F.length("text").alias("n"), F.posexplode(F.array(*forms)).alias("cuts", "forms"))
    cut = cut.select("text", "n", "cuts", F.explode("forms").alias("form"))
    longer = cut.filter(F.col("cuts") <= room(F.col("n"))).select(F.col("text").alias("a"), "form", F.col("n").alias("length"))
    lengths = F.sequence(F.col("n"), F.floor(F.col("n") / least + 1e-9).cast("int"))
    other = cut.select(F.col("text").alias("b"), "form", "n", "cuts", F.explode(lengths).alias("length"))
    other = other.filter(F.col("cuts") <= room(F.col("length")) - (F.col("length") - F.col("n"))).select("b", "form", "length", "n")
    # Spark takes a table of exploded forms for as small as that of the texts: unhinted, it would broadcast it
    met = longer.join(other.hint("merge"), ["form", "length"]).filter((F.col("n") < F.col("length")) | (F.col("a") < F.col("b")))
    pairs = met.select(F.least("a", "b").alias("one"), F.greatest("a", "b").alias("other")).distinct()
    score = levenshtein_similarity(F.col("one"), F.col("other"))
    return pairs.filter(score >= least - 1e-9).select("one", "other", F.round(score, 6).alias("score"))
