"""Mixing sources to target weights by exact token budgets.

Every document gets a hash-random key. Rows are range-sorted by it within their source: the keys are uniform, so
equal ranges of key space hold about equal numbers of rows. Running sums inside a range and prefix sums over the
ranges give each document's place in its source, and the source is cut at its exact budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shellac.llm.scratch import if_small, written

WORDS = "[^\\x20\\x09-\\x0D]+"
KEY_BITS = 40


def word_count(text: Column) -> Column:
    """Number of runs without ASCII spaces; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...], most_repeats: int) -> DataFrame:
    """(source, rows, source_size, target) from (source, rows, source_size), one row per source.

    Sources in code point order, null last, take the weights in turn. They share the total of all sizes by weight;
    no target exceeds `most_repeats` times its source's size, what is above is shared again by weight. In the order
    of size over weight the capped sources come first, so prefix sums find the level at which the rest share. The
    table has a row for each source of the mix only, which is what its one-partition windows hold.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (rank % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", most_repeats * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto, everything = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    ranked = ranked.select(
        "*",
        F.sum("source_size").over(everything).cast("double").alias("total"),
        F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("cap_before"),
        (F.sum("weight").over(everything) - F.sum("weight").over(upto) + F.col("weight")).alias("weight_from"),
    )
    # the level if all before are capped; the first source that isn't above its cap sets it for all from there on
    ranked = ranked.withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("weight_from"))
    ranked = ranked.withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    level = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = ranked.withColumn("_level", level)
    target = F.when(F.col("_level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("_level") * F.col("weight")))
    return ranked.select("source", "rows", "source_size", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    most_repeats: int = 3,
    seed: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    key_column: str | None = None,
) -> DataFrame:
    """One row per document: id (and key_column, if given: a long that tells rows apart), size (words), source_size,
    target (its source's budget), taken (words that the mix takes of it, repeats counted).

    A source passes whole as often as its budget holds, then documents follow in the order of their keys until the
    budget, rounded down to a word, is spent to the word. Nulls and texts without words have size 0 and are taken 0
    times; null is a source of its own. Rows that repeat an id have the same key and follow each other. Reruns agree;
    an empty table gives an empty result.
    """
    key = F.xxhash64(F.lit(seed), F.col(id_column).cast("string"), F.crc32(F.coalesce(F.col(text_column), F.lit(""))))
    thin = docs.select(
        F.col(id_column).alias("id"),
        F.col(source_column).cast("string").alias("source"),
        word_count(F.col(text_column)).alias("size"),
        F.shiftrightunsigned(key, 64 - KEY_BITS).alias("key"),
        (F.col(key_column) if key_column else F.lit(0)).cast("long").alias("row"),
    )
    thin = written(thin)
    sources = thin.groupBy("source").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    targets = written(source_targets(sources, weights, most_repeats))
    targets = targets.withColumnRenamed("source", "_source")
    placed = thin.join(if_small(targets), F.col("source").eqNullSafe(F.col("_source")))
    # ranges of key space: the square root of the rows in number and, about, in size
    ranges = F.ceil(F.sqrt("rows"))
    placed = placed.withColumn("range", F.floor(F.col("key") * ranges / F.lit(float(1 << KEY_BITS))).cast("long"))

    # a row for each range of each source; the running sum over them is per source
    spans = placed.groupBy("source", "range").agg(F.sum("size").alias("span"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("span").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "range").orderBy("key", "id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    summed = summed.join(spans, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))

    budget = F.floor(F.col("target") + F.lit(1e-6)).cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long")
    rest = budget - passes * F.col("source_size")
    cut = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("offset") - F.col("inside")))
    own = [F.col("row").alias(key_column)] if key_column else []
    return summed.select(
        F.col("id").alias(id_column), *own, "size", "source_size", "target", (passes * F.col("size") + cut).cast("long").alias("taken")
    )
