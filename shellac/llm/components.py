"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellac.llm.scratch import written

#: A node of more neighbours than this, and than a HUBS-th of all edge ends, is a hub; so there are at most HUBS.
HUB_EDGES = 500
HUBS = 100_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _step(edges: DataFrame, large: bool, hub: int | None) -> DataFrame:
    """One star step: each node hands the least node it knows of to its larger (or else smaller) neighbours.

    The least node comes from a partially aggregated group-by and a join. Nodes of more than `hub` neighbours, at most
    HUBS of them, are joined by a broadcast, so that no task gets all edges of a hub; None if there are none."""
    around = _both_ways(edges)
    least = around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    # a merge join, whatever the size: a broadcast in each step would only add jobs and buffers to the driver
    joined = around.join(least.select("a", "m").hint("merge"), "a") if hub is None else None
    if joined is None:
        hubs = F.broadcast(least.filter(F.col("n") > hub).select("a", "m"))
        others = least.filter(F.col("n") <= hub).select("a", "m")
        joined = around.join(hubs, "a").select("a", "b", "m")
        joined = joined.unionAll(around.join(hubs, "a", "left_anti").join(others.hint("merge"), "a").select("a", "b", "m"))
    if large:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        smaller = joined.filter(F.col("b") < F.col("a"))
        out = smaller.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            smaller.select("a", F.col("m").alias("b"))
        )
    return out.filter(F.col("a") != F.col("b")).distinct()


def _largest_degree(edges: DataFrame) -> int:
    return _both_ways(edges).groupBy("a").count().agg(F.max("count")).first()[0] or 0


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (columns a, b): component is the least node that it reaches.

    Edges with a null end and loops are left out; repeated edges don't matter; no edges give no rows. Each round is
    written to the shared folder; only a row count, a checksum and the largest degree come to the driver.
    """
    edges = written(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen, hub = None, None
    while True:
        # not by an Observation: once a session has one, Spark's ML models can't be sent to executors any more
        state = edges.agg(F.count(F.lit(1)).alias("edges"), F.bit_xor(F.xxhash64("a", "b")).alias("sum")).first()
        if state == seen or state["edges"] == 0:
            break
        # stars grow from round to round, so degrees are measured until there is a hub; few edges can't have one
        if hub is None and state["edges"] > HUB_EDGES:
            least = max(HUB_EDGES, 2 * state["edges"] // HUBS)
            hub = least if _largest_degree(edges) > least else None
        # with hubs a step reads its edges several times, so each step is written
        large = _step(edges, True, hub)
        edges = written(_step(large if hub is None else written(large), False, hub))
        seen = state
    # at the fixed point every edge leads from a node to its component's least node
    leaves = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
