"""Totals over nested collections, and scan histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellac.tables import written


def closure(parents: DataFrame) -> DataFrame:
    """(node, above): every node of (node, parent) with each collection that it lies in, at any depth.

    By doubling: after k rounds all ancestors up to 2 ** k levels above are known, so rounds grow with the logarithm of the
    depth. A node on a cycle lies above itself. Null parents and repeated rows don't matter."""
    known = written(parents.filter("node IS NOT NULL AND parent IS NOT NULL").select("node", F.col("parent").alias("above")).distinct())
    count = known.count()
    while True:
        further = known.alias("l").join(known.alias("r"), F.col("l.above") == F.col("r.node")).select("l.node", "r.above")
        known = written(known.unionByName(further).distinct())
        before, count = count, known.count()
        if count == before:
            return known


def collection_rollup(parents: DataFrame, own: DataFrame) -> DataFrame:
    """(node, items, total, nested_items, nested_total, in_cycle): sums of the members (node, items, total) of each
    collection alone and with all collections nested in it. Collections that lie in themselves are marked, and each counts
    once in each other's sums; members of unknown collections are left out."""
    nodes = parents.select("node").union(parents.select("parent")).filter("node IS NOT NULL").distinct()
    sums = own.groupBy("node").agg(F.sum("items").alias("items"), F.sum("total").alias("total"))
    plain = nodes.join(sums, "node", "left").select("node", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("items", "total")])
    above = closure(parents)
    nested = above.filter("node != above").join(plain, "node").groupBy(F.col("above").alias("node")).agg(F.sum("items").alias("more_items"), F.sum("total").alias("more_total"))
    cycles = above.filter("node = above").select("node", F.lit(True).alias("in_cycle"))
    out = plain.join(nested, "node", "left").join(cycles, "node", "left")
    more = {c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(f"nested_{c}") for c in ("items", "total")}
    return out.select("node", "items", "total", more["items"], more["total"], F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"))


def scan_stats(inventory: DataFrame, sessions: DataFrame, latest: int = 10) -> DataFrame:
    """(kind, session_id, started, files): the number of files tracked, the last completed scan, and the latest sessions
    (session_id, started, status, files), by start and id."""
    tracked = inventory.agg(F.count_distinct("path").alias("files")).select(F.lit("tracked").alias("kind"), F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("timestamp").alias("started"), "files")
    rows = sessions.select("session_id", F.col("started").cast("timestamp").alias("started"), "files", "status")
    last = rows.filter("status = 'completed'").orderBy(F.desc("started"), "session_id").limit(1).select(F.lit("last completed").alias("kind"), "session_id", "started", "files")
    recent = rows.orderBy(F.desc("started"), "session_id").limit(latest).select(F.lit("recent").alias("kind"), "session_id", "started", "files")
    return tracked.unionByName(last).unionByName(recent)
