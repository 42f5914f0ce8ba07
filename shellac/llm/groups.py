"""Pairs inside groups, a batch of rows at a time: groups are cut into blocks so that no task holds an unbounded one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block; a task compares two blocks at a time.
BLOCK_ROWS = 1024


def in_blocks(members: DataFrame, key: str, node: str, payload: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`members` with columns group (a long for each pair of blocks of each key) and block, sorted by group.

    Keys of one row go; the others' rows get what `payload` has of their node. A key of s rows has ceil(s / block_rows) blocks, dealt by a hash of `node`; each pair of
    blocks, and each block with itself, is a group, so every pair of rows of a key meets in exactly one group
    (rows of one block meet in the group of that block alone)."""
    sizes = members.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    blocks = F.ceil(F.col("_rows") / F.lit(block_rows)).cast("int")
    cut = members.join(sizes, key).join(payload, node).withColumn("_blocks", blocks)
    cut = cut.withColumn("block", F.pmod(F.xxhash64(F.col(node), F.lit(7)), F.col("_blocks")).cast("int"))
    cut = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    low, high = F.least("block", "_other"), F.greatest("block", "_other")
    cut = cut.withColumn("alone", low == high).withColumn("group", F.xxhash64(F.col(key), low, high))
    return cut.drop("_rows", "_blocks", "_other").repartition("group").sortWithinPartitions("group")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold whole groups of a partition sorted by group; what a batch has of its last one waits."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        groups = batch.column("group").to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(groups, groups[-1]))
        if last > 0 or (waiting and waiting[-1].column("group")[-1].as_py() != groups[-1]):
            yield pa.Table.from_batches([*waiting, batch.slice(0, last)])
            waiting = []
        waiting.append(batch.slice(last))
    if waiting:
        yield pa.Table.from_batches(waiting)


def pairs_in(table: pa.Table, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i before j) of rows of one group, at most about `at_once` or those of one row at a time."""
    groups = table["group"].to_numpy()
    block = table["block"].to_numpy()
    alone = table["alone"].to_numpy()
    ends = np.searchsorted(groups, groups, side="right")
    counts = ends - np.arange(len(groups)) - 1
    total = np.cumsum(counts)
    start = 0
    while start < len(groups):
        done = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, done + at_once, side="right")))
        own = counts[start:stop]
        first = np.repeat(np.arange(start, stop), own)
        second = np.arange(len(first)) - np.repeat(np.cumsum(own) - own, own) + first + 1
        keep = alone[first] | (block[first] != block[second])
        if keep.any():
            yield first[keep], second[keep]
        start = stop


def linked_stars(first: np.ndarray, second: np.ndarray, count: int) -> np.ndarray:
    """For each of `count` nodes the least node of its component by the links first-second."""
    label = np.arange(count)
    while True:
        low = np.minimum(label[first], label[second])
        new = label.copy()
        np.minimum.at(new, first, low)
        np.minimum.at(new, second, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new
