"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosine checks, components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellac.llm import groups
from shellac.llm.components import components
from shellac.llm.scratch import written

#: Chance that a pair right at the threshold shares no bucket in any table.
MISS = 0.002
#: Bits of a table's key go with the logarithm of the number of vectors, from this on.
LEAST_BITS = 10
PAIRS_AT_ONCE = 20_000
SEED = 20_240_501


def table_plan(vectors: int, cosine: float) -> tuple[int, int]:
    """(bits, tables): buckets hold about one unrelated vector each, tables bring the miss chance below MISS."""
    bits = min(62, max(LEAST_BITS, math.ceil(math.log2(max(2, vectors)))))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(MISS) / math.log(1 - agree)))


def _vectors(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows, each scaled by a power of two so that squares neither overflow nor vanish."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, initial=0))[1][:, None])


def _hasher(bits: int, tables: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def hashes(batches):
        planes: dict[int, np.ndarray] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sizes = batch.column(2).to_numpy()
                for size in np.unique(sizes):
                    part = batch.filter(pa.array(sizes == size))
                    if size not in planes:
                        planes[size] = np.random.default_rng([SEED, int(size)]).standard_normal((int(size), bits * tables))
                    signs = (_vectors(part.column(1)) @ planes[size] > 0).reshape(part.num_rows, tables, bits)
                    keys = (signs.astype(np.int64) << np.arange(bits, dtype=np.int64)).sum(axis=2)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys.tolist(), pa.list_(pa.int64()))], ["class", "keys"])

    return hashes


def _linker(cosine: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per member of a batch's groups: links first found in this group's table, and the least node it's linked to
    through the batch."""

    def link(batches):
        for table in groups.whole_groups(batches):
            table = table.combine_chunks()
            classes, nodes, labels, copies, tables, sizes = (
                table[c].to_numpy() for c in ("class", "node", "label", "copies", "table", "dims")
            )
            keys = table["keys"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
            found = np.zeros(table.num_rows, dtype=np.int64)
            every: list[tuple[np.ndarray, np.ndarray]] = []
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                part = table.take(pa.array(own))
                unit = _vectors(part["vector"].combine_chunks())
                norms = np.sqrt((unit * unit).sum(axis=1))
                for i, j in groups.pairs_in(part, PAIRS_AT_ONCE):
                    value = (unit[i] * unit[j]).sum(axis=1) / (norms[i] * norms[j])
                    close = (value >= cosine) & (labels[own[i]] == labels[own[j]])
                    i, j = own[i[close]], own[j[close]]
                    if not len(i):
                        continue
                    every.append((i, j))
                    first = (keys[i] == keys[j]).argmax(axis=1) == tables[i]
                    found += np.bincount(i[first], weights=copies[j[first]], minlength=len(found)).astype(np.int64)
                    found += np.bincount(j[first], weights=copies[i[first]], minlength=len(found)).astype(np.int64)
            if every:
                distinct, where = np.unique(nodes, return_inverse=True)
                i, j = (where[np.concatenate(x)] for x in zip(*every, strict=True))
                least = distinct[groups.linked_stars(i, j, len(distinct))][where]
                keep = (found > 0) | (least != nodes)
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (classes, nodes, found, least)], ["class", "node", "found", "least"])

    return link


def similar_vectors(
    vectors: DataFrame, cosine: float = 0.98, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label"
) -> DataFrame:
    """One row per vector: id, n_links (other vectors linked directly), component_id, kept.

    Vectors are compared if their labels are equal and not null, by cosine in double precision; a pair of at least
    `cosine` is linked if it shares a bucket of some table, which all but MISS of the pairs right at the threshold
    do; no other is. Vectors that are null, empty, zero or hold null or non-finite components link with nothing,
    and so do vectors of different lengths. Rows that repeat an id are vectors of their own, but share one
    component. Rows with a null id link with nothing and are kept, with a null component_id. An empty table gives an
    empty result; other columns are not read.
    """
    typed = vectors.select(
        F.col(id_column).cast("long").alias("node"), F.col(label_column).alias("label"), F.col(vector_column).cast("array<double>").alias("vector")
    )
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    usable = F.coalesce(F.col("label").isNotNull() & F.col("node").isNotNull() & sound, F.lit(False))
    rows = written(
        typed.select("node", usable.alias("usable"), F.xxhash64("label", "vector").alias("d1"), F.xxhash64(F.lit("again"), "vector", "label").alias("d2"))
    )
    # equal vectors of a label are one class, for which its least id stands
    classes = typed.filter(usable).groupBy(F.xxhash64("label", "vector").alias("d1"), F.xxhash64(F.lit("again"), "vector", "label").alias("d2"))
    classes = classes.agg(
        F.min("node").alias("node"), F.count(F.lit(1)).alias("copies"), F.first(F.xxhash64("label")).alias("label"), F.first("vector").alias("vector")
    )
    classes = written(classes.withColumn("dims", F.size("vector")).withColumn("class", F.monotonically_increasing_id()))

    bits, tables = table_plan(classes.count(), cosine)
    hashed = classes.select("class", "vector", "dims").mapInArrow(_hasher(bits, tables), "class long, keys array<long>")
    hashed = written(classes.join(hashed, "class"))
    members = hashed.select("class", "label", F.posexplode("keys").alias("table", "key"))
    members = members.select("class", "table", F.xxhash64("label", "table", "key").alias("bucket"))
    payload = hashed.select("class", "node", "label", "copies", "dims", "keys", "vector")
    blocks = groups.in_blocks(members, "bucket", "class", payload)
    blocks = blocks.select("group", "block", "alone", "class", "node", "label", "copies", "table", "dims", "keys", "vector")
    linked = written(blocks.mapInArrow(_linker(cosine), "class long, node long, found long, least long"))

    counts = linked.groupBy("class").agg(F.sum("found").alias("found"))
    parts = components(linked.select(F.col("node").alias("a"), F.col("least").alias("b")))
    known = classes.select("d1", "d2", "class", "node", "copies").join(counts, "class", "left").join(parts, "node", "left")
    known = known.select("d1", "d2", "copies", "found", F.coalesce("component", "node").alias("component")).filter("copies > 1 OR found > 0 OR component != node")
    out = rows.join(known.withColumn("usable", F.lit(True)), ["usable", "d1", "d2"], "left")
    component = F.when(F.col("node").isNotNull(), F.coalesce("component", "node"))
    return out.select(
        F.col("node").alias(id_column),
        F.coalesce(F.col("copies") - 1 + F.coalesce("found", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("node"), F.lit(True)).alias("kept"),
    )
