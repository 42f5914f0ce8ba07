"""Covers and similar tracks by chroma features: a set of queries, block by block, against all tracks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellac.ship import ship
from shellac.tables import written

#: Similarity from which on a cover is of high or medium confidence.
HIGH, MEDIUM = 0.75, 0.60
#: Queries held by a task at once, and pairs whose warping is computed at once.
BLOCK, PAIRS_AT_ONCE = 256, 1024
#: Cells of warping tables held at once, and rows that a task gives back together.
CELLS, ROWS_AT_ONCE = 1 << 20, 10_000
METHODS = ("dtw", "correlation", "euclidean")


def correlation(a: Column, b: Column) -> Column:
    """Correlation of two arrays of numbers of one length, at least 0; 0 if one is constant, null of different lengths."""
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
    cells = F.zip_with(a, b, lambda p, q: F.struct(p.cast("double").alias("p"), q.cast("double").alias("q")))
    both = F.transform(F.array(F.struct(mean(a.cast("array<double>")).alias("ma"), mean(b.cast("array<double>")).alias("mb"))), lambda m: F.aggregate(
        cells,
        F.struct(F.lit(0.0).alias("ab"), F.lit(0.0).alias("aa"), F.lit(0.0).alias("bb")),
        lambda s, c: F.struct((s["ab"] + (c["p"] - m["ma"]) * (c["q"] - m["mb"])).alias("ab"), (s["aa"] + (c["p"] - m["ma"]) * (c["p"] - m["ma"])).alias("aa"), (s["bb"] + (c["q"] - m["mb"]) * (c["q"] - m["mb"])).alias("bb")),
        lambda s: F.when((s["aa"] == 0) | (s["bb"] == 0), 0.0).otherwise(F.greatest(F.lit(0.0), s["ab"] / F.sqrt(s["aa"] * s["bb"]))),
    ))[0]
    return F.when(F.size(a) == F.size(b), both)


def euclidean(a: Column, b: Column) -> Column:
    """1 less a tenth of the distance, at least 0; the shorter array counts as ending in zeros."""
    square = F.aggregate(F.zip_with(a, b, lambda p, q: F.coalesce(p.cast("double"), F.lit(0.0)) - F.coalesce(q.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, d: s + d * d)
    return F.greatest(F.lit(0.0), 1 - F.sqrt(square) / 10)


def _warped(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """`warped` of sequences with the pairs last (frames, features, pairs), where `x` may be one for all pairs.

    The table is filled diagonal by diagonal: a cell needs the last two only, and all cells of one are computed together."""
    n, m, count = len(x), len(y), y.shape[2]
    apart = np.zeros((n, m, count))
    for i in range(n):
        for feature in range(x.shape[1]):
            gap = y[:, feature] - x[i, feature]
            gap *= gap
            apart[i] += gap
    cells = np.sqrt(apart, out=apart).reshape(n * m, count)
    older, old = np.full((n + 1, count), np.inf), np.full((n + 1, count), np.inf)
    older_steps, old_steps = np.zeros((n + 1, count), dtype=np.int32), np.zeros((n + 1, count), dtype=np.int32)
    older[0] = 0
    for t in range(2, n + m + 1):
        low, high = max(1, t - m), min(n, t - 1)
        before, here = slice(low - 1, high), slice(low, high + 1)
        best = np.minimum(older[before], old[before])
        way = np.where(old[before] < older[before], old_steps[before], older_steps[before])
        way = np.where(old[here] < best, old_steps[here], way)
        new, new_steps = np.full((n + 1, count), np.inf), np.zeros((n + 1, count), dtype=np.int32)
        # a step along the diagonal is one frame of x more and one of y less
        on = cells[(low - 1) * m + t - low - 1 : (high - 1) * m + t - high : max(1, m - 1)]
        new[here], new_steps[here] = np.minimum(best, old[here]) + on, way + 1
        older, older_steps, old, old_steps = old, old_steps, new, new_steps
    return np.maximum(0.0, 1 - old[n] / np.maximum(1, old_steps[n]) / 3)


def warped(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of pairs of chroma sequences (pairs, frames, features) by dynamic time warping, so that tempo doesn't matter:
    1 less a third of the mean distance along the best path, at least 0. `a` may be one sequence for all pairs.

    Of equally short ways to a cell the diagonal one counts. So many pairs go together as have CELLS cells."""
    x, y = (np.ascontiguousarray(v.transpose(1, 2, 0)) for v in (a, b))
    return _by_parts(x, y)


def _by_parts(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    width = min(PAIRS_AT_ONCE, max(1, CELLS // (len(x) * len(y))))
    parts = [slice(at, at + width) for at in range(0, y.shape[2], width)]
    return np.concatenate([_warped(x if x.shape[2] == 1 else x[:, :, p], y[:, :, p]) for p in parts])


def _likeness(query: np.ndarray, tracks: np.ndarray, method: str) -> np.ndarray:
    """Likeness of a sequence (frames, features) and many (frames, features, tracks); those of different lengths only warped
    or padded."""
    if method == "dtw":
        return _by_parts(query[:, :, None], tracks)
    x, y = query.reshape(1, -1), tracks.reshape(-1, tracks.shape[2]).T
    if method == "euclidean":
        width = max(x.shape[1], y.shape[1])
        x, y = (np.pad(v, ((0, 0), (0, width - v.shape[1]))) for v in (x, y))
        return np.maximum(0.0, 1 - np.sqrt(((x - y) ** 2).sum(axis=1)) / 10)
    if x.shape[1] != y.shape[1]:
        return np.zeros(len(y))
    x, y = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
    size = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    return np.maximum(0.0, np.where(size > 0, (x * y).sum(axis=1) / np.where(size > 0, size, 1), 0.0))


def _by_shape(batch: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, seconds, sequences with the tracks last) of a batch's tracks for each number of frames and features, by length."""
    ids, seconds = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
    frames = batch.column(2).flatten()
    sizes, features = batch.column(2).value_lengths().to_numpy(), frames.value_lengths().to_numpy()
    values = frames.flatten().to_numpy(zero_copy_only=False)
    first = np.cumsum(sizes) - sizes
    starts = (np.cumsum(features) - features)[first]
    widths, out = features[first], []
    for n, m in sorted(set(zip(sizes.tolist(), widths.tolist(), strict=True))):
        own = np.flatnonzero((sizes == n) & (widths == m))
        own = own[np.argsort(seconds[own], kind="stable")]
        out.append((ids[own], seconds[own], values[(starts[own] + np.arange(n * m)[:, None])].reshape(n, m, len(own))))
    return out


def _against(queries: list[tuple[int, float, np.ndarray]], method: str, least_ratio: float, least: float, k: int | None):
    """Tracks against a block of queries; with `k`, a partition keeps only the best k of each query."""

    def found_in(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        shapes = _by_shape(batch) if batch.num_rows else []
        for query, length, chroma in queries:
            for ids, seconds, tracks in shapes:
                if tracks.shape[1] != chroma.shape[1]:
                    continue
                ratio = np.minimum(seconds, length) / np.maximum(seconds, length)
                # by length, so those that fit are neighbours
                fits = np.flatnonzero(ratio >= least_ratio)
                if not len(fits):
                    continue
                near = slice(fits[0], fits[-1] + 1)
                score = _likeness(chroma, tracks[:, :, near], method)
                kept = (score >= least) & (ids[near] != query)
                yield query, ids[near][kept], score[kept], ratio[near][kept]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[float, int, float]]] = {}
        waiting: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for query, ids, score, ratio in found_in(batch):
                if not len(ids):
                    continue
                if k is None:
                    waiting.append((query, ids, score, ratio))
                    if sum(len(w[1]) for w in waiting) >= ROWS_AT_ONCE:
                        yield _rows(waiting)
                        waiting = []
                    continue
                if len(score) > k:
                    # ties at the k-th place stay until the ids decide
                    best = score >= np.partition(score, len(score) - k)[len(score) - k]
                    ids, score, ratio = ids[best], score[best], ratio[best]
                rows = held.get(query, []) + list(zip((-score).tolist(), ids.tolist(), ratio.tolist(), strict=True))
                held[query] = sorted(rows)[:k]
        yield _rows(waiting)
        yield _rows([(q, *map(np.array, zip(*[(t, -s, r) for s, t, r in rows], strict=True))) for q, rows in held.items() if rows])

    return match


def _rows(found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    columns = [np.concatenate([np.full(len(f[1]), f[0]) for f in found] or [[]])] + [np.concatenate([f[i] for f in found] or [[]]) for i in (1, 2, 3)]
    kinds = pa.int64(), pa.int64(), pa.float64(), pa.float64()
    return pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns, kinds, strict=True)], ["query", "track", "score", "ratio"])


def similar_tracks(
    queries: DataFrame, tracks: DataFrame, method: str = "dtw", least: float = 0.5, least_ratio: float = 0.5, k: int | None = None
) -> DataFrame:
    """(query, track, score, ratio): tracks like each query by at least `least`, whose lengths differ by `least_ratio` at most;
    with `k`, the best k of each, of equal scores the least track. Both have id, seconds, and frames, an array of arrays.

    Queries go to the tasks in blocks of BLOCK, each a pass over the tracks, so a task holds one block, a batch of tracks
    and, with `k`, the best of its partition; the partitions' best are merged by a group-by. Rows with null id or length, a
    length of 0 or frames that are null, hold nulls or have different numbers of features match nothing, nor does a query its own id."""
    if method not in METHODS:
        raise ValueError(f"unknown method: {method}")

    def sound(df: DataFrame) -> DataFrame:
        full = F.forall("frames", lambda f: f.isNotNull() & (F.size(f) == F.size(F.col("frames")[0])) & F.forall(f, lambda v: v.isNotNull()))
        rows = df.select(F.col("id").cast("long").alias("id"), F.col("seconds").cast("double").alias("seconds"), F.col("frames").cast("array<array<double>>").alias("frames"))
        return rows.filter((F.col("seconds") > 0) & F.col("id").isNotNull() & (F.size("frames") > 0) & full)

    spark, rows = tracks.sparkSession, sound(tracks)
    ship(spark)
    wanted = written(sound(queries).withColumn("block", F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.lit(queries.count() // BLOCK)))))
    out = spark.createDataFrame([], "query long, track long, score double, ratio double")
    for block in sorted(r.block for r in wanted.select("block").distinct().collect()):
        held = [(r.id, r.seconds, np.array(r.frames)) for r in wanted.filter(F.col("block") == block).orderBy("id").collect()]
        out = out.unionByName(rows.mapInArrow(_against(held, method, least_ratio, least, k), out.schema))
    if k is not None:
        best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "track", "ratio"))), 1, k)
        out = out.groupBy("query").agg(best.alias("best")).select("query", F.inline("best")).select("query", "track", (-F.col("minus")).alias("score"), "ratio")
    return out


def find_covers(
    queries: DataFrame, tracks: DataFrame, method: str = "dtw", least: float = 0.5, cover: float = 0.45, least_ratio: float = 0.5
) -> DataFrame:
    """(query, track, score, ratio, confidence): similar_tracks that are covers, from a similarity of `cover` on; confidence is
    high from HIGH, medium from MEDIUM on, else low."""
    found = similar_tracks(queries, tracks, method, max(least, cover), least_ratio)
    level = F.when(F.col("score") >= HIGH, "high").when(F.col("score") >= MEDIUM, "medium").otherwise("low")
    return found.withColumn("confidence", level)


def chroma_matches(queries: DataFrame, tracks: DataFrame) -> DataFrame:
    """(query, track, score, ratio, is_cover): matches as a detector of duplicates reports them: warped, from 0.4 on, of
    lengths that differ by a ratio of 0.3 at most; covers from 0.6 on."""
    found = similar_tracks(queries, tracks, "dtw", 0.4, 0.3).filter("score > 0.4")
    return found.withColumn("is_cover", F.col("score") >= MEDIUM)
