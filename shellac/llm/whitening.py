"""Whitening of embeddings: distributed covariance, float32 eigenvectors refined in higher precision, projections.

Only sums per dimension and the covariance, d * d numbers for d dimensions, come to the driver, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellac.llm.scratch import small_batches, written

#: Entries are counted in steps of 1 / STEPS.
STEPS = 256
COMPONENTS = 4
#: Rounds of refinement: each squares the error, so it ends when the error no longer halves, or after MOST_ROUNDS.
LEAST_ROUNDS, MOST_ROUNDS = 3, 12
#: An eigenvalue below this share of the largest, times the dimensions, is nothing but rounding.
NOTHING = 1e-15

Batches = Iterator[pa.RecordBatch]


def in_steps(vector: Column) -> Column:
    """Each entry as a long, floor(STEPS * entry); beyond the range of a long, its end."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * STEPS))


def sound(vector: Column) -> Column:
    """Whether a vector is neither null nor holds null, NaN or infinite entries."""
    finite = F.forall(vector.cast("array<double>"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def _rows(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def _summed(batches: Batches, size: int) -> Batches:
    """Sums per dimension of a partition, exact: the upper and the lower 32 bits are added up apart."""
    high, low = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for batch in batches:
        x = _rows(batch.column(0), size)
        high += (x >> 32).sum(axis=0)
        low += (x & 0xFFFFFFFF).sum(axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(high), pa.array(low)], ["i", "high", "low"])


def _crossed(batches: Batches, project: Callable[[np.ndarray], np.ndarray], size: int, width: int) -> Batches:
    """A partition's sum of products of `width` centred columns, a row of the matrix each."""
    total = np.zeros((width, width))
    for batch in batches:
        y = project(_rows(batch.column(0), size))
        total += y.T @ y
    rows = pa.array(list(total), pa.list_(pa.float64()))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), rows], ["i", "row"])


def _added(batches: Batches) -> Batches:
    """Adds up the rows of one i; a task has some of the matrix' rows."""
    found: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            values = row.values.to_numpy()
            found[i] = found[i] + values if i in found else values
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.list_(pa.float64()))], ["i", "row"])


def _covariance(fit: DataFrame, project: Callable[[np.ndarray], np.ndarray], size: int, width: int, n: int) -> np.ndarray:
    """Covariance, divisor n, of the `width` columns that `project` makes of the fit list, already centred."""
    parts = fit.mapInArrow(lambda batches: _crossed(batches, project, size, width), "i int, row array<double>")
    rows = parts.repartition("i").mapInArrow(_added, "i int, row array<double>").collect()
    return np.array([r.row for r in sorted(rows, key=lambda r: r.i)]) / n


def _clusters(values: np.ndarray, gap: float) -> list[np.ndarray]:
    """Places of eigenvalues that follow each other within `gap`, two or more."""
    order = np.argsort(-values)
    cuts = np.flatnonzero(-np.diff(values[order]) > gap) + 1
    return [part for part in np.split(order, cuts) if len(part) > 1]


def refined_eigenvectors(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns, to double precision.

    The start are eigenvectors in float32. Each round corrects all of them at once by products of matrices in extended
    precision (Ogita and Aishima): the correction of i along j is (S_ij + e_j R_ij) / (e_j - e_i), where S = X'AX and
    R = I - X'X. Eigenvalues that are nearer than the error of the round can't be told apart this way: they form a cluster,
    whose vectors are only made orthogonal and then turned by an eigenproblem of the cluster alone, shifted to its middle,
    so that its small differences keep their digits. Of a multiple eigenvalue any basis comes out."""
    size = len(matrix)
    largest = np.abs(matrix).max(initial=0.0)
    if size == 0 or largest == 0:
        return np.zeros(size), np.eye(size)
    scale = np.ldexp(1.0, int(np.frexp(largest)[1]))
    a = (matrix / scale).astype(np.longdouble)
    one = np.eye(size, dtype=np.longdouble)
    norm = np.sqrt((a * a).sum())
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    before = np.inf
    for number in range(MOST_ROUNDS):
        r = one - x.T @ x
        s = x.T @ (a @ x)
        # equal roundings on both sides, or small gaps would turn them into vectors that aren't orthogonal
        r, s = (r + r.T) / 2, (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        error = 2 * (np.sqrt((off * off).sum()) + norm * np.sqrt((r * r).sum()))
        gaps = values[None, :] - values[:, None]
        near = np.abs(gaps) <= error
        change = np.where(near, r / 2, (s + values[None, :] * r) / np.where(near, 1, gaps))
        x = x + x @ change
        for cluster in _clusters(values, error):
            part = x[:, cluster]
            inner = part.T @ (a @ part - values[cluster].mean() * part)
            spread = np.abs(inner).max()
            if spread > 0:
                turned = np.linalg.eigh(((inner + inner.T) / (2 * spread)).astype(np.float64))[1]
                x[:, cluster] = part @ turned.astype(np.longdouble)
        if number >= LEAST_ROUNDS and error > before / 2:
            break
        before = error
    x = x / np.sqrt((x * x).sum(axis=0))
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    vectors = x[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(size)] < 0, -1, 1)
    return (values[order] * scale).astype(np.float64), vectors.astype(np.float64)


def _whitener(size: int, n: int, sums: list[int], weights: np.ndarray, known: np.ndarray, explained: list[float | None], error: float | None):
    """Rows (id, x) to a row for each component."""
    wrap = np.array([(s + (1 << 63)) % (1 << 64) - (1 << 63) for s in sums], dtype=np.int64)
    mean = np.array([s / n for s in sums])
    count = weights.shape[1]

    def whiten(batches: Batches) -> Batches:
        for batch in batches:
            fits = np.array(batch.column(2).to_pylist()) == size
            whitened = np.full((batch.num_rows, count), np.nan)
            deviation, exact = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)
            if fits.any():
                x = _rows(batch.column(1).filter(pa.array(fits)), size)
                centred = x - mean
                whitened[fits] = centred @ weights
                # modulo 2 ** 64 all steps are exact, so a sum that fits a long comes out right
                with np.errstate(over="ignore"):
                    y = x * np.int64(n) - wrap
                    deviation[fits] = (y * y).sum(axis=1)
                exact[fits] = (centred * centred).sum(axis=1) * float(n) * float(n) < 9.2e18
            whitened[:, ~known] = np.nan
            flat = whitened.reshape(-1)
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), count))),
                pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), batch.num_rows)),
                pa.array(np.full(len(flat), n, dtype=np.int64)),
                pa.array(np.repeat(deviation, count), mask=np.repeat(~exact, count)),
                pa.array(flat, mask=np.isnan(flat)),
                pa.array(explained * batch.num_rows, pa.float64()),
                pa.array([error] * len(flat), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return whiten


def whiten(
    vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding"
) -> DataFrame:
    """One row per vector and component: id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null or hold null or non-finite entries go. The others are counted in steps (see in_steps) and fitted
    on the distinct ones, n of them: their covariance's unit eigenvectors are the components, numbered by falling
    eigenvalue, and whitened is the centred vector's projection on one, over the root of its eigenvalue. deviation is the
    squared distance of n * x from the sums, exact; null if it doesn't fit a long. explained is the eigenvalue's share of
    the trace, identity_error the largest difference of the whitened fit list's covariance from the identity.

    Repeated rows and null ids stay, a row each. Vectors of another length than the commonest (of the longer, if two are as
    common) don't enter the fit; their deviation and whitened are null. A component without any variance has explained 0 and
    whitened null, and if there is no variance at all, explained and identity_error are null. Vectors of fewer dimensions
    than `components` have as many components as dimensions. An empty table, or only empty vectors, give no rows; other
    columns are not read.
    """
    small_batches(vectors.sparkSession)
    typed = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("vector")).filter(sound(F.col("vector")))
    rows = typed.select("id", in_steps(F.col("vector")).alias("x"))
    distinct = written(rows.select("x").distinct())
    lengths = distinct.groupBy(F.size("x").alias("size")).count()
    common = lengths.orderBy(F.desc("count"), F.desc("size")).first()
    shape = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    names = [F.col("id").alias(id_column), *(c for c in ("component", "n", "deviation", "whitened", "explained", "identity_error"))]
    if common is None or common["size"] == 0:
        return vectors.sparkSession.createDataFrame([], shape).select(*names)
    size, n = common["size"], common["count"]
    count = min(components, size)
    fit = distinct.filter(F.size("x") == size)

    exact = "decimal(38,0)"
    parts = fit.mapInArrow(lambda batches: _summed(batches, size), "i int, high long, low long").groupBy("i")
    totals = parts.agg(F.sum(F.col("high").cast(exact)).alias("high"), F.sum(F.col("low").cast(exact)).alias("low")).orderBy("i").collect()
    sums = [(int(r.high) << 32) + int(r.low) for r in totals]
    mean = np.array([s / n for s in sums])
    matrix = _covariance(fit, lambda x: x - mean, size, size, n)
    values, axes = refined_eigenvectors((matrix + matrix.T) / 2)
    trace = float(np.trace(matrix))
    known = values[:count] > NOTHING * size * max(values[0], 0.0)
    weights = axes[:, :count] / np.sqrt(np.where(known, values[:count], 1.0))
    explained = [float(e) / trace if k else (0.0 if trace > 0 else None) for e, k in zip(values[:count], known, strict=True)]
    error = None
    if known.any():
        white = _covariance(fit, lambda x: (x - mean) @ weights[:, known], size, int(known.sum()), n)
        error = float(np.abs(white - np.eye(len(white))).max())
    out = rows.select("id", "x", F.size("x").alias("size")).mapInArrow(_whitener(size, n, sums, weights, known, explained, error), shape)
    return out.select(*names)
