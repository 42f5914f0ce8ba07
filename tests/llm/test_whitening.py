"""Whitening against numpy, refinement against double eigenvectors and residuals, and odd rows."""

import math

import numpy as np
import pytest

from shellac.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, id int, x string, n string, size int"


def _rows(frame, **more):
    return [r.asDict() for r in whitening.whiten(frame, **more).collect()]


def _plain(vectors, count):
    x = np.floor(256 * np.array(vectors)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    white = (x - total / n) @ axes[:, :count] / np.sqrt(values[:count])
    return n, ((n * x - total) ** 2).sum(axis=1), white, values[:count] / values.sum()


def _check(frame, vectors, count):
    rows = _rows(frame)
    n, deviation, white, explained = _plain(vectors, count)
    assert {r["n"] for r in rows} == {n} and len(rows) == count * len(vectors) and len({r["identity_error"] for r in rows}) == 1
    got = np.zeros((len(vectors), count))
    for r in rows:
        assert r["deviation"] == deviation[r["vec_id"]] and math.isclose(r["explained"], explained[r["component"] - 1], rel_tol=1e-9)
        got[r["vec_id"], r["component"] - 1] = r["whitened"]
    for k in range(count):
        sign = np.sign(got[:, k] @ white[:, k])
        assert np.abs(sign * got[:, k] - white[:, k]).max() < 1e-6
    assert rows[0]["identity_error"] < 1e-10


def test_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    _check(frame, [r.embedding for r in frame.orderBy("vec_id").collect()], 4)


def test_copies_and_few_dimensions(spark):
    """A third of all rows is one vector, which counts once."""
    rng = np.random.default_rng(1)
    vectors = [[float(v) for v in r] for r in rng.standard_normal((60, 3)) * (3, 2, 1)] + [[0.5, 0.25, -1.0]] * 30
    _check(spark.createDataFrame([(i, v, 1, "a", "b", 2) for i, v in enumerate(vectors)], SCHEMA), vectors, 3)


@pytest.mark.parametrize("size", [1, 2, 7, 40])
@pytest.mark.parametrize("kind", ["spread", "cluster", "multiple", "zero"])
def test_refinement(size, kind):
    rng = np.random.default_rng(size)
    axes = np.linalg.qr(rng.standard_normal((size, size)))[0]
    values = np.sort(rng.uniform(1, 100, size))[::-1]
    if kind == "cluster":
        values[: size // 2] = 200 * (1 + 1e-10 * np.arange(size // 2)[::-1])
    if kind == "multiple":
        values[: size // 2] = 200
    if kind == "zero":
        values[size // 2 :] = 0
    matrix = (axes * values) @ axes.T
    matrix = (matrix + matrix.T) / 2
    found, vectors = whitening.refined_eigenvectors(matrix)
    plain, plain_vectors = np.linalg.eigh(matrix)
    wide = matrix.astype(np.longdouble)
    assert np.abs(found - plain[::-1]).max() <= 1e-13 * max(values[0], 1) and (np.diff(found) <= 0).all()
    assert np.abs(vectors.T @ vectors - np.eye(size)).max() < 1e-14
    assert np.abs(wide @ vectors - vectors * found).max() < 1e-14 * max(values[0], 1)
    if kind == "spread":
        assert np.abs(np.abs((vectors * plain_vectors[:, ::-1]).sum(axis=0)) - 1).max() < 1e-12
    if kind == "cluster":
        assert all(abs(x) > 1 - 1e-3 for x in (vectors * axes).sum(axis=0)[size // 2 :])


def test_clusters_keep_their_digits():
    """Eigenvalues that double precision can't tell apart at the matrix' size but that are apart in it."""
    matrix = np.diag([1.0, 1.0 + 2.0**-40, 0.5])
    matrix[0, 1] = matrix[1, 0] = 2.0**-42
    values, vectors = whitening.refined_eigenvectors(matrix)
    angle = 0.5 * math.atan2(2 * 2.0**-42, 2.0**-40)
    assert abs(abs(vectors[0, 0]) - math.sin(angle)) < 1e-6 and values[0] > values[1] > values[2]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, -2.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0]), (7, []), (8, [-0.0, 0.001])]
    frame = spark.createDataFrame([(*r, 1, "a", "b", 2) for r in rows], SCHEMA)
    got = _rows(frame)
    # three distinct vectors of the commonest length
    assert {r["n"] for r in got} == {3} and sorted((r["vec_id"] or 0) for r in got) == sorted([1, 1, 1, 1, 0, 0, 6, 6, 7, 7, 8, 8])
    assert all((r["whitened"] is None) == (r["vec_id"] in (6, 7)) == (r["deviation"] is None) for r in got)
    assert _rows(frame.limit(0)) == [] and _rows(frame.filter("vec_id = 7")) == []
    alone = _rows(frame.filter("vec_id = 1"))
    assert len(alone) == 4 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in alone)
    flat = _rows(spark.createDataFrame([(1, [1.0, 2.0], 1, "a", "b", 2), (2, [3.0, 2.0], 1, "a", "b", 2)], SCHEMA))
    assert [(r["explained"], r["whitened"] is None) for r in flat if r["component"] == 2] == [(0.0, True)] * 2
    huge = _rows(spark.createDataFrame([(i, [s * 1e300, 1.0], 1, "a", "b", 2) for i, s in enumerate((1, -1, 1))], SCHEMA))
    assert len(huge) == 6 and all(r["deviation"] is None for r in huge)
