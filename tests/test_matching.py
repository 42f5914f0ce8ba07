"""Best matches against all pairs; warping against a plain table; similar tracks against brute force; odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest

from shellac.operators import covers, matching


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def _similarity(a, b):
    return 1 - _edits(a, b) / max(len(a), len(b)) if a or b else 1.0


def test_best_matches_are_all_pairs(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    candidates = words + words[:5] + ["", "zz"]
    targets = [w[:-1] for w in words[:20]] + [w + "x" for w in words[:10]] + ["".join(rng.sample(w, len(w))) for w in words[:20]] + ["", "a", "zz", "QQQQ", "b" * 40]
    got = {r.target: (r.match, r.score) for r in matching.best_matches(spark.createDataFrame([(t,) for t in [*targets, None]], "text string"), spark.createDataFrame(list(zip([*candidates, None], range(len(candidates) + 1), strict=True)), "text string, place long")).collect()}
    want = {}
    for t in targets:
        best, score = 0, 0.0
        for i, c in enumerate(candidates):
            if _similarity(t, c) > score:
                best, score = i, _similarity(t, c)
        want[t] = (candidates[best], round(score, 6))
    assert got == want


def test_the_least_text_among_candidates_of_a_place(spark):
    candidates = spark.createDataFrame([("moon2", 5), ("moon1", 5), ("moon0", 7), ("zz", 3), ("yy", 3)], "text string, place long")
    got = {tuple(r) for r in matching.best_matches(spark.createDataFrame([("moon",), ("QQ",)], "text string"), candidates).collect()}
    assert got == {("moon", "moon1", 0.8), ("QQ", "yy", 0.0)}


def test_no_candidates(spark):
    texts = spark.createDataFrame([("a",)], "text string")
    assert matching.best_matches(texts, spark.createDataFrame([], "text string, place long")).count() == 0
    assert matching.best_matches(texts.limit(0), spark.createDataFrame([("a", 1)], "text string, place long")).count() == 0


def _plain_dtw(a, b):
    n, m = len(a), len(b)
    cost, steps = {(0, 0): 0.0}, {(0, 0): 0}
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            ways = [(i - 1, j - 1), (i - 1, j), (i, j - 1)]
            best = min(ways, key=lambda w: cost.get(w, np.inf))
            cost[i, j] = cost[best] + float(np.sqrt(((a[i - 1] - b[j - 1]) ** 2).sum()))
            steps[i, j] = steps[best] + 1
    return max(0.0, 1 - cost[n, m] / steps[n, m] / 3)


def test_warping():
    rng = np.random.default_rng(3)
    a, b = rng.random((30, 7, 12)), rng.random((30, 9, 12))
    assert np.allclose(covers.warped(a, b), [_plain_dtw(x, y) for x, y in zip(a, b, strict=True)])
    slow = np.repeat(a, 2, axis=1)
    assert np.allclose(covers.warped(a, slow), 1)


def _tracks(spark, rng, count=60):
    base = rng.random((6, 8, 12))
    rows = [(i, float(rng.integers(60, 400)), (base[i % 6] + 0.2 * rng.random((8, 12))).tolist()) for i in range(count)]
    rows += [(count, 100.0, rows[0][2]), (count + 1, 100.0, rows[0][2])]  # ties
    odd = [(None, 100.0, rows[0][2]), (900, None, rows[0][2]), (901, 0.0, rows[0][2]), (902, 100.0, None), (903, 100.0, []), (904, 100.0, [[None] * 12])]
    return rows, spark.createDataFrame([(*r, "s", 1.0) for r in rows + odd], "id long, seconds double, frames array<array<double>>, query string, score double")


@pytest.mark.parametrize("method", covers.METHODS)
def test_similar_tracks(spark, method, monkeypatch):
    monkeypatch.setattr(covers, "BLOCK", 7)
    rows, frame = _tracks(spark, np.random.default_rng(8))
    queries = frame.filter("id % 3 = 0")

    def score(a, b):
        x, y = np.array(a), np.array(b)
        if method == "dtw":
            return _plain_dtw(x, y)
        if method == "euclidean":
            return max(0.0, 1 - np.linalg.norm(x.ravel() - y.ravel()) / 10)
        return max(0.0, np.corrcoef(x.ravel(), y.ravel())[0, 1])

    every = {q[0]: sorted((-round(score(q[2], t[2]), 9), t[0]) for t in rows if t[0] != q[0] and min(q[1], t[1]) / max(q[1], t[1]) >= 0.5) for q in rows if q[0] % 3 == 0}
    for k in (1, 10, 100):
        got = {}
        for r in covers.similar_tracks(queries, frame, method, 0.0, k=k).collect():
            got.setdefault(r.query, []).append((-round(r.score, 9), r.track))
        assert {q: sorted(v) for q, v in got.items()} == {q: v[:k] for q, v in every.items() if v}
    found = {(r.query, r.track): r.confidence for r in covers.find_covers(queries, frame, method).collect()}
    assert found == {(q, t): "high" if -s >= 0.75 else "medium" if -s >= 0.6 else "low" for q, v in every.items() for s, t in v if -s >= 0.5}


def test_columns_and_matches(spark):
    rows, frame = _tracks(spark, np.random.default_rng(9), 12)
    got = {(r.query, r.track): r.is_cover for r in covers.chroma_matches(frame.filter("id < 4"), frame).collect()}
    want = {(q[0], t[0]): _plain_dtw(np.array(q[2]), np.array(t[2])) for q in rows[:4] for t in rows if t[0] != q[0] and min(q[1], t[1]) / max(q[1], t[1]) >= 0.3}
    assert got == {k: v >= 0.6 for k, v in want.items() if v > 0.4}
    pair = spark.createDataFrame([([1.0, 2.0, 4.0], [2.0, 4.0, 8.5], [1.0, 2.0])], "a array<double>, b array<double>, c array<double>")
    r = pair.select(covers.correlation(pair.a, pair.b), covers.euclidean(pair.a, pair.b), covers.euclidean(pair.a, pair.c), covers.correlation(pair.a, pair.c)).first()
    assert r[0] == pytest.approx(np.corrcoef([1, 2, 4], [2, 4, 8.5])[0, 1]) and r[1] == pytest.approx(1 - np.sqrt(1 + 4 + 4.5**2) / 10) and r[2] == pytest.approx(0.6) and r[3] is None
    assert covers.similar_tracks(frame.limit(0), frame).count() == covers.similar_tracks(frame, frame.limit(0), k=3).count() == 0


def test_matches_leave_a_task_in_bounded_batches(spark):
    """Where all tracks are like all queries, a task holds few of the pairs; frames of different widths match nothing."""
    frames = np.arange(8.0).reshape(2, 4)
    ids = np.arange(3000)
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(3000, 60.0)), pa.array([frames.tolist()] * 3000)], ["id", "seconds", "frames"])
    sizes = [b.num_rows for b in covers._against([(q, 60.0, frames) for q in range(20)], "dtw", 0.5, 0.4, None)(iter([batch]))]
    assert sum(sizes) == 20 * 2999 and max(sizes) < covers.ROWS_AT_ONCE + 3000
    rows = spark.createDataFrame([(1, 60.0, [[1.0, 2.0], [3.0]]), (2, 60.0, [[1.0], [3.0]]), (3, 60.0, [[1.0], [3.0]])], "id long, seconds double, frames array<array<double>>")
    assert sorted((r.query, r.track, r.score) for r in covers.similar_tracks(rows, rows, "dtw").collect()) == [(2, 3, 1.0), (3, 2, 1.0)]
