"""Learned genres and moods: held-out accuracy, splits that keep small classes, chances, and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from shellac.operators import training
from shellac.sources import catalog

WORDS = {"Rock": ["guitar", "loud", "amp", "riff"], "Jazz": ["sax", "swing", "blue", "trio"], "Folk": ["fiddle", "hill", "ballad", "reel"]}


def _rows(rng):
    rows = []
    for i in range(240):
        genre = rng.choice(["Rock", "Rock", "Rock", "Jazz"])
        rows.append((i, " ".join(rng.choices(WORDS[genre], k=3) + rng.choices(["song", "night", "love"], k=3)), genre))
    rows += [(500, "fiddle ballad reel", "Folk"), (501, "hill fiddle reel", "Folk"), (502, "reel", "Single")]
    return rows + [(600, "riff", None), (601, None, "Rock"), (602, "", "Rock"), (600, "riff", None)]


def test_text(spark):
    rows = [("T (Live) [x]", "Al [Deluxe]", "An", 1994, 100.0), (None, "", "A", 1850, 0.0), (None, None, None, None, None), ("T", "A", "B", 2000, 600.0), ("T", None, " ", 2100, 240.0)]
    frame = spark.createDataFrame(rows, "t string, a string, p string, y int, s double").coalesce(1)
    got = [r[0] for r in frame.select(training.genre_text(*map(F.col, "tapys"))).collect()]
    assert got == ["T   Al  An decade_1990 very_short", "A", "", "T A B decade_2000 extended", "T medium"]


def test_genres(spark):
    frame = spark.createDataFrame([(*r, 0, "x") for r in _rows(random.Random(5))], "id long, text string, genre string, label int, words string")
    split = training.split_rows(frame, "genre", ["id"])
    rows = split.collect()
    assert len(rows) == 245 and {r.genre for r in rows if not r.held_out} == {"Rock", "Jazz", "Folk", "Single"} and 25 < sum(r.held_out for r in rows) < 75
    assert {(r.id, r.held_out) for r in rows} == {(r.id, r.held_out) for r in training.split_rows(frame.repartition(3), "genre", ["id"]).collect()}
    model = training.train_genre(split)
    found = training.predict_genre(model, split)
    report = training.accuracy(found, "genre", "genres").first()
    assert report.accuracy > 0.9 and report.rows == sum(r.held_out for r in rows)
    everyone = training.predict_genre(model, frame).collect()
    assert len(everyone) == 247
    for r in everyone:
        chances = [g.chance for g in r.genres]
        assert len(chances) <= 5 and all(c > 0.1 for c in chances) and chances == sorted(chances, reverse=True) and sum(chances) <= 1 + 1e-9
    assert next(r for r in everyone if r.id == 500).genres[0].label == "Folk"
    with pytest.raises(ValueError):
        training.train_genre(frame.filter("genre IS NULL"))


def test_moods(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        v, e, d, a = (rng.random() for _ in range(4))
        rows.append((i, v, e, d if i % 9 else None, a, ("happy" if e > 0.5 else "calm") if v > 0.5 else ("angry" if e > 0.5 else "sad")))
    frame = spark.createDataFrame(rows + [(999, None, None, None, None, None)], "id long, valence double, energy double, danceability double, acousticness double, mood string")
    split = training.split_rows(frame, "mood", ["id"])
    model = training.train_mood(split, trees=20)
    found = training.predict_mood(model, split)
    assert training.accuracy(found, "mood", "moods").first().accuracy > 0.85
    weights = training.importances(model)
    assert sum(weights.values()) == pytest.approx(1) and min(weights["valence"], weights["energy"]) > max(weights["danceability"], weights["acousticness"])
    assert all(len(r.moods) <= 3 for r in training.predict_mood(model, frame).collect()) and training.predict_mood(model, frame).count() == 401


def test_learning_reads_the_rows_once(spark):
    """What is learned from is written, so the many passes of learning don't join the tracks again; labels are broadcast."""
    rows = catalog.tracks(spark, "/root/testdata/sf0.001").select("recording_id", F.col("title").alias("text"), "genre")
    split = training.split_rows(rows, "genre", ["recording_id"])
    assert not any("lineitem" in name for name in split.inputFiles())
    assert "SortMergeJoin" not in split._jdf.queryExecution().sparkPlan().toString()
    assert split.count() == rows.filter("trim(genre) <> ''").count()
