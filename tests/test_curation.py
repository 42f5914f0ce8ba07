"""Edits, look-ups and streams on small literal tables: nulls, empty tables, ties and several batches."""

import datetime as dt

from pyspark.sql import functions as F

from shellac.functions import tags
from shellac.operators import edits, lookups, profile, resolution
from shellac.operators.edits import Edit
from shellac.streaming import events

SONGS = "id int, title string, composer string, artists array<string>"


def test_copy_remove_merge(spark):
    rows = [(1, "a", "x", ["p", "q"]), (2, "b", "", ["p"]), (3, None, None, None)]
    plan = [
        Edit("copy", "title", "copy", source="composer"),
        Edit("remove", "artists", "remove", value="p"),
        Edit("merge", "artists", "set", value=["q", "r"], strategy="merge"),
    ]
    out = edits.apply_edits(spark.createDataFrame(rows, SONGS), plan).orderBy("id").collect()
    assert [r.title for r in out] == ["x", "b", None]
    assert [r.artists for r in out] == [["q", "r"], ["q", "r"], ["q", "r"]]
    assert [r.applied for r in out] == [["copy", "remove", "merge"], ["remove", "merge"], ["merge"]]
    assert edits.apply_edits(spark.createDataFrame([], SONGS), plan).count() == 0


def test_tag_parsing(spark):
    texts = ["A feat. B", "A & B & C", "A x B", "Alexander", None, "5 of 12", "no digits", "(P) 1999", "2024-01-02", "1850 x"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    t = F.col("t")
    out = frame.select("i", tags.parse_artists(t).alias("a"), tags.parse_track_number(t).alias("n"), tags.extract_year(t).alias("y")).orderBy("i").collect()
    assert [r.a for r in out[:4]] == [["A", "B"], ["A", "B", "C"], ["A", "B"], ["Alexander"]]
    assert out[4].n is None and out[5].n == 5 and out[6].n is None
    assert [r.y for r in out[6:]] == [None, 1999, 2024, 1850]
    assert spark.range(1).select(tags.clock(F.lit(65.9)).alias("c"), tags.clock(F.lit(6000)).alias("d")).first()[:] == ("01:05", "100:00")


def test_manifest(spark):
    files = "path string, size long"
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], files)
    new = spark.createDataFrame([("a", 1), ("b", 3)], files)
    assert {tuple(r) for r in lookups.verify_manifest(old, new).collect()} == {("b", "size mismatch"), ("c", "missing")}
    states = lookups.restorable(old, new, new.filter("path = 'a'")).collect()
    assert {tuple(r) for r in states} == {("a", "target exists"), ("b", "restorable"), ("c", "backup missing")}
    assert lookups.verify_manifest(old.limit(0), new).count() == 0


def test_report_of_labels_that_are_never_given(spark):
    found = spark.createDataFrame([("x", "x"), ("x", "y"), ("z", "x")], "actual string, predicted string")
    rows = {r.label: (r.support, r.precision, r.recall, r.f1) for r in lookups.classification_report(found).collect()}
    assert rows == {"x": (2, 0.5, 0.5, 0.5), "y": (0, 0.0, 0.0, 0.0), "z": (1, 0.0, 0.0, 0.0)}


def test_empty_library(spark):
    columns = "recording_id string, primary_artist string, title string, album string, track_number int, duration_seconds double, size_bytes long, ord1 long, ord2 long, genre string"
    none = spark.createDataFrame([], columns)
    assert profile.file_details(none).first()[:] == (0.0, 0.0, 0.0, 0.0)
    assert resolution.duplicate_likelihood(none).first().likelihood in (None, 0.0)
    assert resolution.duplicate_summary(none).count() == resolution.earlier_duplicates(none).count() == resolution.releases_by_genre(none).count() == 0


def test_streams_over_several_batches(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=10 * i), i % 3, ("view", "purchase")[i % 2], float(i)) for i in range(60)]
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id int, event_type string, value double")
    path = str(tmp_path / "events")
    for low in range(0, 60, 20):
        frame.filter(F.col("event_id").between(low, low + 19)).coalesce(1).write.mode("append").parquet(path)

    def stream():
        return events.read_events(spark, path, files_per_batch=1)

    assert {r.event_id for r in events.last_events(stream(), 25).collect()} == set(range(35, 60))
    assert {r.event_type: r.events for r in events.running_counts(stream()).collect()} == {"view": 30, "purchase": 30}
    assert events.events_of_type(stream(), "view").count() == 30
    # each user has an event every half hour, so no gap closes a session before the end
    assert events.sessions(stream()).count() == 0
