"""Keyed streams that stop and go on: the second drain continues from the state of the first."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from shellac.streaming import events, state

START = datetime(2024, 1, 1)


def _at(seconds):
    return START + timedelta(seconds=seconds)


def _put(spark, rows, schema, folder):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_earlier_duplicates_go_on(spark, tmp_path):
    schema, files, folder = "key string, recording_id string, place long", str(tmp_path / "in"), str(tmp_path / "out")
    first = [("a", "r1", 1), ("b", "r2", 2), ("a", "r3", 3), (None, "r4", 4)]
    _put(spark, first, schema, files)
    got = events.drained(state.earlier_duplicates(events.read_files(spark, files)), folder)
    assert sorted(tuple(r) for r in got.collect()) == [("r1", 0, None), ("r2", 0, None), ("r3", 1, "r1")]
    _put(spark, [("a", "r6", 6), ("a", "r5", 5), ("c", "r7", 7)], schema, files)
    got = events.drained(state.earlier_duplicates(events.read_files(spark, files)), folder)
    assert sorted(tuple(r) for r in got.collect())[3:] == [("r5", 2, "r3"), ("r6", 3, "r5"), ("r7", 0, None)]
    # nothing new: nothing comes twice
    assert events.drained(state.earlier_duplicates(events.read_files(spark, files)), folder).count() == 6


def test_earlier_duplicates_rank_a_batch_at_once(spark, tmp_path):
    """No Python state for each key; a batch that is repeated gives the same rows, not more."""
    files, folder = str(tmp_path / "in"), str(tmp_path / "out")
    drain = lambda: events.drained(state.earlier_duplicates(events.read_files(spark, files)), folder)
    for n in (1, 2):
        spark.range(3000).selectExpr("id % 2000 AS key", f"concat('{n}-', lpad(id, 4, '0')) AS recording_id", "id AS place").coalesce(1).write.mode("append").parquet(files)
        found = {r.recording_id: (r.earlier, r.previous) for r in drain().collect()}
    assert not (tmp_path / "out" / "state" / "state").exists()
    assert len(found) == 6000 and found["1-0005"] == (0, None) and found["1-2005"] == (1, "1-0005")
    assert found["2-0005"] == (2, "1-2005") and found["2-2005"] == (3, "2-0005") and found["2-1005"] == (1, "1-1005")
    for mark in (tmp_path / "out" / "state" / "commits").glob("*1*"):
        mark.unlink()
    assert {r.recording_id: (r.earlier, r.previous) for r in drain().collect()} == found and drain().count() == 6000


def test_reads_expire(spark, tmp_path):
    schema, files, folder = "key string, ts timestamp, record long, value double", str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("a", _at(0), 1, 1.5), ("a", _at(299), 2, None), ("a", _at(300), 3, None), ("b", _at(10), 4, None), ("a", _at(310), 5, 2.5), (None, _at(0), 6, 1.0)]
    _put(spark, rows, schema, files)
    stream = lambda: state.reads_with_ttl(events.read_events(spark, files), 300, "10 seconds")
    got = {r.record: (r.value, r.hit) for r in events.drained(stream(), folder).collect()}
    # at 300 seconds the entry has ended
    assert got == {2: (1.5, True), 3: (None, False), 4: (None, False)}
    _put(spark, [("a", _at(400), 7, None), ("a", _at(609), 8, None), ("a", _at(611), 9, None), ("c", _at(5000), 10, 9.0), ("a", _at(100), 11, None)], schema, files)
    got = {r.record: (r.value, r.hit) for r in events.drained(stream(), folder).collect()}
    # the late read is dropped, the entry of the first drain is still there for the second
    assert got == {2: (1.5, True), 3: (None, False), 4: (None, False), 7: (2.5, True), 8: (2.5, True), 9: (None, False)}
    _put(spark, [("c", _at(5001), 12, None), ("a", _at(5001), 13, None)], schema, files)
    got = {r.record: (r.value, r.hit) for r in events.drained(stream(), folder).collect()}
    assert got[12] == (9.0, True) and got[13] == (None, False)


def test_attempts_go_on(spark, tmp_path):
    schema, files, folder = "key string, record long, ok boolean", str(tmp_path / "in"), str(tmp_path / "out")
    _put(spark, [("a", 1, False), ("a", 2, False), ("b", 3, True), ("b", 4, False), ("c", 5, None)], schema, files)
    stream = lambda: state.retried(events.read_files(spark, files).withColumn("ok", F.coalesce("ok", F.lit(False))), 3)
    got = {r.record: (r.attempt, r.status) for r in events.drained(stream(), folder).collect()}
    assert got == {1: (1, "retry"), 2: (2, "retry"), 3: (1, "delivered"), 4: (2, "ignored"), 5: (1, "retry")}
    _put(spark, [("a", 6, False), ("a", 7, False), ("a", 8, True), ("c", 9, True)], schema, files)
    got = {r.record: (r.attempt, r.status) for r in events.drained(stream(), folder).collect()}
    assert {k: got[k] for k in (6, 7, 8, 9)} == {6: (3, "retry"), 7: (4, "given_up"), 8: (5, "ignored"), 9: (2, "delivered")}


def test_new_files_go_on(spark, tmp_path):
    schema, files, folder = "path string, size long, mtime timestamp", str(tmp_path / "in"), str(tmp_path / "out")
    _put(spark, [("/a", 1, _at(0)), ("/b", 1, _at(0)), ("/b", 2, _at(5)), ("/c", None, None)], schema, files)
    got = [tuple(r)[:2] + (r.change,) for r in state.new_files(events.read_files(spark, files), folder).collect()]
    assert sorted(got, key=str) == [("/a", 1, "new"), ("/b", 2, "new"), ("/c", None, "new")]
    _put(spark, [("/a", 1, _at(0)), ("/b", 3, _at(9)), ("/d", 4, _at(9)), ("/c", None, None)], schema, files)
    got = [tuple(r)[:2] + (r.change,) for r in state.new_files(events.read_files(spark, files), folder).collect()]
    assert sorted(got, key=str) == [("/a", 1, "new"), ("/b", 2, "new"), ("/b", 3, "modified"), ("/c", None, "new"), ("/d", 4, "new")]
    # a version that was cut short doesn't count
    last = max(events.versions(spark, f"{folder}/known"))
    (tmp_path / "out" / "known" / str(last + 1)).mkdir()
    assert max(events.versions(spark, f"{folder}/known")) == last and state.new_files(events.read_files(spark, files), folder).count() == 5


def test_tables_go_on(spark, tmp_path):
    schema, files = "event_id long, user_id long, event_type string, ts timestamp, value double", str(tmp_path / "in")
    _put(spark, [(1, 1, "view", _at(0), 1.0), (2, 1, "click", _at(1), 2.0)], schema, files)
    counts = lambda: {r.event_type: (r.events, r.total) for r in events.running_counts(events.read_events(spark, files), str(tmp_path / "counts")).collect()}
    last = lambda: sorted(r.event_id for r in events.last_events(events.read_events(spark, files), 2, str(tmp_path / "last")).collect())
    assert counts() == {"view": (1, 1.0), "click": (1, 2.0)} and last() == [1, 2]
    _put(spark, [(3, 2, "view", _at(9), 5.0)], schema, files)
    assert counts() == {"view": (2, 6.0), "click": (1, 2.0)} and last() == [2, 3] and last() == [2, 3]
