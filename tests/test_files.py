"""Files in and out, patches on small tables, and like pairs against all pairs."""

import json
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from shellac.operators import fuzzy, layout, organizing, upkeep
from shellac.sources import files


def test_inventory_and_manifest(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    for name in ("a/one.MP3", "a/b/two.flac", "a/b/cover.jpg", "a/notes.txt"):
        (tmp_path / name).write_bytes(b"12345")
    found = files.scan_inventory(spark, str(tmp_path / "a"))
    assert sorted((r.path.rsplit("/", 1)[1], r.size) for r in found.collect()) == [("one.MP3", 5), ("two.flac", 5)]
    changes = found.select("path", F.when(F.col("path").endswith("flac"), "new").otherwise("unchanged").alias("change"))
    assert [r.path.rsplit("/", 1)[1] for r in files.scan_modified(found, changes).collect()] == ["two.flac"]
    files.write_manifest(files.scan_inventory(spark, str(tmp_path / "a"), ("jpg", "mp3")), str(tmp_path / "m"), "s1")
    assert sorted(r.kind for r in spark.read.parquet(str(tmp_path / "m")).collect()) == ["audio", "cover"]


def test_training_and_edits(spark, tmp_path):
    (tmp_path / "t.csv").write_text('text,genre\n"loud, fast",Rock\n,Jazz\nslow,\n')
    (tmp_path / "t.json").write_text('{"text": "x", "genres": ["Pop", "Rock"]}\nbroken\n{"text": "y", "genre": "Jazz"}\n')
    assert [tuple(r) for r in files.read_training(spark, str(tmp_path / "t.csv"), "csv").collect()] == [("loud, fast", "Rock")]
    assert sorted(tuple(r) for r in files.read_training(spark, str(tmp_path / "t.json"), "json").collect()) == [("x", "Pop"), ("y", "Jazz")]
    (tmp_path / "e.json").write_text(json.dumps([{"name": "n", "field": "genre", "operation": "set", "value": "Rock"}]))
    assert files.read_edits(spark, str(tmp_path / "e.json")).first().conflict_strategy == "replace"
    (tmp_path / "bad.json").write_text(json.dumps([{"name": "n", "field": "genre", "operation": "burn"}]))
    with pytest.raises(Exception, match="unknown operation: burn"):
        files.read_edits(spark, str(tmp_path / "bad.json")).collect()


def test_reports(spark, tmp_path):
    stats = spark.range(1).select(F.lit(3).alias("tracks"), F.lit(None).cast("int").alias("years"))
    files.export_stats(stats, str(tmp_path / "txt"), "txt")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "txt")).collect()) == ["tracks: 3", "years: "]
    moves = spark.createDataFrame([("1", "x/a.mp3"), ("2", "x/a.mp3")], "recording_id string, target string")
    files.export_plan(layout.plan_moves(moves), str(tmp_path / "plan"))
    rows = sorted(spark.read.json(str(tmp_path / "plan")).collect(), key=lambda r: r.recording_id)
    assert [(r.target, r.conflict.found) for r in rows] == [("x/a.mp3", False), ("x/a (1).mp3", True)]


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_similar_pairs_are_all_pairs(spark):
    texts = ["", "a", "ab", "abcdefghij", "abcdefghijk", "bcdefghijk", "abcdefghiX", "Xbcdefghij", "XbcdefghiX", "jihgfedcba", "aaaaaaaaaa", "aaaaaaaaaaaa", "äbcdefghij"]
    table = spark.createDataFrame([(t,) for t in [*texts, None, "ab"]], "name string")
    for least in (0.8, 0.9, 1.0):
        like = {tuple(sorted(p)) for p in combinations(texts, 2) if 1 - _edits(*p) / max(map(len, p)) >= least - 1e-9}
        assert {(r.one, r.other) for r in fuzzy.similar_pairs(table, "name", least).collect()} == like
    assert fuzzy.similar_pairs(table.limit(0), "name", 0.8).count() == 0


def test_covers_and_patches(spark):
    tracks = spark.createDataFrame([("1", "/x/a.mp3", "Rock"), ("2", "/y/b.mp3", None), ("3", None, "Jazz")], "recording_id string, path string, genre string")
    images = spark.createDataFrame([("/x/z.jpeg",), ("/x/b.jpg",), ("/x/My Front.png",), ("/x/cover.txt",)], "path string")
    found = {r.recording_id: r.cover for r in organizing.attach_cover(tracks, images).collect()}
    assert found == {"1": "/x/My Front.png", "2": None, "3": None}
    updates = spark.createDataFrame([("1", None), ("2", "Pop")], "recording_id string, genre string")
    for replace, first in ((False, ("Rock", [])), (True, (None, ["genre"]))):
        out = {r.recording_id: (r.genre, r.changed) for r in upkeep.patch_metadata(tracks, updates, ("genre",), replace).collect()}
        assert out == {"1": first, "2": ("Pop", ["genre"]), "3": ("Jazz", [])}


def test_stored_catalog_and_look_up(spark, tmp_path):
    schema = "recording_id string, path string"
    tracks = spark.createDataFrame([("1", "/x/a.mp3"), ("2", "/y/b.mp3"), ("3", None)], schema)
    tracks.write.parquet(str(tmp_path / "rows"))
    (tmp_path / "rows.jsonl").write_text('{"recording_id": "1", "path": "/x/a.mp3"}\n{"recording_id": "4"}\n')
    stored = files.read_catalog(spark, str(tmp_path / "rows"), schema)
    assert [r.recording_id for r in upkeep.by_path(stored, "/y/b.mp3").collect()] == ["2"]
    lines = files.read_catalog(spark, str(tmp_path / "rows.jsonl"), schema)
    assert sorted((r.recording_id, r.path) for r in lines.collect()) == [("1", "/x/a.mp3"), ("4", None)]
    assert upkeep.union_catalogs(stored, lines.select("recording_id")).count() == 5
