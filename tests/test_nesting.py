"""Tags of each format, payloads, documents and nested collections on literal rows."""

import json

from pyspark.sql import functions as F

from shellac.functions import recordings, tag_maps
from shellac.operators import documents, lookups, rollups
from shellac.sources import payloads

FIELDS = ("artists", "primary_artist", "album", "title", "genre", "year", "date", "track_number", "location", "has_cover")


def test_tags_of_formats(spark):
    rows = [
        ("flac", {"ARTIST": ["A, B", "A", "C"], "ALBUM": ["X"], "TITLE": ["T"], "GENRE": ["Rock", "Pop"], "DATE": ["1999-05-01"], "TRACKNUMBER": ["5/12"], "VENUE": ["Rome"]}),
        ("ogg", {"ARTIST": ["A"], "ALBUMARTIST": ["Z"], "DATE": ["May 1999"], "TRACKNUMBER": ["x5"], "LOCATION": ["Oslo"], "VENUE": ["Rome"]}),
        ("MP3", {"TPE1": ["A, B"], "TPE2": [], "TALB": ["X"], "TIT2": [""], "TYER": ["2001"], "TRCK": ["07"], "APIC:": ["?"]}),
        ("m4a", {"©ART": ["A"], "aART": ["Z"], "©alb": ["X"], "©nam": ["T"], "©gen": ["Jazz"], "©day": ["2010-01-01T00:00"], "trkn": ["3", "9"], "covr": []}),
        ("wma", {"Artist": ["B"], "Author": ["A"], "AlbumTitle": ["X"], "Album": ["Y"], "Title": ["T"], "ReleaseDate": ["1988"], "TrackNumber": ["4/9"]}),
        ("ape", {"Artist": ["A,B"], "Album Artist": ["Z"], "Release Date": ["1977"], "Track": ["4/9"], "Title": ["T"]}),
        ("wav", {"TPE1": ["A", "B"], "TIT2": ["T"], "TALB": ["X"], "TCON": ["Rock"], "TRCK": ["1"]}),
        ("txt", {"ARTIST": ["A"]}),
        ("flac", {}),
        ("flac", None),
        (None, {"ARTIST": ["A"]}),
    ]
    frame = spark.createDataFrame(rows, "kind string, tags map<string, array<string>>").coalesce(1)
    got = [tuple(r) for r in frame.select(*[c.alias(n) for n, c in tag_maps.normalized_tags(F.col("kind"), F.col("tags")).items()]).select(*FIELDS).collect()]
    none = (None, None, None, None, None, None, None, None, None, False)
    assert got == [
        (["A", "B", "C"], "A", "X", "T", "Rock", 1999, "1999-05-01", 5, "Rome", False),
        (["A"], "Z", None, None, None, None, "May 1999", None, "Oslo", False),
        (["A, B"], "A, B", "X", None, None, 2001, None, 7, None, True),
        (["A"], "Z", "X", "T", "Jazz", 2010, None, 3, None, True),
        (["A"], "A", "X", "T", None, 1988, None, None, None, False),
        (["A", "B"], "Z", None, "T", None, 1977, None, 4, None, False),
        (["A", "B"], "A", "X", "T", None, None, None, None, None, False),
        none, none, none, none,
    ]


def test_payloads(spark):
    track = lambda number, own: {"recording": {"id": own}} | ({"number": number} if number is not None else {})
    one = {"id": "r", "releases": [{"date": "1969-09-26", "artist-credit": [{"x": 1}, {"artist": {"name": "The Band"}}, {"artist": {"name": "B"}}], "media": [{"tracks": [track("1", "q"), track("3", "r"), track("9", "r")]}]}, {"date": "2000"}]}
    one["tags"] = [{"name": n} for n in "abcdefg"]
    unnumbered = {"id": "r", "releases": [{"date": "late", "media": [{"tracks": [track("1", "q"), track(None, "r")]}, {"tracks": [track("A1", "r")]}, {"formats": []}]}]}
    later = {"id": "r", "releases": [{"media": [{"tracks": [track("3", "r")]}, {"tracks": [track("4", "r")]}]}]}
    texts = [json.dumps(one), json.dumps(unnumbered), json.dumps(later), "{}", "not json", None, json.dumps({"id": "r", "releases": [], "tags": []})]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, payload string")
    got = [tuple(r)[1:] for r in frame.select("i", *[c.alias(n) for n, c in payloads.flatten_reference(F.col("payload")).items()]).orderBy("i").collect()]
    assert got == [(1969, "The Band", 3, "a, b, c, d, e"), (None, None, 2, None), (None, None, 4, None)] + [(None,) * 4] * 4


def test_documents(spark):
    rows = [(f"r{i}", "A", "X", (i * 7) % 10 if i else None, f"t{i}", 60.0, None if i < 3 else 2000 + i, "Rock") for i in range(10)]
    rows += [("n1", "A", None, 1, "u", 1.0, None, None), ("n2", None, " ", 1, None, 1.0, 1999, "Pop")]
    tracks = spark.createDataFrame(rows, "recording_id string, primary_artist string, album string, track_number int, title string, duration_seconds double, year int, genre string")
    docs = {(r.artist, r.title, r.part): r for r in documents.album_documents(tracks, 4).collect()}
    assert set(docs) == {("A", "X", 0), ("A", "X", 1), ("A", "X", 2), ("A", documents.UNKNOWN, 0), (None, documents.UNKNOWN, 0)}
    lines = [t for part in range(3) for t in docs["A", "X", part].tracks]
    # tracks without a number come last
    assert [t.place for t in lines] == list(range(1, 11)) and [t.number for t in lines] == [*range(1, 10), None]
    assert docs["A", "X", 0].year == 2003 and docs["A", "X", 0].genre == "Rock" and docs["A", documents.UNKNOWN, 0].year is None
    xml = documents.album_documents(tracks, 4).filter("part = 2").select(documents.as_xml(documents.album_documents(tracks, 4), "album").alias("x")).first().x
    assert xml.startswith("<album>") and xml.count("<tracks>") == 2
    artists = {(r.name, r.part): r for r in documents.artist_documents(tracks, 1).collect()}
    assert set(artists) == {("A", 0), ("A", 1), (None, 0)} and artists["A", 1].albums[0].title == "X" and artists["A", 1].albums[0].tracks == 10
    assert documents.album_documents(tracks.limit(0)).count() == documents.artist_documents(tracks.limit(0)).count() == 0


def test_report(spark):
    rows = [("a", "a", "keep", 5), ("a", "b", "delete", 3), ("a", "c", "move", None)]
    got = [tuple(r) for r in documents.resolution_report(spark.createDataFrame(rows, "leader string, recording_id string, action string, size_bytes long")).collect()]
    assert json.loads(got[0][1]) == {"groups": 1, "kept": 1, "moved": 1, "deleted": 1, "saved": 3} and len(got) == 4


def test_collections(spark):
    # a chain of 20 levels, two branches, a cycle of three and one of one
    rows = [(i, i - 1 if i > 0 else None) for i in range(21)] + [(50, 5), (51, 50), (60, 61), (61, 62), (62, 60), (63, 60), (70, 70), (None, 1), (3, 2)]
    parents = spark.createDataFrame(rows, "node long, parent long")
    own = spark.createDataFrame([(i, 1, 10 * i) for i in (*range(21), 50, 51, 60, 61, 62, 63, 70)] + [(20, 1, 5), (999, 1, 1)], "node long, items int, total long")
    got = {r.node: r for r in rollups.collection_rollup(parents, own).collect()}
    assert got[0].nested_items == 24 and got[0].nested_total == 10 * sum(range(21)) + 5 + 500 + 510 and got[0].items == 1
    assert got[5].nested_items == 19 and got[20].nested_items == 2 == got[20].items and got[50].nested_total == 1010
    assert {n for n, r in got.items() if r.in_cycle} == {60, 61, 62, 70} and got[60].nested_items == 4 and got[70].nested_items == 1 and 999 not in got
    assert rollups.collection_rollup(parents.limit(0), own.limit(0)).count() == 0


def test_pair_scores(spark):
    row = ("Hey Jude", ["The Beatles", "X"], "Hey Jude", 431.0, "f", "hey jude live", ["beatles"], None, 446.0, "f")
    frame = spark.createDataFrame([row], "t string, a array<string>, b string, s double, f string, t2 string, a2 array<string>, b2 string, s2 double, f2 string")
    sides = [dict(zip(("title", "artists", "album", "seconds", "fingerprint"), map(F.col, names), strict=True)) for names in (("t", "a", "b", "s", "f"), ("t2", "a2", "b2", "s2", "f2"))]
    got = frame.select(*[c.alias(n) for n, c in recordings.pair_scores(*sides).items()]).first()
    assert (round(got.title, 6), got.artist, got.album, got.duration, got.acoustic, got.is_similar) == (0.666667, 0.5, 0.0, 0.5, 1.0, False)
    same = frame.select(*[c.alias(n) for n, c in recordings.pair_scores(sides[0], sides[0]).items()]).first()
    assert round(same.overall, 6) == 1 and same.is_similar


def test_fill_from_lookup(spark):
    tracks = [(1, "A", "T", "X", None, " ", 5), (2, "a ", "t", "Y", None, "Pop", 5), (3, "A", "T", None, 1999, None, 5), (4, None, "T", "X", None, None, 5), (5, "B", "T", "X", None, None, 5), (1, "A", "T", "X", None, " ", 5)]
    found = [("A", "T", "x", 2001, "Rock"), ("A", "T", "X", 2000, None), ("a", "T", "A first", 1990, "Jazz"), (None, "T", "X", 1, "No"), ("A", None, "X", 1, "No"), ("C", "T", "X", 1, "No")]
    frame = spark.createDataFrame(tracks, "id int, primary_artist string, title string, album string, year int, genre string, answer int")
    ref = spark.createDataFrame(found, "artist string, title string, album string, year int, genre string")
    got = sorted((r.id, r.year, r.genre, tuple(r.filled), r.answer) for r in lookups.fill_from_lookup(frame, ref, ("year", "genre")).collect())
    first = (1, 2000, " ", ("year",), 5)
    assert got == [first, first, (2, 1990, "Pop", ("year",), 5), (3, 1999, "Jazz", ("genre",), 5), (4, None, None, (), 5), (5, None, None, (), 5)]
    assert lookups.fill_from_lookup(frame.limit(0), ref, ("year",)).count() == 0
