"""Edit plans from files with their conditions, builders, and the likelihood of duplicates with untagged rows."""

import json

from shellac.operators import edits, resolution
from shellac.sources import files

PLAN = {
    "description": "what an edit plan can say",
    "operations": [
        {"name": "genres", "field": "genre", "operation": "transform", "pattern": "s/^rock$/Rock/g|s/^r&b$/R&B/g", "condition": {}, "conflict_strategy": "replace"},
        {"name": "zeros", "field": "track_number", "operation": "transform", "pattern": r"s/^0*(\d+)$/$1/g", "condition": {"track_number": {"regex": r"^0\d+$"}}},
        {"name": "album artist", "field": "albumartist", "operation": "copy", "value": "artist", "condition": {"albumartist": None}, "conflict_strategy": "skip"},
        {"name": "large", "field": "title", "operation": "transform", "pattern": r"s/\b(\w)/\U$1/g", "condition": {}},
        {"name": "live", "field": "year", "operation": "set", "value": 2023, "condition": {"album": {"regex": "(?i)live|tour"}, "genre": "Rock"}},
        {"name": "one year", "field": "album", "operation": "set", "value": "Of 1999", "condition": {"year": {"equals": 1999}}},
        {"name": "feat", "field": "title", "operation": "transform", "pattern": r"s/\s*\(Feat\..*?\)//g", "condition": {"title": {"contains": "(Feat."}}},
    ],
}


def test_plan_with_conditions(spark, tmp_path):
    (tmp_path / "plan.json").write_text(json.dumps(PLAN))
    plan = files.load_edits(spark, str(tmp_path / "plan.json"))
    assert [e.name for e in plan] == ["genres", "zeros", "album artist", "large", "live", "one year", "feat"]
    assert plan[2].where == (("albumartist", None),) and plan[4].where == (("album", {"regex": "(?i)live|tour"}), ("genre", "Rock"))
    rows = [
        (1, "rock", "07", None, "Anna", "hey you (feat. bob)", "On Tour", 2001),
        (2, "r&b", "7", "Them", "Anna", "two", "On Tour", 1999),
        (3, "rock", None, "", None, None, None, None),
        (4, "Rocky", "0", None, "Bob", "rock-n-roll O'Neil", "LIVE", 1999),
    ]
    frame = spark.createDataFrame(rows, "id int, genre string, track_number string, albumartist string, artist string, title string, album string, year int")
    got = {r.id: tuple(r)[1:] for r in edits.apply_edits(frame, plan).collect()}
    assert got[1] == ("Rock", "7", "Anna", "Anna", "Hey You", "On Tour", 2023, ["genres", "zeros", "album artist", "large", "live", "feat"])
    assert got[2] == ("R&B", "7", "Them", "Anna", "Two", "Of 1999", 1999, ["genres", "large", "one year"])
    assert got[3] == ("Rock", None, "", None, None, None, None, ["genres"])
    assert got[4] == ("Rocky", "0", "Bob", "Bob", "Rock-N-Roll O'Neil", "Of 1999", 1999, ["album artist", "large", "one year"])


def test_conditions(spark):
    frame = spark.createDataFrame([(1, "Rock", 2023, ["A", "B"]), (2, None, None, None), (3, "", 2023, [])], "id int, genre string, year int, artists array<string>")

    def holding(column, expected):
        return {r.id for r in frame.filter(edits.edit_condition(frame, column, expected)).collect()}

    assert holding("genre", "Rock") == {1} and holding("genre", "rock") == set() and holding("genre", None) == {2}
    assert holding("year", 2023) == {1, 3} and holding("year", "2023") == set() and holding("year", {"equals": 2023}) == {1, 3}
    assert holding("genre", {"contains": "oc"}) == {1} and holding("artists", {"contains": "B"}) == {1} and holding("artists", ["A", "B"]) == {1}
    assert holding("genre", {"regex": "^$"}) == set() and holding("genre", {}) == {1, 2, 3}
    assert holding("composer", None) == {1, 2, 3} and holding("composer", "x") == set()


def test_builders(spark):
    frame = spark.createDataFrame([(1, "rock", "CD-7/12", "Best", None, 1990), (2, "Jazz", "x", "best of", ["A"], None)], "id int, genre string, track_number string, album string, artists array<string>, year int")
    plan = [edits.standardize_genre({"rock": "Rock"}), *edits.capitalize_fields(["album"]), edits.fix_track_numbers("CD-"), edits.copy_album_to_artist_if_missing()]
    plan += [edits.add_artist("Z"), edits.rename_artist("A", "B"), edits.set_year(2000, "skip"), edits.set_genre("Pop", "skip")]
    got = {r.id: tuple(r)[1:6] for r in edits.apply_edits(frame, plan).collect()}
    assert got == {1: ("Rock", "CD-7", "Best", ["Best", "Z"], 1990), 2: ("Jazz", "x", "Best Of", ["B", "Z"], 2000)}
    assert [r.artists for r in edits.apply_edits(frame, [edits.remove_artist("A")]).orderBy("id").collect()] == [None, None]


def test_untagged_rows_are_no_duplicates(spark):
    rows = [(str(i), None, None) for i in range(8)] + [("8", "One", "A"), ("9", "Two", "A")]
    schema = "recording_id string, title string, primary_artist string"
    assert resolution.duplicate_likelihood(spark.createDataFrame(rows, schema)).first().likelihood == 0
    rows += [("10", "one!", "a"), ("11", "", "A"), ("12", "", "A"), ("13", "x", " ")]
    assert resolution.duplicate_likelihood(spark.createDataFrame(rows, schema)).first().likelihood == 0.5
    assert resolution.duplicate_likelihood(spark.createDataFrame(rows[:9], schema)).first().likelihood == 0
