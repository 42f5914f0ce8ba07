"""What keeps queries in bounds on large tables: plans and tables that are small here and large elsewhere."""

import pytest
from pyspark.sql import functions as F

from shellac.operators import classify, fuzzy, grouping, layout, likeness, organizing, patterns, recommend
from shellac.plans import grouping as grouping_plans
from shellac.plans import nesting, registry
from shellac.plans import upkeep as upkeep_plans
from shellac.sources import catalog
from shellac.tables import dropped, written

SF = "/root/testdata/sf0.001"


def test_similar_pairs_broadcast_no_table_of_forms(spark):
    table = spark.createDataFrame([("abcdefghij",), ("abcdefghix",)], "name string")
    plan = fuzzy.similar_pairs(table, "name", 0.9)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_tracks_by_another_order_of_joins_are_the_same(spark):
    plain, found = catalog.view(spark, SF, catalog.TRACKS_SQL), catalog.tracks(spark, SF)
    assert found.schema == plain.schema
    assert found.exceptAll(plain).count() == plain.exceptAll(found).count() == 0


def test_tracks_shuffle_lines_for_orders_and_parts_only(spark):
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.tracks(spark, SF)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    merges = [line.split("[")[1].split("#")[0] for line in plan.splitlines() if "SortMergeJoin" in line]
    assert merges == ["l_partkey", "l_orderkey", "o_custkey", "s_nationkey"]


def test_facts_read_the_tracks_once(spark):
    tracks = catalog.tracks(spark, SF)
    facts = recommend.library_facts(tracks, F.lit("studio"))
    assert not any("lineitem" in name for name in facts.inputFiles())
    assert facts.first()["tracks"] == tracks.count()
    assert recommend.library_facts(tracks.limit(0), F.lit("studio")).first()[:2] == (0, 0.0)


def test_candidates_share_artists_and_titles(spark):
    """A common artist among two and a common word are too little; "the " alone and containment are not."""
    shape = "class long, title string, artists array<string>, hash string, fingerprint string"
    rows = [(0, "red moon", ["a", "b"]), (1, "red moon", ["a", "c"]), (2, "red moon", ["a", "b"]), (3, "red sun", ["a", "b"]), (4, "red moon live", ["a", "b"]), (5, "red moon", ["the d"]), (6, "red moon", ["d"])]
    classes = spark.createDataFrame([(*r, None, None) for r in rows], shape)
    assert {tuple(r) for r in likeness.candidates(classes, 0.85).collect()} == {(0, 2), (0, 4), (2, 4), (5, 6)}


def _shuffle_files(spark):
    files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    table = written(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count())
    assert not _shuffle_files(spark) - before and table.select("k").collect()
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
    place = spark._jvm.org.apache.hadoop.fs.Path(table.inputFiles()[0])
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    assert system.exists(place)
    dropped(table)
    assert not system.exists(place)


@pytest.mark.parametrize("groups", [likeness.like_recordings, grouping.linked_groups, grouping.fast_duplicate_groups])
def test_likeness_meets_the_tracks_in_one_join_at_the_end(spark, groups):
    """Rows aren't joined to their class first, nor are the tracks read again."""
    tracks = grouping_plans.parts(catalog.tracks(spark, SF)).limit(500)
    found = groups(tracks, grouping_plans.ORDER)
    assert not any("lineitem" in name for name in found.inputFiles())
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_layout_reads_the_files_once(spark):
    """Problems come from a row for each directory, whatever they are asked for; odd paths stay what they were."""
    tracks = catalog.tracks(spark, SF)
    assert not any("lineitem" in name for name in organizing.validate_layout(tracks.select("path"), ("music",)).inputFiles())
    paths = ["/a/x.mp3", "/a/b/scan.png", "/a/b/c/y.FLAC", "/d/scan.png", "/d/scan.png", "/z.mp3", "/z.mp3", "/z.txt", "w.ogg", "e/scan.png", "/f", None]
    found = organizing.validate_layout(spark.createDataFrame([(p,) for p in paths], "path string"), ("a", "e", "g")).collect()
    want = [("in_root", "/z.mp3"), ("in_root", "w.ogg"), ("missing", "g"), ("no_media", "/d"), ("no_media", "e")]
    assert sorted(tuple(r) for r in found) == want


def test_genres_by_one_search_each(spark):
    rows = spark.createDataFrame([("Hip moon", "Club", "x"), ("shipping", "hops", "Rocks"), ("swing-fusion", None, "ost"), ("", "", "")], "t string, a string, p string").coalesce(1)
    found = rows.select(classify.genres_of(F.col("t"), F.col("a"), F.col("p"), F.lit(None).cast("string")).alias("f"))
    assert [r.f.genres for r in found.collect()] == [["electronic", "hiphop"], [], ["jazz", "soundtrack"], []]
    plan = rows.select(classify.genres_of(F.col("t"), F.col("a"), F.col("p"), F.col("p"))["genres"].alias("g"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == len(classify.GENRE_WORDS)


def test_payloads_are_parsed_once(spark):
    plan = nesting.PAIRS["a12_flatten_reference"][0](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_moves_are_read_and_shuffled_once(spark):
    """Numbered names and files that are there count whatever their order; other columns pass."""
    moves = [("1", "a.mp3"), ("2", "a.mp3"), ("3", "a (7).mp3"), ("4", "b.mp3"), ("5", "b.mp3"), ("6", "c (2) (3).x"), ("7", "c (2).x"), ("8", "c (2).x"), ("9", None)]
    moves = spark.createDataFrame([(*m, m[0]) for m in moves], "recording_id string, target string, kind string")
    there = spark.createDataFrame([("b.mp3",), ("b.mp3",), ("b (4).mp3",), (None,)], "target string")
    got = {r.recording_id: (r.conflict, r.final) for r in layout.plan_moves(moves, there, ("kind",)).filter("kind = recording_id").collect()}
    assert got == {
        "1": (False, "a.mp3"), "2": (True, "a (8).mp3"), "3": (False, "a (7).mp3"), "4": (True, "b (5).mp3"), "5": (True, "b (6).mp3"),
        "6": (False, "c (2) (3).x"), "7": (False, "c (2).x"), "8": (True, "c (2) (4).x"), "9": (False, None),
    }
    plan = upkeep_plans.PAIRS["g25_preview_stats"][0](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_extendedprice") and plan.count("Relation") == 6


def test_folders_of_a_pattern_are_cleaned_without_arrays(spark):
    rows = catalog.tracks(spark, SF)
    plan = rows.select(patterns.pattern_path(patterns.Pattern("decade"), patterns.values_of()).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" not in plan


def test_suffixes_without_a_search(spark):
    paths = ["/a/b.mp3", "/a.x/b", "/a/.hidden", ".x", "a..", "/a/b.c.d", "/a/", "", "b.", "/x/é.ü", None]
    rows = spark.createDataFrame([(p, "a, b", "A", "B", "T", 2000, "G", 1, 1) for p in paths], "path string, artists_raw string, primary_artist string, album string, title string, year int, genre string, track_number int, disc_number int")
    suffix = patterns.values_of()["file_extension"]
    assert "regexp_extract" not in str(suffix)
    got = rows.coalesce(1).select("path", suffix.alias("s"), F.regexp_extract("path", "[^/](\\.[^./]*)$", 1).alias("want")).collect()
    assert [r.s for r in got] == [r.want for r in got] and got[0].s == ".mp3" and got[-1].s is None


@pytest.mark.parametrize("name", ["d5_fill_from_lookup", "l7_plan_organization", "l8_identical_files", "l14_plan_by_release"])
def test_both_sides_of_a_join_come_from_one_read_of_the_tracks(spark, name):
    assert not any("lineitem" in file for file in registry.QUERIES[name](spark, SF).inputFiles())
