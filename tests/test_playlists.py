"""Playlists against all pairs, advice on fixed rows, types of tracks, and swaps of letters against a plain search."""

import random

import pytest
from pyspark.sql import functions as F

from shellac.functions import named, similarity
from shellac.operators import advice, classify, playlists

COLUMNS = "{} string, title string, artists array<string>, seconds double"


def _rows(kind, seed, n):
    pick = random.Random(seed)
    words = ["blue", "anvil", "blu", "river", "the", "night"]
    rows = []
    for i in range(n):
        title = pick.choice([None, "", " ".join(pick.choices(words, k=pick.randint(1, 3))), "Blue Anvil"])
        artists = pick.choice([None, [], ["The Anvils"], ["Anvils", None], ["Rivers", "Anvils"], ["Ünal"]])
        rows.append((f"{kind}{i:02}", title, artists, pick.choice([None, 0.0, 29.0, 30.0, 60.0, 61.0, 95.0])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_playlist_against_all_pairs(spark, seed):
    entries = spark.createDataFrame(_rows("e", seed, 25), COLUMNS.format("entry"))
    tracks = spark.createDataFrame(_rows("t", seed + 10, 40), COLUMNS.format("recording_id"))
    got = {r.entry: (r.recording_id, round(r.score, 6)) for r in playlists.match_playlist(entries, tracks).collect()}

    x, y = entries.toDF("entry", "et", "ea", "es").filter("et <> ''"), tracks.toDF("id", "tt", "ta", "ts").filter("tt <> ''")
    y = y.withColumn("a", F.explode("ta")).filter("a IS NOT NULL")
    x = x.withColumn("b", F.explode_outer("ea"))
    pairs = x.join(y, F.lit(True), "cross")
    alike = similarity.metadata_similarity
    pairs = pairs.groupBy("entry", "et", "ea", "es", "id", "tt", "ta", "ts").agg(F.max(F.coalesce(alike(F.col("b"), F.col("a")), F.lit(0.0))).alias("artist"))
    want = {}
    for r in sorted(pairs.withColumn("title", alike(F.col("et"), F.col("tt"))).collect(), key=lambda r: (r.entry, r.id)):
        timed = r.es is not None and r.ts is not None and r.ts > 0
        apart = abs(r.es - r.ts) if timed else 10
        score = min(1, (0.6 * r.title + 0.4 * r.artist) * (1.1 if apart < 5 else 0.5 if apart > 30 else 1))
        theirs = [a for a in r.ta if a is not None]
        mine = [a for a in r.ea or [] if a is not None]
        same = bool(mine) and (r.et.lower(), mine[0].lower()) == (r.tt.lower(), theirs[0].lower())
        if score >= 0.7:
            best = want.get(r.entry)
            if best is None or (same, round(score, 9)) > best[:2]:
                want[r.entry] = (same, round(score, 9), r.id)
    assert got == {e: (i, round(s, 6) if not same else 1.0) for e, (same, s, i) in want.items()}
    assert len(got) > 3


def test_playlist_edges(spark):
    none = spark.createDataFrame([], COLUMNS.format("entry"))
    one = spark.createDataFrame([("e", "a" * 200, ["x"], 10.0)], COLUMNS.format("entry"))
    track = spark.createDataFrame([("t", "a" * 199 + "b", ["x"], 10.0)] * 2, COLUMNS.format("recording_id"))
    assert playlists.match_playlist(none, track).count() == 0
    assert playlists.match_playlist(one, track.limit(0)).count() == 0
    assert [tuple(r)[:2] for r in playlists.match_playlist(one, track).collect()] == [("e", "t")]
    with pytest.raises(ValueError):
        playlists.match_playlist(one, track, 0.5)


def _least_edits(a, b):
    """By plain search over edits and swaps of neighbours, for short texts of a small alphabet."""
    letters, seen, edge, steps = set(a + b), {a}, {a}, 0
    while b not in seen:
        steps += 1
        new = set()
        for t in edge:
            new |= {t[:i] + t[i + 1 :] for i in range(len(t))} | {t[:i] + c + t[i:] for i in range(len(t) + 1) for c in letters}
            new |= {t[:i] + c + t[i + 1 :] for i in range(len(t)) for c in letters} | {t[:i] + t[i + 1] + t[i] + t[i + 2 :] for i in range(len(t) - 1)}
        edge = new - seen
        seen |= edge
    return steps


def test_swaps_count_once():
    pick = random.Random(5)
    for _ in range(60):
        a, b = ("".join(pick.choices("abc", k=pick.randint(0, 4))) for _ in range(2))
        assert named.transposition_distance(a, b) == _least_edits(a, b), (a, b)


def test_similarity_by_name(spark):
    named.register_functions(spark)
    rows = spark.sql("SELECT damerau_similarity(a, b) AS d, levenshtein_similarity(a, b) AS l FROM VALUES ('ab', 'ba'), ('', ''), (NULL, 'x') t(a, b)")
    assert [tuple(r) for r in rows.collect()] == [(0.5, 0.0), (1.0, 1.0), (None, None)]
    both = spark.createDataFrame([("ca", "abc"), ("", ""), (None, "x"), ("", "ab")], "a string, b string")
    assert [r.s for r in both.select(named.damerau_similarity(F.col("a"), F.col("b")).alias("s")).collect()] == [pytest.approx(1 / 3), 1.0, None, 0.0]


def test_all_types(spark):
    rows = [
        ("Night (Club Remix)", "A Remix Edit", "DJ Blue", "dance", 100.0, None),
        ("Episode 4 interview", "The Podcast", "x", None, 1000.0, "Podcast"),
        (None, None, None, None, None, "live"),
        ("Plain", "Plain", "x", "", 10.0, "nothing"),
    ]
    data = spark.createDataFrame(rows, "title string, album string, artist string, genre string, seconds double, tagged string")
    found = data.select(classify.all_types(*[F.col(c) for c in data.columns]).alias("f")).collect()
    got = [[(k.kind, round(k.score, 6)) for k in r.f] for r in found]
    # 0.3 title, 2 * 0.2 album, 0.4 artist, 0.1 genre: capped at 1
    assert got == [[("remix", 0.8)], [("podcast", 0.9)], [("live_recording", 0.9)], [("unknown", 0.5)]]


def test_advice(spark):
    facts = spark.createDataFrame([(100, 0.55, 21, 0.9)], "tracks long, completeness double, genres long, chaos double")
    best = spark.createDataFrame([("genre_artist_album", "moderate", "{genre}/{artist}")], "strategy string, complexity string, folders string")
    alike = spark.createDataFrame([(0.15,)], "likelihood double")
    mixed = spark.createDataFrame([(3, "mp3", 31, 6, 5)], "formats long, commonest string, lossless long, live long, compilation long")
    got = [(r.kind, r.place, r.text.split(":")[0][:12]) for r in advice.advise(facts, best, alike, mixed).collect()]
    assert got == [
        ("quick_win", 1, "Fix missing "), ("quick_win", 2, "Remove dupli"), ("quick_win", 3, "Consolidate "),
        ("issue", 1, "Low metadata"), ("issue", 2, "Too many gen"), ("issue", 3, "Very disorga"),
        ("rule", 1, "Live Recordi"), ("rule", 2, "High Quality"),
        ("step", 1, "Run duplicat"), ("step", 2, "Run MusicBra"), ("step", 3, "Consider con"), ("step", 4, "Manual clean"), ("step", 5, "Normalize fi"),
    ]


def test_playlist_looks_at_lists_in_turn(spark, monkeypatch):
    """Tracks that share the highest score: the least id, wherever it stands in the lists, also by a length that isn't near."""
    monkeypatch.setattr(playlists, "FIRST_LOOK", 1)
    monkeypatch.setattr(playlists, "MORE", 2)
    names = [f"supplier{i:03}" for i in range(40)]
    tracks = [(f"t{i:02}", "the large ring", ["zzz" if i < 25 else names[i]], 100.0 + i % 3) for i in range(40)]
    tracks += [("t20x", "A Lrge ring", ["b", "The supplier007"], 125.0), ("t30x", "large ring", ["supplier006"], None)]
    entries = [("a", "lrge ring", ["supplier008"], 101.0), ("b", "lrge ring", ["supplier007"], 101.0), ("c", "lrge ring", ["zzy"], 500.0), ("d", "large ring!", ["Supplier006."], 101.0)]
    entries, tracks = spark.createDataFrame(entries, COLUMNS.format("entry")), spark.createDataFrame(tracks, COLUMNS.format("recording_id"))
    got = {r.entry: (r.recording_id, r.score) for r in playlists.match_playlist(entries, tracks).collect()}
    assert got.pop("b") == ("t20x", 1.0)
    assert got["a"][1] == got["d"][1] == 1.0 and got["a"][0] > "t24" and "c" not in got


def test_equal_entries_and_tracks_are_matched_once(spark, monkeypatch):
    """Copies get the result of their like, an entry of several rows the best of theirs, and of equal tracks the least id counts."""
    asked, there = [], []
    matched = playlists._kinds_matched
    monkeypatch.setattr(playlists, "_kinds_matched", lambda e, t, least: asked.append(e.count()) or there.append(t.count()) or matched(e, t, least))
    shape = "{} string, title string, artists array<string>, seconds double"
    entries = spark.createDataFrame([(f"e{i:02}", "Red Moom", ["Anna"], None if i % 2 else 100.0) for i in range(20)] + [("e01", "Blue Sky", ["Bob"], 90.0)], shape.format("entry"))
    tracks = spark.createDataFrame([(f"r{i:02}", "Red Moon", ["Anna"], 100.0) for i in range(9, -1, -1)] + [("s1", "Blue Sky", ["Bob"], 90.0)], shape.format("recording_id"))
    got = {r.entry: (r.recording_id, r.score) for r in playlists.match_playlist(entries, tracks).collect()}
    assert asked == [3] and there == [2]
    assert got["e01"] == ("s1", 1.0) and len(got) == 20
    assert {got[e][0] for e in got if e != "e01"} == {"r00"} and got["e00"][1] > got["e03"][1] > 0.7
