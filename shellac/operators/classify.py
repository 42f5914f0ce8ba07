"""Content types, genres and moods of tracks as Columns: additive scores over fixed patterns, no join and no shuffle."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, weights, genres and moods must be these for right results.
LIVE = ("\\blive\\b", "live at", "live in", "bootleg", "recording", "concert", "performance", "show", "festival")
DATES = ("\\d{4}-\\d{2}-\\d{2}", "\\d{2}/\\d{2}/\\d{4}", "\\d{1,2}\\.\\d{1,2}\\.\\d{4}")
PLACES = ("\\b\\d{4}\\s+-\\s+.+\\b", ",\\s*[A-Z]{2}$", ",\\s*[A-Za-z\\s]+$")
COMPILATION = ("greatest hits", "best of", "the best", "essential", "collection", "anthology", "gold", "platinum", "ultimate", "hits", "singles", "the very best")
RARITY = ("demo", "rare", "unreleased", "bonus", "extra", "special edition", "limited edition", "anniversary", "deluxe", "remastered", "expanded", "bootleg")
TOGETHER = (" with ", " and ", " & ", " featuring ", " feat ", "featuring ", "presents")
TOP_GENRES = (
    "rock pop electronic hiphop jazz classical country rnb soul reggae blues metal punk folk ambient soundtrack world gospel latin indie"
).split()
GENRE_SYNONYMS = {
    "r&b": "rnb",
    "rnb": "rnb",
    "hip-hop": "hiphop",
    "hip hop": "hiphop",
    "r and b": "rnb",
    "rb": "rnb",
    "electronica": "electronic",
    "edm": "electronic",
    "dance": "electronic",
    "classic rock": "rock",
    "heavy metal": "metal",
    "country & western": "country",
    "ost": "soundtrack",
    "soundtrack": "soundtrack",
    "film score": "soundtrack",
    "instrumental": "classical",
    "new age": "ambient",
}
GENRE_WORDS = {
    "electronic": ("remix", "dj", "club", "techno", "house", "trance", "edm"),
    "rock": ("rock", "metal", "punk", "grunge", "alternative"),
    "hiphop": ("hip", "hop", "rap", "trap"),
    "jazz": ("jazz", "swing", "fusion"),
    "classical": ("classical", "symphony", "orchestra", "concerto"),
    "country": ("country", "folk", "bluegrass"),
    "reggae": ("reggae", "dancehall"),
    "blues": ("blues",),
    "ambient": ("ambient", "chillout", "downtempo"),
    "soundtrack": ("soundtrack", "ost", "score"),
}
REMIX = ("remix", "mix", "edit", "version", "bootleg", "mashup", "flip", "refix", "rework")
PODCAST = ("podcast", "episode", "ep\\.\\s*\\d+", "pt\\.\\s*\\d+", "feat\\.", "interview", "season\\s+\\d+")
SPOKEN = ("spoken\\s*word", "audiobook", "book\\s*\\d+", "chapter\\s*\\d+", "narrat", "speech", "lecture", "standup?", "comedy")
SPOKEN_GENRES = ("speech", "spoken", "audiobook", "comedy", "lecture")
SOUNDTRACK = ("soundtrack", "\\bost\\b", "score", "original\\s*motion\\s*picture", "from\\s+the\\s+movie", "from\\s+the\\s+film")
#: Ranges of valence, energy, danceability and acousticness.
MOODS = {
    "happy": ((0.6, 1.0), (0.5, 1.0), (0.5, 1.0), None),
    "sad": ((0.0, 0.4), (0.0, 0.5), (0.0, 0.5), None),
    "energetic": ((0.4, 1.0), (0.7, 1.0), (0.6, 1.0), None),
    "calm": ((0.4, 0.8), (0.0, 0.4), (0.0, 0.4), None),
    "angry": ((0.0, 0.4), (0.6, 1.0), (0.3, 0.8), None),
    "relaxed": ((0.5, 1.0), (0.0, 0.4), None, (0.3, 1.0)),
    "melancholic": ((0.2, 0.5), (0.0, 0.5), None, (0.2, 1.0)),
    "uplifting": ((0.7, 1.0), (0.5, 1.0), (0.4, 1.0), None),
    "dark": ((0.0, 0.4), (0.3, 0.8), None, (0.0, 0.6)),
    "bright": ((0.6, 1.0), (0.3, 0.8), None, None),
}
MOOD_WORDS = {
    "happy": ("happy", "joy", "celebration", "upbeat", "fun", "party"),
    "sad": ("sad", "cry", "tears", "heartbreak", "lonely", "melancholy"),
    "energetic": ("energy", "power", "blast", "intense", "fierce"),
    "calm": ("calm", "peace", "serenity", "gentle", "quiet"),
    "angry": ("angry", "rage", "fury", "hate", "aggressive"),
    "relaxed": ("relax", "chill", "lounge", "mellow", "easy"),
    "melancholic": ("melanchol", "nostalgia", "wistful", "longing"),
    "uplifting": ("uplift", "inspire", "hope", "rise", "ascend"),
    "dark": ("dark", "gloomy", "bleak", "shadow", "nightmare"),
    "bright": ("bright", "light", "sunny", "radiant", "shine"),
}


def _low(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _points(steps: Iterable[tuple[Column, float]]) -> Column:
    """Sum, in order, of the points of the tests that hold; a null test doesn't."""
    return sum((F.when(test, points).otherwise(0.0) for test, points in steps), F.lit(0.0))


def _any(tests: Iterable[Column]) -> Column:
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


def _capped(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def content_scores(title: Column, album: Column, artist: Column, artists: Column, genre: Column, path: Column, location: Column) -> dict[str, Column]:
    """Scores from 0 to 1 of the content types live, collaboration, compilation and rarity."""
    t, a, who, g = map(_low, (title, album, artist, genre))
    whole = _low(path)
    file = F.regexp_extract(whole, "([^/]*)$", 1)
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda p: p != "")
    live = [(text.rlike(p), 0.3) if i < len(LIVE) else (text.rlike(p), 0.2) for text in (a, t, file) for i, p in enumerate((*LIVE, *DATES))]
    placed = F.aggregate(parts, F.lit(0.0), lambda total, part: total + F.when(_any(part.rlike(p) for p in PLACES), 0.2).otherwise(0.0))
    live_score = _points([*live, (location.isNotNull(), 0.4)]) + placed + _points([(g.contains("live"), 0.1)])

    names = F.filter(F.transform(F.split(who, ","), lambda n: F.trim(n)), lambda n: n != "")
    listed, several = F.size(names), F.size(F.coalesce(artists, F.array().cast("array<string>")))
    joint = _any(a.contains(p) for p in TOGETHER[:4])
    together = [
        ((listed == 2) & joint, 0.5),
        ((listed == 2) & ~joint & F.exists(names, lambda n: whole.contains(n)), 0.6),
        ((listed == 3) & ~a.rlike("trio|quartet|quintet"), 0.4),
        (several > 5, -0.2),
        (several == 2, 0.7),
        (several == 3, 0.5),
        (_any(a.contains(p) for p in TOGETHER), 0.4),
        (a.contains(" vs "), 0.5),
        (a.contains(" duets"), 0.3),
        (a.contains(" duo") | a.contains(" trio"), 0.3),
        (file.contains(" & ") | file.contains(" and "), 0.4),
        (who.contains("santana") & who.contains("mclaughlin"), 0.6),
        (a.contains(" love devotion surrender"), 0.6),
        (g.contains("jazz"), -0.2),
    ]
    best = [(text.rlike(f"\\b{p}\\b"), 0.4) for text in (a, t) for p in COMPILATION]
    best += [(who.isin("various artists", "va", "various"), 0.6), (who.contains("dj") & a.contains("mix"), 0.3)]
    rare = [(text.rlike(f"\\b{p}\\b"), 0.3) for text in (a, t) for p in RARITY]
    rare += [(a.rlike("\\(\\d+(?:st|nd|rd|th)\\s+anniversary\\)"), 0.5), (a.rlike("\\[(?:remastered|deluxe|expanded|bonus)\\]"), 0.4)]
    rare += [(whole.rlike(f"\\b{p}\\b"), 0.2) for p in RARITY]
    return {"live": _capped(live_score), "collaboration": _capped(_points(together)), "compilation": _capped(_points(best)), "rarity": _capped(_points(rare))}


def content_type(scores: dict[str, Column]) -> Column:
    """Struct of kind and score: the first of collaboration, live, compilation and rarity that is sure enough, else studio."""
    gates = (("collaboration", 0.6), ("live", 0.5), ("compilation", 0.6), ("rarity", 0.6))
    out = F.struct(F.lit("studio").alias("kind"), F.lit(0.5).alias("score"))
    for kind, gate in reversed(gates):
        out = F.when(scores[kind] > gate, F.struct(F.lit(kind).alias("kind"), scores[kind].alias("score"))).otherwise(out)
    return out


def is_ambiguous(kind: Column, score: Column, title: Column, album: Column, artists: Column) -> Column:
    """Whether indicators of several content types, a score below 0.6 or "greatest hits" ask for a second look."""
    text = F.concat(_low(album), F.lit(" "), _low(title))
    signs = [_any(text.rlike(p) for p in LIVE), _any(text.rlike(f"\\b{p}\\b") for p in COMPILATION), _any(text.rlike(f"\\b{p}\\b") for p in RARITY)]
    shown = sum((s.cast("int") for s in signs), F.lit(0))
    plain = (kind == "studio") & (score == 0.5) & (shown <= 1)
    several = (F.size(F.coalesce(artists, F.array().cast("array<string>"))) > 1).cast("int")
    return ~plain & (((score < 0.6) & (score != 0.5)) | (shown + several > 1) | _low(album).contains("greatest hits"))


def normal_genre(genre: Column) -> Column:
    """One of TOP_GENRES: by synonym, by name, or the first that contains it or that it contains; else null."""
    g = F.trim(F.lower(genre))
    out = F.lit(None).cast("string")
    for top in reversed(TOP_GENRES):
        out = F.when(g.contains(top) | F.lit(top).contains(g), F.lit(top)).otherwise(out)
    out = F.when(g.isin(*TOP_GENRES), g).otherwise(out)
    for spelling, name in GENRE_SYNONYMS.items():
        out = F.when(g == spelling, F.lit(name)).otherwise(out)
    return F.when(g != "", out)


def genres_of(title: Column, album: Column, artist: Column, genre: Column) -> Column:
    """Struct of genres (sorted) and confidence, from the tag and from words of the texts."""
    text = F.lower(F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in (title, album, artist)]))
    # one search for all words of a genre, which also lets Spark make the text once
    words = [F.when(text.rlike(f"\\b(?:{'|'.join(own)})\\b"), F.lit(name)) for name, own in GENRE_WORDS.items()]
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(normal_genre(genre), *words))))
    tagged = F.coalesce(genre != "", F.lit(False))
    sure = F.when(F.size(found) == 0, 0.0).when(F.size(found) > 1, 0.5).when(tagged, 0.8).otherwise(0.6)
    return F.struct(found.alias("genres"), sure.alias("confidence"))


def extended_type(title: Column, album: Column, artist: Column, genre: Column, seconds: Column) -> Column:
    """Struct of kind and score: the first of remix, podcast, spoken_word and soundtrack with 0.5 points, else null and 0."""
    t, a, who, g = map(_low, (title, album, artist, genre))
    remix = [step for p in REMIX for step in ((t.rlike(f"\\b{p}\\b"), 0.3), (a.rlike(f"\\b{p}\\b"), 0.2))]
    remix += [(who.rlike("\\bdj\\s"), 0.2), (g.contains("electronic") | g.contains("edm"), 0.1)]
    podcast = [(t.rlike(p), 0.25) for p in PODCAST]
    podcast += [(a.contains("podcast"), 0.3), (g.contains("podcast"), 0.4), (seconds > 900, 0.2)]
    spoken = [step for p in SPOKEN for step in ((t.rlike(p), 0.3), (a.rlike(p), 0.3))]
    spoken += [(_any(g.contains(x) for x in SPOKEN_GENRES), 0.4), (who.contains("author") | who.contains("narrator"), 0.2)]
    screen = [step for p in SOUNDTRACK for step in ((a.rlike(p), 0.35), (t.rlike(p), 0.2))]
    screen += [(_any(g.contains(x) for x in ("soundtrack", "score", "ost")), 0.3), (who.contains("composer") | who.contains("conductor"), 0.15)]
    out = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(0.0).alias("score"))
    for kind, steps in reversed((("remix", remix), ("podcast", podcast), ("spoken_word", spoken), ("soundtrack", screen))):
        points = _points(steps)
        out = F.when(points >= 0.5, F.struct(F.lit(kind).alias("kind"), F.least(F.lit(1.0), points).alias("score"))).otherwise(out)
    return out


def _ranked(scores: list[tuple[str, Column]]) -> Column:
    """(mood, score) of the moods with a score, best first, the earlier of the table among equals."""
    rows = [F.when(s.isNotNull(), F.struct((-s).alias("minus"), F.lit(i).alias("at"), F.lit(m).alias("mood"))) for i, (m, s) in enumerate(scores)]
    return F.transform(F.array_sort(F.array_compact(F.array(*rows))), lambda r: F.struct(r["mood"].alias("mood"), (-r["minus"]).alias("score")))


def moods_of_features(valence: Column, energy: Column, danceability: Column, acousticness: Column) -> Column:
    """The three moods, best first, whose ranges the features are nearest the middle of; `unknown` if none is near or
    valence or energy is missing. An array of (mood, score)."""
    scores = []
    for mood, ranges in MOODS.items():
        points, weights = F.lit(0.0), F.lit(0.0)
        for value, weight, bounds in zip((valence, energy, danceability, acousticness), (2.0, 2.0, 1.0, 1.0), ranges, strict=True):
            if bounds:
                low, high = bounds
                inside = value.between(low, high)
                apart = F.abs(value - (low + high) / 2) / ((high - low) / 2 + 0.01)
                points = points + F.when(inside, weight * (1.0 - F.least(apart, F.lit(1.0)))).otherwise(0.0)
                weights = weights + F.when(inside, weight).otherwise(0.0)
        scores.append((mood, F.when(weights > 0, points / weights)))
    ranked = _ranked(scores)
    unknown = F.array(F.struct(F.lit("unknown").alias("mood"), F.lit(1.0).alias("score")))
    near = F.coalesce(F.get(ranked, F.lit(0))["score"] >= 0.3, F.lit(False)) & valence.isNotNull() & energy.isNotNull()
    return F.when(near, F.transform(F.slice(ranked, 1, 3), lambda r: F.struct(r["mood"].alias("mood"), F.greatest(r["score"], F.lit(0.1)).alias("score")))).otherwise(unknown)


def moods_of_text(text: Column) -> Column:
    """Moods of which the text has keywords, half a point for each, at most one; `unknown` without any."""
    low = _low(text)
    counts = [(m, sum((low.contains(w).cast("int") for w in words), F.lit(0))) for m, words in MOOD_WORDS.items()]
    ranked = _ranked([(m, F.when(n > 0, F.least(n * 0.5, F.lit(1.0)))) for m, n in counts])
    return F.when(F.size(ranked) > 0, ranked).otherwise(F.array(F.struct(F.lit("unknown").alias("mood"), F.lit(1.0).alias("score"))))


def mood_quadrant(valence: Column, energy: Column) -> Column:
    high = energy > 0.5
    return F.when(valence > 0.5, F.when(high, "happy").otherwise("relaxed")).otherwise(F.when(high, "angry").otherwise("sad"))


def energy_level(energy: Column) -> Column:
    out = F.when(energy.isNull(), "medium").when(energy < 0.2, "very_low").when(energy < 0.4, "low")
    return out.when(energy < 0.6, "medium").when(energy < 0.8, "high").otherwise("very_high")


def energy_of_genre(genre: Column) -> Column:
    g = _low(genre)
    return F.when(g.rlike("rock|metal|electronic|dance"), 0.8).when(g.rlike("ambient|classical|folk"), 0.3).otherwise(0.5)


# Patterns for several types at once, and types by what a tag contains, the first that it does.
ALL_REMIX = ("\\bremix\\b", "\\bmix\\b", "\\bedit\\b", "\\bversion\\b", "\\bbootleg\\b", "\\bmashup\\b", "\\bflip\\b", "\\brefix\\b", "\\brework\\b", "\\b\\d+\\s*remix\\b")
ALL_PODCAST = ("\\bpodcast\\b", "\\bepisode\\b", "\\bep\\.?\\s*\\d+\\b", "\\bpt\\.?\\s*\\d+\\b", "\\bfeat\\.?\\b", "\\binterview\\b", "\\bseason\\s+\\d+\\b")
ALL_SPOKEN = tuple(
    f"\\b{p}\\b" for p in ("spoken\\s*word", "audiobook", "book\\s*\\d+", "chapter\\s*\\d+", "narrated?", "speech", "lecture", "standup?", "comedy")
)
ALL_SCREEN = tuple(
    f"\\b{p}\\b"
    for p in ("soundtrack", "ost", "score", "original\\s*motion\\s*picture", "from\\s+the\\s+movie", "from\\s+the\\s+film", "games?\\s+soundtrack", "anime\\s+soundtrack", "tv\\s+soundtrack")
)
COMPOSERS = ("\\bcomposed\\s+by\\b", "\\bscore\\s+by\\b", "\\borchestrated?\\b")
TAG_KINDS = {
    "remix": "remix",
    "podcast": "podcast",
    "spoken_word": "spoken_word",
    "spoken-word": "spoken_word",
    "spoken word": "spoken_word",
    "audiobook": "audiobook",
    "soundtrack": "soundtrack",
    "ost": "soundtrack",
    "score": "soundtrack",
    "dj_mix": "dj_mix",
    "dj-mix": "dj_mix",
    "dj mix": "dj_mix",
    "live": "live_recording",
    "compilation": "compilation",
    "studio": "studio_album",
    "ep": "ep",
    "single": "single",
    "demo": "demo",
    "cover": "cover",
}
TAG_SURE, RULES_SURE, UNSURE = 0.9, 0.8, 0.5


def all_types(title: Column, album: Column, artist: Column, genre: Column, seconds: Column, tagged: Column | None = None) -> Column:
    """Array of (kind, score), best first, of every type that a track shows: what `tagged` contains, and remix, podcast,
    spoken_word and soundtrack by their points, each less sure than a tag; one row "unknown" if there is none. Of equal
    scores the tag's comes first, then the order above. Null texts count as empty."""
    t, a, who, g = map(_low, (title, album, artist, genre))
    hint, hint_text = F.lit(None).cast("string"), _low(tagged if tagged is not None else F.lit(None))
    for part, kind in reversed(TAG_KINDS.items()):
        hint = F.when(hint_text.contains(part), kind).otherwise(hint)
    points = {
        "remix": [(t.rlike(p), 0.3) for p in ALL_REMIX] + [(a.rlike(p), 0.2) for p in ALL_REMIX] + [(who.rlike("\\bdj\\s+\\w"), 0.4), (_any(g.contains(x) for x in ("electronic", "edm", "dance")), 0.1)],
        "podcast": [(t.rlike(p), 0.25) for p in ALL_PODCAST] + [(a.contains("podcast"), 0.3), (g.contains("podcast"), 0.4), (seconds > 900, 0.2)],
        "spoken_word": [(x.rlike(p), 0.3) for x in (t, a) for p in ALL_SPOKEN] + [(_any(g.contains(x) for x in SPOKEN_GENRES), 0.4), (who.contains("author") | who.contains("narrator"), 0.2)],
        "soundtrack": [(a.rlike(p), 0.35) for p in ALL_SCREEN]
        + [(t.rlike(p), 0.2) for p in ALL_SCREEN]
        + [(_any(g.contains(x) for x in ("soundtrack", "score", "ost")), 0.3)]
        + [(who.rlike(p), 0.2) for p in COMPOSERS]
        + [(who.contains("composer") | who.contains("conductor"), 0.15)],
    }

    def row(place: int, kind: Column, score: Column) -> Column:
        return F.struct((-score).alias("minus"), F.lit(place).alias("place"), kind.alias("kind"))

    def by_points(place: int, kind: str) -> Column:
        mine = ~F.coalesce(hint == kind, F.lit(False))
        score = F.array(_capped(_points(points[kind])) * RULES_SURE)
        return F.transform(score, lambda s: F.when((s > 0) & mine, row(place, F.lit(kind), s)))[0]

    rows = [F.when(hint.isNotNull(), row(0, hint, F.lit(TAG_SURE))), *[by_points(i, kind) for i, kind in enumerate(points, 1)]]
    found = F.transform(F.array_sort(F.array_compact(F.array(*rows))), lambda r: F.struct(r["kind"].alias("kind"), (-r["minus"]).alias("score")))
    unknown = F.array(F.struct(F.lit("unknown").alias("kind"), F.lit(UNSURE).alias("score")))
    return F.transform(F.array(found), lambda f: F.when(F.size(f) > 0, f).otherwise(unknown))[0]
