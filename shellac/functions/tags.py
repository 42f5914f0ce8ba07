"""Column functions that normalise tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of genres and their standard form.
GENRES = {"rock & roll": "Rock", "r&b": "R&B", "hip-hop": "Hip Hop", "electronica": "Electronic", "new age": "New Age"}


def split_artists(raw: Column) -> Column:
    """Comma-separated artists, trimmed, without empty and repeated ones, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(raw, ","), lambda a: F.trim(a)), lambda a: a != ""))


def clean_artist(name: Column) -> Column:
    """Without a leading The; feat., featuring and ft. as one form."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, "^(?i:the) ", ""), " (?i:featuring|feat\\.?|ft\\.?) ", " feat. "))


def clean_title(title: Column) -> Column:
    """One space between words; years in square brackets as in round ones."""
    return F.trim(F.regexp_replace(F.regexp_replace(title, "\\s+", " "), "\\[(\\d{4})\\]", "($1)"))


def standard_genre(genre: Column) -> Column:
    """Standard spelling, else words with capitals and single spaces."""
    key = F.lower(genre)
    known = F.lit(None).cast("string")
    for spelling, standard in GENRES.items():
        known = F.when(key == spelling, F.lit(standard)).otherwise(known)
    return F.coalesce(known, F.initcap(F.trim(F.regexp_replace(genre, "\\s+", " "))))


def sort_name(name: Column) -> Column:
    """Articles at the end; a name of the article alone or twice stays."""
    article, rest = F.regexp_extract(name, "^(The|A|An) (.+)$", 1), F.regexp_extract(name, "^(The|A|An) (.+)$", 2)
    return F.when((article != "") & (F.lower(rest) != F.lower(article)), F.concat(rest, F.lit(", "), article)).otherwise(name)


def first_letter(name: Column) -> Column:
    letter = F.upper(F.substring(sort_name(name), 1, 1))
    return F.when(letter.rlike("[A-Z]"), letter).otherwise("#")


def decade(year: Column) -> Column:
    return F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s"))


def bitrate_band(bitrate: Column) -> Column:
    out = F.when(bitrate.isNull(), "unknown").when(bitrate >= 320, "320+").when(bitrate >= 256, "256-319")
    return out.when(bitrate >= 192, "192-255").when(bitrate >= 128, "128-191").otherwise("below 128")


def identity_key(artist: Column, title: Column, album: Column, track: Column) -> Column:
    """MD5 of the lower-cased tags with single spaces, and the track number or 0: equal for copies of a recording."""
    parts = [F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "(?U)\\s+", " ")) for c in (artist, title, album)]
    return F.md5(F.concat_ws("|", *parts, F.coalesce(track, F.lit(0)).cast("string")))


def completeness(columns: list[Column]) -> Column:
    """Share of six core fields and, at half weight, three more that are set."""
    given = [F.coalesce((c.cast("string") != "").cast("int"), F.lit(0)) for c in columns]
    core, bonus = sum(given[:6], F.lit(0)), sum(given[6:9], F.lit(0))
    return (core + 0.5 * bonus) / 7.5


def word_jaccard(a: Column, b: Column) -> Column:
    """Overlap of the word sets; two empty texts are equal."""
    x, y = (F.array_distinct(F.filter(F.split(F.lower(c), " "), lambda w: w != "")) for c in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def parse_artists(text: Column) -> Column:
    """Artists of a credit, split at the first kind of separator that it has; the first one is the main artist."""
    out = F.array(F.trim(text))
    for separator in reversed((" feat\\. ", " featuring ", " with ", " & ", " x ", " and ")):
        split = F.transform(F.split(text, f"(?i){separator}"), lambda a: F.trim(a))
        out = F.when(text.rlike(f"(?i){separator}"), split).otherwise(out)
    return out


def parse_track_number(text: Column) -> Column:
    """The first run of digits ("5", "5/12", "Track 5"); null without one."""
    return F.regexp_extract(text, "(\\d+)", 1).try_cast("int")


def padded_track(number: Column) -> Column:
    return F.lpad(number.cast("string"), 2, "0")


def extract_year(text: Column) -> Column:
    """Four leading digits, else the first year of the last or this century; null without either."""
    found = (F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")) for pattern in ("^(\\d{4})", "((?:19|20)\\d{2})"))
    return F.coalesce(*found).cast("int")


def clock(seconds: Column) -> Column:
    """MM:SS, without hours."""
    whole = F.floor(seconds).cast("long")
    minutes = F.floor(whole / 60).cast("string")
    return F.concat(F.when(F.length(minutes) < 2, F.lpad(minutes, 2, "0")).otherwise(minutes), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def given(value: Column) -> Column:
    """Neither null nor blank."""
    return F.coalesce(F.trim(value.cast("string")) != "", F.lit(False))


def metadata_errors(title: Column, artist: Column, year: Column, track: Column, last_year: int) -> Column:
    """Names of the rules that the tags break, in order; `last_year` is the latest year allowed."""
    checks = {
        "title required": ~given(title),
        "artist required": ~given(artist),
        "year out of range": (year < 1900) | (year > last_year),
        "negative track": track < 0,
    }
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in checks.items()]))


def genre_mood(genre: Column, moods: dict[str, str]) -> Column:
    """The mood that a genre stands for in the table, whatever its case; null for others."""
    cells = [F.lit(x) for pair in moods.items() for x in pair]
    return F.element_at(F.create_map(*cells), F.lower(F.trim(genre)))
