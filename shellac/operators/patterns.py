"""Target paths from patterns of folders and files by level, and whole plans by rules. No file is moved."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellac.functions import tags
from shellac.operators import layout

#: Folders of each level; a custom one has its own.
LEVELS = {"flat": "", "artist": "{artist}/{album}", "genre": "{genre}/{artist}/{album}", "year": "{year}/{artist}/{album}", "decade": "{decade}/{artist}/{album}"}
FILE, FLAT_FILE = "{track_number} {title}{file_extension}", "{artist} - {title}{file_extension}"
REQUIRED = ("artist", "title")
LONGEST = 255
_PART = re.compile(r"\{if:(\w+)\}(.*?)\{endif\}", re.S)
_NAME = re.compile(r"\{(\w+)\}")


@dataclass(frozen=True)
class Pattern:
    """Folders by level, or `folders` of one's own with custom, and a file name, of which flat and other levels have one. {name} puts a value, {if:name}...{endif} a
    part for rows that have it; other braces stay. Spaces become `space`. Without `nested`, all folders are one."""

    level: str = "artist"
    folders: str = ""
    file: str = ""
    space: str = "_"
    nested: bool = True

    def __post_init__(self) -> None:
        if self.level not in LEVELS and self.level != "custom":
            raise ValueError(f"unknown level: {self.level}")
        for name in REQUIRED:
            if name not in self.path + self.name:
                raise ValueError(f"pattern without {name}")

    @property
    def path(self) -> str:
        return LEVELS.get(self.level, self.folders)

    @property
    def name(self) -> str:
        return self.file or (FLAT_FILE if self.level == "flat" else FILE)


@dataclass(frozen=True)
class PathRule:
    """A rule for tracks whose genre or artists contain one of the words, whose year is in the range, and whose file is of one
    of the types. What a track doesn't have isn't held against it, but for the type."""

    name: str
    pattern: Pattern
    priority: int = 0
    genres: tuple[str, ...] = ()
    artists: tuple[str, ...] = ()
    years: tuple[int, int] | None = None
    types: tuple[str, ...] = field(default=())
    enabled: bool = True


def values_of() -> dict[str, Column]:
    """What patterns can name, of the columns of the `tracks` view; missing values are empty texts."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    artist = F.get(tags.split_artists(F.col("artists_raw")), F.lit(0))
    base = F.substring_index("path", "/", -1)
    dot = F.length(base) - F.length(F.substring_index(base, ".", -1))  # where the last one is; names that begin with it have no suffix
    suffix = F.when(dot < 2, "").otherwise(F.substr(base, dot))
    return {
        "artist": F.coalesce(artist, F.lit("Unknown Artist")), "albumartist": text(F.col("primary_artist")), "album": text(F.col("album")),
        "title": text(F.col("title")), "year": text(F.col("year")), "decade": text(tags.decade(F.col("year"))), "genre": text(F.col("genre")),
        "track_number": F.coalesce(tags.padded_track(F.col("track_number")), F.lit("")), "disc_number": text(F.col("disc_number")), "file_extension": suffix,
    }


def _filled(pattern: str, values: dict[str, Column]) -> Column:
    """A pattern with its values; slashes in values become underscores, so that only the pattern's own part folders."""

    def plain(piece: str) -> list[Column]:
        out, at = [], 0
        for mark in _NAME.finditer(piece):
            if mark[1] in values:
                out += [F.lit(piece[at : mark.start()]), F.translate(values[mark[1]], "/", "_")]
                at = mark.end()
        return [*out, F.lit(piece[at:])]

    parts, at = [], 0
    for mark in _PART.finditer(pattern):
        parts += plain(pattern[at : mark.start()])
        parts.append(F.when(F.trim(values.get(mark[1], F.lit(""))) != "", F.concat(*plain(mark[2]))).otherwise(""))
        at = mark.end()
    return F.concat(*parts, *plain(pattern[at:]))


def _clean(part: Column, space: str) -> Column:
    """A folder or file name: forbidden characters dropped, slashes and runs of separators one underscore, none at the ends."""
    bare = F.replace(F.translate(part, "/<>:\"|?*", "_"), F.lit(" "), F.lit(space))
    full = F.regexp_replace(F.regexp_replace(bare, "[_-]+", "_"), "^[_-]+|[_-]+$", "")
    if space == " ":
        return F.when(part.rlike("[/<>:\"|?*_-]"), full).otherwise(part)
    if space != "_":
        return full
    # most names have single spaces inside only
    return F.when(part.rlike("[/<>:\"|?*_-]|  |^ | $"), full).otherwise(F.replace(part, F.lit(" "), F.lit(space)))


def _short(name: Column) -> Column:
    """At most LONGEST letters, the suffix kept."""
    suffix = F.regexp_extract(name, "[^.](\\.[^.]*)$", 1)
    room = F.lit(LONGEST) - F.length(suffix)
    cut = F.when(room > 0, F.concat(F.left(name, room), suffix)).otherwise(F.left(name, F.lit(LONGEST)))
    return F.when(F.length(name) > LONGEST, cut).otherwise(name)


def _folders(path: str) -> list[str]:
    """A pattern's folders, parts with conditions kept whole."""
    marks = [m.span() for m in _PART.finditer(path)]
    cuts = [i for i, c in enumerate(path) if c == "/" and not any(a <= i < b for a, b in marks)]
    return [path[a:b] for a, b in zip([0, *[i + 1 for i in cuts]], [*cuts, len(path)], strict=True)]


def pattern_path(pattern: Pattern, values: dict[str, Column]) -> Column:
    """The path of each row by a pattern, folders without a name left out."""
    name = _short(_clean(_filled(pattern.name, values), pattern.space))
    if pattern.nested and not any("/" in mark[2] for mark in _PART.finditer(pattern.path)):
        # values have no slashes, so the pattern's own part the folders
        parts = [_clean(_filled(p, values), pattern.space) for p in _folders(pattern.path)]
        return F.concat_ws("/", *[F.nullif(p, F.lit("")) for p in [*parts, name]])
    folders = _filled(pattern.path, values)
    parts = F.transform(F.split(folders, "/") if pattern.nested else F.array(folders), lambda p: _clean(p, pattern.space))
    return F.array_join(F.filter(F.concat(parts, F.array(name)), lambda p: p != ""), "/")


def _fits(rule: PathRule) -> Column:
    out = F.lit(rule.enabled)
    any_of = lambda text, words: F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(F.lower(text), w))
    for column, words in (("genre", rule.genres), ("artists_raw", rule.artists)):
        if words:
            out = out & (~tags.given(F.col(column)) | any_of(F.col(column), words))
    if rule.years:
        out = out & (F.col("year").isNull() | F.col("year").between(*rule.years))
    if rule.types:
        out = out & F.lower("file_type").isin(*rule.types)
    return F.coalesce(out, F.lit(False))


def routed(tracks: DataFrame, rules: list[PathRule], root: str = "", keep: tuple[str, ...] = ()) -> DataFrame:
    """(recording_id, source, target, rule) and the columns in `keep`: where each track wants to go by the rule of highest priority that fits
    it, of equals the first in the list; tracks without one are left out."""
    ordered = sorted(rules, key=lambda r: -r.priority)
    values = values_of()
    found = [F.when(_fits(r), F.struct(F.lit(r.name).alias("rule"), F.concat(F.lit(root), pattern_path(r.pattern, values)).alias("target"))) for r in ordered]
    # as a row of its own, so that a route is found once, not for each use
    return tracks.select("recording_id", F.col("path").alias("source"), *keep, F.inline(F.array(F.coalesce(*found)))).filter("rule IS NOT NULL")


def planned(routes: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(recording_id, source, target, rule, conflict, action, final) of routes as `routed` gives them: see plan_organization."""
    plan = layout.plan_moves(routes, existing, ("source", "rule"))
    action = F.when(F.col("conflict"), "resolve").otherwise("move")
    return plan.select("recording_id", "source", "target", "rule", "conflict", action.alias("action"), "final")


def plan_organization(tracks: DataFrame, rules: list[PathRule], existing: DataFrame | None = None, root: str = "") -> DataFrame:
    """(recording_id, source, target, rule, conflict, action, final): where each track goes (see routed).

    A target conflicts if a file is there (`existing` has target) or an earlier row wants it; then action is `resolve` and
    final a free name (see layout.plan_moves), else `move` and the target."""
    return planned(routed(tracks, rules, root), existing)
