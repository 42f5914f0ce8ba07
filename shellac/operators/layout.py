"""Target paths from templates, plans of moves with their conflicts, and directory statistics. No file is moved."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_MARK = re.compile(r"\{([^{}]+)\}")


def clean_part(text: Column) -> Column:
    """Text as part of a path: separators and quotes replaced, forbidden and control characters dropped."""
    swapped = F.translate(F.regexp_replace(text, ":", " -"), "/\\|\"?*<>", "__-'")
    return F.trim(F.regexp_replace(swapped, "[\\x00-\\x1F\\s]+", " "))


def render_template(template: str, columns: dict[str, Column]) -> Column:
    """A template as one Column. {name} puts a value, cleaned, or nothing if it is null or unknown; {if:name} opens a
    part for rows that have the value, {else} its opposite, and {endif} closes it; parts don't nest."""
    out, condition, place = [], None, 0
    values = {name: F.coalesce(clean_part(value.cast("string")), F.lit("")) for name, value in columns.items()}

    def put(piece: Column) -> None:
        out.append(piece if condition is None else F.when(condition, piece).otherwise(""))

    for mark in _MARK.finditer(template):
        if mark.start() > place:
            put(F.lit(template[place : mark.start()]))
        name, place = mark.group(1), mark.end()
        if name.startswith("if:"):
            condition = values.get(name[3:], F.lit("")) != ""
        elif name == "else" and condition is not None:
            condition = ~condition
        elif name == "endif":
            condition = None
        elif name in values:
            put(values[name])
    if place < len(template):
        put(F.lit(template[place:]))
    return F.regexp_replace(F.concat(*out) if out else F.lit(""), "/{2,}", "/")


def artists_label(artists: Column, most: int = 3) -> Column:
    """Up to three artists by name, then et al."""
    names = F.array_join(F.slice(artists, 1, most), ", ")
    return F.when(F.size(artists) > most, F.concat(names, F.lit(" et al."))).otherwise(names)


def target_folder(kind: Column, artist: Column, artists: Column, album: Column, year: Column, date: Column, location: Column) -> Column:
    """Folder of a track by its content type; live tracks without a date are filed as studio albums."""
    in_year = F.when(year.isNotNull(), F.concat(F.lit(" ("), year.cast("string"), F.lit(")"))).otherwise("")
    who, name = F.coalesce(artist, F.lit("Unknown Artist")), F.coalesce(album, F.lit("Unknown Album"))
    live = F.concat(F.lit("Live/"), who, F.lit("/"), date, F.lit(" - "), F.coalesce(location, F.lit("Unknown Location")))
    out = F.when((kind == "live") & date.isNotNull(), live)
    out = out.when(kind == "collaboration", F.concat(F.lit("Collaborations/"), name, in_year, F.lit(" - "), artists_label(artists)))
    out = out.when(kind == "compilation", F.concat(F.lit("Compilations/"), who, F.lit("/"), name, in_year))
    out = out.when(kind == "rarity", F.concat(F.lit("Rarities/"), who, F.lit("/"), name))
    return out.otherwise(F.concat(F.lit("Albums/"), who, F.lit("/"), name, in_year))


def target_file(track: Column, title: Column, suffix: Column) -> Column:
    number = F.when(track.isNotNull(), F.concat(F.lpad(track.cast("string"), 2, "0"), F.lit(". "))).otherwise("")
    return F.concat(number, clean_part(title), F.lit("."), suffix)


def plan_moves(moves: DataFrame, existing: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(recording_id, target, conflict, final) of rows with recording_id and target: the least id takes a target that
    several want, unless a file is there (`existing` has target); the others get numbers in round brackets before the
    suffix, beyond all that targets and files of that name have already, so no two final names are equal. Columns in `keep` pass.

    Rows are read and shuffled once: a numbered name is also a row under the name without its number, and what is there and
    what is numbered comes before the moves of a target, which are counted in order."""
    stem, suffix = F.regexp_extract("target", "^(.*?)(\\.[^./]*)?$", 1), F.regexp_extract("target", "(\\.[^./]*)$", 1)
    number = F.regexp_extract(stem, "^(.*) \\((\\d{1,9})\\)$", 2).try_cast("int")
    bare = F.concat(F.regexp_extract(stem, "^(.*) \\(\\d{1,9}\\)$", 1), suffix)
    named = F.col("target").rlike(" \\(\\d{1,9}\\)")  # few names, which spares the others the search for a number

    def cell(target: Column, kind: int, number: Column) -> Column:
        return F.struct(target.alias("target"), F.lit(kind).alias("_kind"), number.cast("int").alias("_number"))

    def rows(df: DataFrame, kind: int, others: list[Column]) -> DataFrame:
        own, base = cell(F.col("target"), kind, F.lit(None)), cell(bare, 0, number)
        cells = F.when(named, F.filter(F.array(own, base), lambda c: (c["_kind"] == kind) | c["_number"].isNotNull())).otherwise(F.array(own))
        return df.select(*others, F.inline(cells))

    columns = ["recording_id", *keep]
    ranked = rows(moves, 2, [F.col(f"`{c}`") for c in columns])
    if existing is not None:
        types = dict(zip(moves.columns, moves.schema, strict=True))
        ranked = ranked.unionByName(rows(existing.select("target").filter("target IS NOT NULL"), 1, [F.lit(None).cast(types[c].dataType).alias(c) for c in columns]))
    upto = Window.partitionBy("target").orderBy("_kind", "recording_id").rowsBetween(Window.unboundedPreceding, 0)
    there, highest = F.max((F.col("_kind") == 1).cast("int")).over(upto), F.coalesce(F.max("_number").over(upto), F.lit(0))
    ranked = ranked.withColumns({"_behind": F.count(F.when(F.col("_kind") == 2, 1)).over(upto) - 1 + there, "_highest": highest}).filter("_kind = 2")
    final = F.concat(stem, F.lit(" ("), (F.col("_highest") + F.col("_behind")).cast("string"), F.lit(")"), suffix)
    final = F.when(F.col("_behind") > 0, final).otherwise(F.col("target"))
    return ranked.select("recording_id", "target", (F.col("_behind") > 0).alias("conflict"), final.alias("final"), *[f"`{c}`" for c in keep])


def directory_tree(files: DataFrame) -> DataFrame:
    """(directory, depth, files, bytes) of every directory and ancestor of the rows' paths."""
    parts = F.split(F.regexp_replace("path", "^/", ""), "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")))
    inside = files.filter(F.size(parts) > 1).select(F.explode(ancestors).alias("directory"), "size_bytes")
    found = inside.groupBy("directory").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))
    return found.withColumn("depth", F.size(F.split("directory", "/")) - 1)


def folder_patterns(files: DataFrame, k: int = 10) -> DataFrame:
    """The k directories two levels down with most files, by name among equals."""
    top = F.regexp_extract("path", "^(/[^/]+/[^/]+)/", 1).alias("folder")
    return files.groupBy(top).agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "folder").limit(k)


def playlist_lines(tracks: DataFrame) -> DataFrame:
    """(primary_artist, path, recording_id, line): the lines of each artist's extended playlist, in order of path, then
    id; its head has an empty path and id. A row per line, so that an artist of very many tracks is no single value."""
    line = F.concat(F.lit("#EXTINF:"), F.col("duration_seconds").cast("long"), F.lit(","), F.col("primary_artist"), F.lit(" - "), F.col("title"), F.lit("\n"), F.col("path"))
    heads = tracks.select("primary_artist").distinct().select("primary_artist", F.lit("").alias("path"), F.lit("").alias("recording_id"), F.lit("#EXTM3U").alias("line"))
    return heads.unionByName(tracks.select("primary_artist", "path", "recording_id", line.alias("line")))


def write_playlists(lines: DataFrame, folder: str) -> None:
    """A folder for each artist, its files in order of their names and lines; large playlists have several files."""
    ranged = lines.repartitionByRange("primary_artist", "path", "recording_id").sortWithinPartitions("primary_artist", "path", "recording_id")
    ranged.select("primary_artist", "line").write.partitionBy("primary_artist").text(folder)
