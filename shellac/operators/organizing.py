"""Plans for whole releases, conflicts by strategy, covers, layouts, and what a plan costs and is worth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellac.functions import tags
from shellac.tables import written

MEGABYTE = 1 << 20


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def identical_to_target(plan: DataFrame, files: DataFrame | None, existing: DataFrame) -> DataFrame:
    """`plan` with `identical`: whether the file to be moved is the one that is at its target already: of the same size,
    and of the same checksum if both have one, else changed within a second of it. `files` has recording_id, and
    `existing` target, and both size, mtime and checksum; without `files` the plan has these of its files itself."""
    facts = ("size", "mtime", "checksum")
    if files is None:
        mine = plan.withColumns({f"own_{c}": F.col(c) for c in facts})
    else:
        mine = plan.join(files.select("recording_id", *[F.col(c).alias(f"own_{c}") for c in facts]), "recording_id", "left")
    there = existing.select("target", *[F.col(c).alias(f"there_{c}") for c in facts])
    seconds = F.abs(F.col("own_mtime").cast("timestamp").cast("double") - F.col("there_mtime").cast("timestamp").cast("double"))
    summed = tags.given(F.col("own_checksum")) & tags.given(F.col("there_checksum"))
    same = (F.col("own_size") == F.col("there_size")) & F.when(summed, F.col("own_checksum") == F.col("there_checksum")).otherwise(seconds < 1)
    joined = mine.join(there, "target", "left")
    return joined.select(*[F.col(f"`{c}`") for c in plan.columns], F.coalesce(same, F.lit(False)).alias("identical"))


def resolve_conflicts(plan: DataFrame, stamp: str) -> DataFrame:
    """`plan` (see layout.plan_moves, and a column strategy) with `action` and `final`: rows with a conflict are skipped
    (final is null), replace the file, take the plan's numbered name, go to a folder of duplicates (keep_both) or get
    `stamp` behind their name (append_suffix, also for unknown and null strategies). Where the plan says that a file is
    `identical` to what is there, it is left alone whatever the strategy."""
    where, name = directory(F.col("target")), F.regexp_extract("target", "([^/]*)$", 1)
    stem, suffix = F.regexp_extract("target", "^(.*?)(\\.[^./]*)?$", 1), F.regexp_extract("target", "(\\.[^./]*)$", 1)
    strategy = F.coalesce(F.when(F.col("strategy").isin("skip", "replace", "rename", "keep_both"), F.col("strategy")), F.lit("append_suffix"))
    if "identical" in plan.columns:
        strategy = F.when(F.col("identical"), "identical").otherwise(strategy)
    final = F.when(strategy == "replace", F.col("target")).when(strategy == "rename", F.col("final"))
    final = final.when(strategy == "keep_both", F.concat(where, F.lit("/duplicates/"), name))
    final = final.when(strategy == "append_suffix", F.concat(stem, F.lit(f"_{stamp}"), suffix))
    action = F.when(F.col("conflict"), strategy).otherwise("move")
    return plan.select("recording_id", "target", action.alias("action"), F.when(F.col("conflict"), final).otherwise(F.col("target")).alias("final"))


def plan_by_release(tracks: DataFrame, folder: Column) -> DataFrame:
    """(recording_id, target): all tracks of a release take the folder of its first one in order of arrival, each with
    its number and title. The first is a partial aggregate joined back, so a large release is no single task; what both
    sides need is written, so `tracks` are read once."""
    release, place = ("primary_artist", "album"), ("ord1", "ord2", "recording_id")
    number = F.coalesce(F.concat(tags.padded_track(F.col("track_number")), F.lit(" ")), F.lit(""))
    name = F.concat(F.lit("/"), number, F.col("title"), F.lit("."), F.col("file_type"))
    rows = written(tracks.select(*release, *place, folder.alias("folder"), name.alias("name")))
    first = rows.groupBy(*release).agg(F.min_by("folder", F.struct(*place)).alias("folder"))
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"f.{c}")) for c in release]
    return rows.drop("folder").alias("t").join(first.alias("f"), same).select("recording_id", F.concat("folder", "name").alias("target"))


def attach_cover(tracks: DataFrame, images: DataFrame) -> DataFrame:
    """(recording_id, cover): the best image (column path) in the track's directory, by name: cover, front, folder,
    album, then any jpg, jpeg and png; the least path among equals, null without one."""
    name = F.lower(F.regexp_extract("path", "([^/]*)$", 1))
    rank = F.when(name.endswith(".jpg"), 4).when(name.endswith(".jpeg"), 5).otherwise(6)
    for place, word in reversed(list(enumerate(("cover", "front", "folder", "album")))):
        rank = F.when(name.contains(word), place).otherwise(rank)
    usable = images.filter(name.rlike("\\.(jpg|jpeg|png)$"))
    best = usable.groupBy(directory(F.col("path")).alias("folder")).agg(F.min_by("path", F.struct(rank, "path")).alias("cover"))
    placed = tracks.select("recording_id", directory(F.col("path")).alias("folder"))
    return placed.join(best, "folder", "left").select("recording_id", "cover")


def group_by_directory(plan: DataFrame) -> DataFrame:
    """(directory, operations, bytes) of a plan with target and size_bytes."""
    found = plan.groupBy(directory(F.col("target")).alias("directory"))
    return found.agg(F.count(F.lit(1)).alias("operations"), F.sum("size_bytes").alias("bytes"))


def estimate_duration(files: DataFrame, workers: int = 4) -> DataFrame:
    """One row: files, bytes, and seconds at 50 MB a second for each worker and a tenth of a second for each file."""
    n, size = F.count(F.lit(1)), F.coalesce(F.sum("size_bytes"), F.lit(0))
    return files.agg(n.alias("files"), size.alias("bytes"), F.round(size / (50 * MEGABYTE * workers) + 0.1 * n, 6).alias("seconds"))


def preview_stats(plan: DataFrame) -> DataFrame:
    """One row for a plan (target, conflict, size_bytes, kind, artists, title, primary_artist, album): operations,
    megabytes, conflicts, content types, artists, share of complete tags, deepest folder, minutes (2, 5 or 10 seconds
    a file, by mean size) and a score of 0 to 100."""
    complete = tags.given(F.col("title")) & tags.given(F.col("primary_artist")) & tags.given(F.col("album"))
    # one read: a row for each artist of a file, of which the first counts the file, then a row for each artist and kind
    depth = F.size(F.split("target", "/")) - 1
    rows = plan.select("conflict", "size_bytes", "kind", complete.alias("complete"), depth.alias("depth"), F.posexplode_outer("artists").alias("place", "artist"))
    one = F.coalesce(F.col("place") == 0, F.lit(True))
    counts = rows.groupBy("artist", "kind").agg(
        F.count_if(one).alias("n"), F.sum(F.when(one, F.col("size_bytes"))).alias("bytes"), F.count_if(one & F.col("conflict")).alias("conflicts"),
        F.count_if(one & F.col("complete")).alias("complete"), F.max("depth").alias("depth"),
    )
    n = F.coalesce(F.sum("n"), F.lit(0))
    out = counts.agg(
        n.alias("operations"),
        F.round(F.coalesce(F.sum("bytes"), F.lit(0)) / MEGABYTE, 6).alias("megabytes"),
        F.coalesce(F.sum("conflicts"), F.lit(0)).alias("conflicts"),
        F.count_distinct("kind").alias("kinds"),
        F.round(F.when(n > 0, F.sum("complete") / n).otherwise(0.0), 6).alias("completeness"),
        F.coalesce(F.max("depth"), F.lit(0)).alias("depth"),
        F.count_distinct("artist").alias("artists"),
    )
    n, mean = F.col("operations"), F.col("megabytes") / F.greatest(F.col("operations"), F.lit(1))
    minutes = n * F.when(mean < 10, 2).when(mean < 50, 5).otherwise(10) / 60
    depth = F.when(F.col("depth").between(2, 4), 20).when(F.col("depth").between(1, 5), 10).otherwise(0)
    kinds = F.when(F.col("kinds") > 1, 20).when(F.col("kinds") == 1, 10).otherwise(0)
    artists = F.when(F.col("artists") > 10, 10).when(F.col("artists") > 5, 5).otherwise(0)
    smooth = F.when(n > 0, (1 - F.col("conflicts") / n) * 20).otherwise(0.0)
    score = F.round(F.least(F.lit(100.0), F.col("completeness") * 30 + smooth + depth + kinds + artists), 6)
    return out.withColumns({"minutes": F.round(minutes, 6), "score": score})


def validate_layout(files: DataFrame, required: tuple[str, ...], media: tuple[str, ...] = ("mp3", "flac", "m4a", "wav", "ogg", "wma")) -> DataFrame:
    """(problem, path) of absolute paths: top folders that are `missing`, directories without others inside and without
    a media file (`no_media`), media files at the top (`in_root`)."""
    is_media = F.lower(F.regexp_extract("path", "\\.([^./]*)$", 1)).isin(*media)
    parts = F.split(F.regexp_replace("path", "^/", ""), "/")
    # files go into a row for each directory, or for each at the top; these are written, and all else is found from them
    deep = F.size(parts) > 1
    placed = files.select(deep.alias("deep"), F.when(deep, directory(F.col("path"))).otherwise(F.col("path")).alias("path"), is_media.alias("media"))
    placed = written(placed.groupBy("deep", "path").agg(F.bool_or("media").alias("media")))
    inside = placed.filter("deep").select("path", "media")
    tops = inside.select(parts[0].alias("path")).distinct()
    wanted = files.sparkSession.createDataFrame([(r,) for r in required], "path string")
    missing = wanted.join(tops, "path", "left_anti").select(F.lit("missing").alias("problem"), "path")
    levels = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(levels) - 1), lambda n: F.array_join(F.slice(levels, F.lit(1), n), "/"))
    parents = inside.filter(F.size(levels) > 1).select(F.explode(above).alias("path")).distinct()
    bare = inside.filter("NOT media").join(parents, "path", "left_anti").select(F.lit("no_media").alias("problem"), "path")
    loose = placed.filter("NOT deep AND media").select(F.lit("in_root").alias("problem"), "path")
    return missing.unionByName(bare).unionByName(loose)
