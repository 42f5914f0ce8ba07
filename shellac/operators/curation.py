"""Search, duplicates, change detection and log folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shellac.functions import tags
from shellac.tables import written

#: Rank of a format out of ten; others have 0.
FORMAT_RANK = {"flac": 10, "wav": 9, "aiff": 8, "alac": 7, "m4a": 6, "mp3": 5, "aac": 4, "ogg": 3, "opus": 3, "wma": 2}


def search(tracks: DataFrame, term: str, fields: tuple[str, ...] = ("title", "primary_artist", "album"), limit: int = 20) -> DataFrame:
    """Best matches of a term: 100 for each equal field, 10 for each that contains it; ties by recording_id."""
    term = term.lower()
    score = sum(
        (F.when(F.lower(f) == term, 100).when(F.lower(f).contains(term), 10).otherwise(0) for f in fields), F.lit(0)
    )
    found = tracks.select("recording_id", score.alias("score")).filter("score > 0")
    return found.orderBy(F.desc("score"), "recording_id").limit(limit)


def by_artist(tracks: DataFrame, name: str) -> DataFrame:
    """Tracks on which the artist appears, whatever the case."""
    artists = tags.split_artists(F.lower("artists_raw"))
    return tracks.filter(F.array_contains(artists, name.lower())).select("recording_id", "title")


def duplicates_by_tags(tracks: DataFrame) -> DataFrame:
    """(key, tracks, first) of recordings that share artist, title, album and track number."""
    key = tags.identity_key(F.col("primary_artist"), F.col("title"), F.col("album"), F.col("track_number"))
    groups = tracks.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("tracks"), F.min("recording_id").alias("first"))
    return groups.filter("tracks > 1")


def duplicates_by_size(tracks: DataFrame) -> DataFrame:
    """(size_bytes, tracks) of sizes that several files have."""
    return tracks.groupBy("size_bytes").agg(F.count(F.lit(1)).alias("tracks")).filter("tracks > 1")


def quality() -> Column:
    """Weighted format, bitrate, sample rate, completeness of six tags and size, each out of ten."""
    rank = F.lit(0)
    for kind, value in FORMAT_RANK.items():
        rank = F.when(F.lower("file_type") == kind, F.lit(value)).otherwise(rank)
    size = F.least(F.lit(1.0), F.col("size_bytes") / 104857600) * 10
    rate = F.least(F.lit(1.0), F.coalesce(F.col("sample_rate"), F.lit(0)) / 192000) * 10
    bits = F.least(F.lit(1.0), F.coalesce(F.col("bitrate"), F.lit(0)) / 3200) * 10
    filled = sum((tags.given(F.col(c)).cast("int") for c in ("title", "artists_raw", "album", "year", "genre", "track_number")), F.lit(0))
    return F.round(0.4 * rank + 0.25 * bits + 0.15 * rate + 0.1 * (filled / 6 * 10) + 0.1 * size, 6)


def quality_score(tracks: DataFrame) -> DataFrame:
    return tracks.select("recording_id", quality().alias("quality"))


STRATEGIES = ("best", "first", "smart")


def _kept(tracks: DataFrame, strategy: str) -> tuple[DataFrame, DataFrame]:
    """(rows, kept): duplicates by tags, written, so that the tracks are read once, and of each key of several the row that
    stays. It comes from a partially aggregated group-by, so a large group is no single task's."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    key = tags.identity_key(F.col("primary_artist"), F.col("title"), F.col("album"), F.col("track_number"))
    tagged = tracks.filter(tags.given(F.col("primary_artist")) | tags.given(F.col("title")))
    row, order = F.col("recording_id"), ["recording_id"]
    columns = {"key": key, "size_bytes": F.col("size_bytes"), "quality": quality()}
    if strategy != "best":
        order = ["ord1", "ord2", "recording_id"]
        columns |= {"ord1": F.col("ord1"), "ord2": F.col("ord2")}
    if strategy == "smart":
        columns["content"] = F.md5(F.concat_ws("|", "title", "primary_artist", F.col("duration_seconds").cast("long").cast("string")))
        columns["parts"] = F.size(F.split("path", "/"))
        columns["filled"] = sum((tags.given(F.col(c)).cast("int") for c in ("title", "artists_raw", "album", "year", "genre")), F.lit(0))
    rows = written(tagged.select("recording_id", *[c.alias(n) for n, c in columns.items()]))
    best = F.min_by(row, F.struct(-F.col("quality"), *order))
    if strategy == "first":
        best = F.min_by(row, F.struct(*order))
    if strategy == "smart":
        exact = F.min("content").eqNullSafe(F.max("content"))
        fullest = F.min_by(row, F.struct(-F.col("filled"), *order))
        best = F.when(exact, F.min_by(row, F.struct("parts", *order))).when(F.max("filled") >= 4, fullest).otherwise(best)
    kept = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), best.alias("kept")).filter("n > 1").select("key", "kept")
    return rows, kept


def ranked_duplicates(tracks: DataFrame) -> DataFrame:
    """(recording_id, key, size_bytes, place) of duplicates by tags: 1 for the best quality, of equals the least id, and 2 for
    the others. Tracks without artist and title have no key."""
    rows, kept = _kept(tracks, "best")
    place = F.when(F.col("recording_id") == F.col("kept"), 1).otherwise(2)
    return rows.join(kept, "key").select("recording_id", "key", "size_bytes", place.alias("place"))


def keep_best(tracks: DataFrame) -> DataFrame:
    """(recording_id, key, action): of duplicates by tags the best is kept."""
    return resolve_duplicates(tracks, "best")


def resolve_duplicates(tracks: DataFrame, strategy: str = "best", move: bool = False) -> DataFrame:
    """(recording_id, key, action) of duplicates by tags: one of each is to `keep`, the others to `delete`, or to `move`.

    Kept is the `best` quality (the least id among equals), the `first` in order of arrival, or by `smart`: of copies of one
    file that with the fewest folders in its path, else that with most of five tags if it has four, else the best; the first
    among equals."""
    rows, kept = _kept(tracks, strategy)
    action = F.when(F.col("recording_id") == F.col("kept"), "keep").otherwise("move" if move else "delete")
    return rows.join(kept, "key").select("recording_id", "key", action.alias("action"))


def track_order(tracks: DataFrame) -> DataFrame:
    """(recording_id, place) within the release: by track number, none last, then title, then id."""
    order = Window.partitionBy("primary_artist", "album").orderBy(
        F.coalesce("track_number", F.lit(999)), F.lower("title"), "recording_id"
    )
    return tracks.select("recording_id", F.row_number().over(order).alias("place"))


def detect_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change): new, removed, modified (size or time differ) or unchanged, in one full outer join."""
    both = previous.alias("p").join(current.alias("c"), "path", "full_outer")
    same = F.col("p.size").eqNullSafe(F.col("c.size")) & F.col("p.mtime").eqNullSafe(F.col("c.mtime"))
    change = F.when(F.col("p.size").isNull(), "new").when(F.col("c.size").isNull(), "removed").when(same, "unchanged").otherwise("modified")
    return both.select("path", change.alias("change"))


def removed_paths(previous: DataFrame, current: DataFrame) -> DataFrame:
    return previous.select("path").join(current.select("path"), "path", "left_anti")


def latest_operations(log: DataFrame) -> DataFrame:
    """The last record of each operation, by partially aggregated max_by."""
    last = F.max_by(F.struct("session_id", "operation_type", "status", "file_size"), F.struct("ts", "record")).alias("last")
    return log.groupBy("id").agg(last).select("id", "last.*")


def session_counters(log: DataFrame) -> DataFrame:
    """(session_id, total, completed, failed, bytes) over the last record of each operation."""
    return latest_operations(log).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum("file_size").alias("bytes"),
    )
