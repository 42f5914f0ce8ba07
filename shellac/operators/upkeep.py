"""Look-ups, additions and patches of a catalog, and views of its logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shellac.functions import recordings, tags
from shellac.operators import resolution, statistics
from shellac.operators.curation import latest_operations


def releases_by(tracks: DataFrame, artist: str | None = None, title: str | None = None, year: int | None = None) -> DataFrame:
    """Releases (see statistics.releases) by artist and title, whatever the case, and by their year."""
    found = tracks
    for column, value in (("primary_artist", artist), ("album", title)):
        if value is not None:
            found = found.filter(F.lower(column) == value.lower())
    out = statistics.releases(found)
    return out if year is None else out.filter(F.col("year") == year)


def similar_to(tracks: DataFrame, given: DataFrame, least: float = 0.8) -> DataFrame:
    """(recording_id, score) of tracks at least so like the one row of `given`, itself left out."""
    names = ("title", "artists", "album", "seconds")
    columns = ["recording_id", "title", tags.split_artists(F.col("artists_raw")).alias("artists"), "album", F.col("duration_seconds").alias("seconds")]
    one = given.select(*columns).limit(1)
    both = tracks.select(*columns).alias("t").crossJoin(F.broadcast(one).alias("g"))  # a table of one row
    score = recordings.recording_likeness(*[{n: F.col(f"{side}.{n}") for n in names} for side in "tg"])
    scored = both.filter("t.recording_id <> g.recording_id").select("t.recording_id", F.round(score, 6).alias("score"))
    return scored.filter(F.col("score") >= least)


def upsert_recordings(catalog: DataFrame, incoming: DataFrame) -> DataFrame:
    """(recording_id, status) of the rows that come in: those at a path that the catalog has are `rejected`; of several
    at one path the first in order of arrival is `added`. Tracks without a path are added."""
    first = incoming.filter("path IS NOT NULL").groupBy("path").agg(F.min_by("recording_id", F.struct("ord1", "ord2", "recording_id")).alias("first"))
    there = catalog.filter("path IS NOT NULL").select("path").distinct().withColumn("there", F.lit(True))
    known = first.join(there, "path", "left").select("path", F.when(F.col("there").isNull(), F.col("first")).alias("first"))
    added = F.col("path").isNull() | F.coalesce(F.col("first") == F.col("recording_id"), F.lit(False))
    return incoming.select("recording_id", "path").join(known, "path", "left").select("recording_id", F.when(added, "added").otherwise("rejected").alias("status"))


def patch_metadata(tracks: DataFrame, updates: DataFrame, fields: tuple[str, ...], replace: bool = False) -> DataFrame:
    """(recording_id, fields, changed) with the values of `updates` by id: merged where they are not null, or replaced
    whole; `changed` names the fields that differ now, in order. Rows without an update stay; an id has one update."""
    both = tracks.alias("t").join(updates.withColumn("update", F.lit(True)).alias("u"), "recording_id", "left")
    new = {f: F.col(f"u.{f}") if replace else F.coalesce(f"u.{f}", f"t.{f}") for f in fields}
    after = {f: F.when(F.col("u.update"), new[f]).otherwise(F.col(f"t.{f}")) for f in fields}
    changed = F.array_compact(F.array(*[F.when(~after[f].eqNullSafe(F.col(f"t.{f}")), F.lit(f)) for f in fields]))
    return both.select("recording_id", *[after[f].alias(f) for f in fields], changed.alias("changed"))


def duplicate_preview(tracks: DataFrame, k: int = 10) -> DataFrame:
    """(key, tracks, recording_id) of the k largest groups of duplicates by tags, the least key among equals; groups
    are limited before their members are looked up."""
    groups = resolution.duplicates_by_key(tracks, resolution.tag_key()).orderBy(F.desc("tracks"), "key").limit(k)
    members = tracks.select("recording_id", resolution.tag_key().alias("key"))
    return members.join(F.broadcast(groups.select("key", "tracks")), "key").select("key", "tracks", "recording_id")


def diversity(tracks: DataFrame, k: int = 10) -> DataFrame:
    """One row: genres, the k largest of them as percent of all genres by number, artists, tracks for each artist."""
    genres = statistics.genre_distribution(tracks).agg(F.count(F.lit(1)).alias("genres"))
    artists = statistics.exploded_artists(tracks.select("artists_raw")).agg(F.count_distinct(F.lower("artist")).alias("artists"))
    both = genres.crossJoin(artists).crossJoin(tracks.agg(F.count(F.lit(1)).alias("n")))  # tables of one row
    share = F.when(F.col("genres") > 0, 100 * F.least(F.lit(k), F.col("genres")) / F.col("genres")).otherwise(0.0)
    each = F.when(F.col("artists") > 0, F.col("n") / F.col("artists")).otherwise(0.0)
    return both.select("genres", F.round(share, 6).alias("concentration"), "artists", F.round(each, 6).alias("tracks_per_artist"))


def build_artists(tracks: DataFrame) -> DataFrame:
    """(artist, recordings, releases, seconds, genres) of every artist on a track; genres sorted. Tracks are gathered by
    artist and release first, so an artist on very many tracks is spread over them."""
    rows = statistics.exploded_artists(tracks)
    parts = rows.groupBy("artist", "primary_artist", "album").agg(
        F.count(F.lit(1)).alias("n"), F.sum("duration_seconds").alias("seconds"), F.collect_set("genre").alias("genres")
    )
    return parts.groupBy("artist").agg(
        F.sum("n").alias("recordings"),
        F.count("album").alias("releases"),
        F.sum("seconds").cast("long").alias("seconds"),
        F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set("genres")))), "|").alias("genres"),
    )


def _spans(log: DataFrame) -> DataFrame:
    """(id, seconds): whole seconds from an operation's first record to its last."""
    ends = log.groupBy("id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    return ends.select("id", F.timestamp_diff("SECOND", "start", "end").alias("seconds"))


def slow_operations(log: DataFrame, least: int) -> DataFrame:
    """(id, seconds) of operations that took more than `least` seconds from first to last record."""
    return _spans(log).filter(F.col("seconds") > least)


def extraction_stats(log: DataFrame) -> DataFrame:
    """One row over operations: completed, failed, bytes of the completed, their mean seconds and megabytes a second."""
    both = latest_operations(log).join(_spans(log), "id")
    done = F.col("status") == "completed"
    size, seconds = F.coalesce(F.sum(F.when(done, F.col("file_size"))), F.lit(0)), F.sum(F.when(done, F.col("seconds")))
    return both.agg(
        F.count_if(done).alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        size.alias("bytes"),
        F.round(F.avg(F.when(done, F.col("seconds"))), 6).alias("avg_seconds"),
        F.round(F.when(seconds > 0, size / (1 << 20) / seconds), 9).alias("mb_per_second"),
    )


def session_list(log: DataFrame) -> DataFrame:
    """(session_id, started, ended, records) of every session."""
    return log.groupBy("session_id").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("records"))


def session_operations(log: DataFrame, session_id: str) -> DataFrame:
    """The last records of a session's operations."""
    return latest_operations(log).filter(F.col("session_id") == session_id)


def without_session(log: DataFrame, session_id: str) -> DataFrame:
    """The log without a session; records of no session stay."""
    return log.filter(~F.col("session_id").eqNullSafe(session_id))


def flatten_events(events: DataFrame) -> DataFrame:
    """(event_id, aggregate, kind, payload): the envelope of each event and the number in its JSON."""
    payload = F.from_json("props", "k BIGINT")["k"]
    return events.select("event_id", F.col("user_id").alias("aggregate"), F.col("event_type").alias("kind"), payload.alias("payload"))


def change_frequency(log: DataFrame) -> DataFrame:
    """(file_path, frequency, stability): for each change the frequency becomes the mean of itself and of one over the
    days since the change before, written as a sum of weights that halve; stability is 1 - 30 * frequency, 0 at least."""
    changes = log.select("file_path", "mtime").distinct()
    order = Window.partitionBy("file_path").orderBy("mtime")
    days = F.datediff("mtime", F.lag("mtime").over(order))
    back = F.row_number().over(Window.partitionBy("file_path").orderBy(F.desc("mtime")))
    steps = changes.select("file_path", days.alias("days"), back.alias("back"))
    frequency = F.coalesce(F.sum(F.pow(F.lit(0.5), F.col("back")) / F.col("days")), F.lit(0.0))
    out = steps.groupBy("file_path").agg(F.round(frequency, 6).alias("frequency"))
    return out.withColumn("stability", F.round(F.greatest(F.lit(0.0), 1 - F.col("frequency") * 30), 6))


def known_imports(catalog: DataFrame, incoming: DataFrame) -> DataFrame:
    """(recording_id, known) of the rows that come in: whether the catalog has the same tags, or an earlier row by id that
    comes in has. Keys are counted before the join, so a large group sends one row."""
    keyed = incoming.select("recording_id", resolution.tag_key().alias("key"))
    first = keyed.groupBy("key").agg(F.min("recording_id").alias("first"))
    there = catalog.select(resolution.tag_key().alias("key")).distinct().withColumn("there", F.lit(True))
    state = first.join(there, "key", "left")
    known = F.col("there").isNotNull() | (F.col("recording_id") != F.col("first"))
    return keyed.join(state, "key").select("recording_id", known.alias("known"))


def catalog_stats(tracks: DataFrame) -> DataFrame:
    """One row: tracks, those with the tags of another, groups of such, tracks without a year or a genre, mean seconds.
    Tracks are gathered by key first, and the totals come from the groups."""
    untagged = F.count_if(F.col("year").isNull() | F.col("genre").isNull())
    groups = tracks.groupBy(resolution.tag_key().alias("key")).agg(
        F.count(F.lit(1)).alias("n"), untagged.alias("untagged"), F.sum("duration_seconds").alias("seconds"), F.count("duration_seconds").alias("timed")
    )
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("tracks"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicates"),
        F.count_if(F.col("n") > 1).alias("groups"),
        F.coalesce(F.sum("untagged"), F.lit(0)).alias("untagged"),
        F.round(F.sum("seconds") / F.sum("timed"), 6).alias("avg_seconds"),
    )


def by_path(tracks: DataFrame, path: str) -> DataFrame:
    """The tracks at a path; the filter reaches the scan where the path is stored."""
    return tracks.filter(F.col("path") == path)


def union_catalogs(existing: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of both, by name of column; columns that one lacks are null there."""
    return existing.unionByName(new, allowMissingColumns=True)
