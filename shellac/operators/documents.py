"""Albums and artists as nested documents, and reports on decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellac.tables import with_position

#: Tracks, or albums, of a document; a larger one is cut into parts of so many, in order.
PART = 1000
#: Album of tracks without one.
UNKNOWN = "Unknown Album"


def _parts(rows: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    """`rows` with `place`, from 1 within each key, and `part`, from 0, without one task seeing a whole key."""
    placed = with_position(rows, [*keys, *order], "at")
    starts = placed.groupBy(*keys).agg(F.min("at").alias("start"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    joined = placed.alias("l").join(starts.alias("r"), same).select("l.*", "r.start")
    return joined.withColumn("place", F.col("at") - F.col("start") + 1).withColumn("part", F.floor((F.col("place") - 1) / size).cast("int"))


def album_documents(tracks: DataFrame, size: int = PART) -> DataFrame:
    """(artist, title, part, year, genre, tracks): a document for each album, its tracks in the order of their numbers (null
    after 998) and titles, each with place, number, title and seconds; albums of more than `size` tracks come in parts. Year
    and genre are those of the part's first track that has them. Tracks without an album are in UNKNOWN."""
    rows = tracks.select(
        F.col("primary_artist").alias("artist"), F.coalesce(F.nullif(F.trim("album"), F.lit("")), F.lit(UNKNOWN)).alias("album"), "recording_id",
        F.col("track_number").alias("number"), F.coalesce("track_number", F.lit(999)).alias("rank"), "title", F.lower("title").alias("lowered"),
        F.col("duration_seconds").alias("seconds"), "year", "genre",
    )
    placed = _parts(rows, ["artist", "album"], ["rank", "lowered", "recording_id"], size)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("place"))).alias(c)
    lines = F.sort_array(F.collect_list(F.struct("place", "number", "title", "seconds", "recording_id")))
    found = placed.groupBy("artist", "album", "part").agg(first("year"), first("genre"), lines.alias("tracks"))
    return found.select("artist", F.col("album").alias("title"), "part", "year", "genre", "tracks")


def artist_documents(tracks: DataFrame, size: int = PART) -> DataFrame:
    """(name, part, genre, albums): a document for each artist with its albums by year and title, each with title, year and
    number of tracks; genre is the artist's most frequent one. Artists of more than `size` albums come in parts."""
    counts = tracks.groupBy("primary_artist", "album", "genre").agg(F.count(F.lit(1)).alias("n"), F.min("year").alias("year"))
    genres = counts.groupBy("primary_artist", "genre").agg(F.sum("n").alias("n"))
    usual = genres.groupBy("primary_artist").agg(F.min_by("genre", F.when(F.col("genre").isNotNull(), F.struct(-F.col("n"), "genre"))).alias("genre"))
    albums = counts.groupBy("primary_artist", "album").agg(F.sum("n").alias("tracks"), F.min("year").alias("year"))
    placed = _parts(albums.select(F.col("primary_artist").alias("name"), F.col("album").alias("title"), "year", "tracks"), ["name"], ["year", "title"], size)
    lines = F.sort_array(F.collect_list(F.struct("place", "title", "year", "tracks")))
    docs = placed.groupBy("name", "part").agg(lines.alias("albums"))
    usual = usual.withColumnRenamed("primary_artist", "artist")
    return docs.join(usual, F.col("name").eqNullSafe(F.col("artist"))).select("name", "part", "genre", "albums")


def as_xml(documents: DataFrame, root: str) -> Column:
    """Each document as XML with the root element named."""
    return F.to_xml(F.struct(*[F.col(f"`{c}`") for c in documents.columns]), {"rowTag": root})


def resolution_report(decisions: DataFrame) -> DataFrame:
    """(section, content): a line of JSON for the summary of decisions (leader, recording_id, action: keep, move or delete,
    size_bytes), and one for each decision."""
    count = lambda action: F.count_if(F.col("action") == action)
    saved = F.coalesce(F.sum(F.when(F.col("action") == "delete", F.col("size_bytes"))), F.lit(0))
    summary = decisions.agg(
        F.count_distinct("leader").alias("groups"), count("keep").alias("kept"), count("move").alias("moved"), count("delete").alias("deleted"), saved.alias("saved")
    )
    line = F.to_json(F.struct("leader", "recording_id", "action", "size_bytes"))
    return summary.select(F.lit("summary").alias("section"), F.to_json(F.struct("*")).alias("content")).unionByName(decisions.select(F.lit("decision").alias("section"), line.alias("content")))
