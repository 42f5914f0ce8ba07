"""What to do about a library before and while it gets a new structure, and how the best structure would look."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellac.operators.layout import render_template, target_file
from shellac.operators.recommend import STRATEGIES

#: Formats without loss.
LOSSLESS = ("flac", "wav", "aiff")


def mixture(tracks: DataFrame, kind: Column) -> DataFrame:
    """One row: formats, the commonest of them (the first by name among equals), tracks of formats without loss, live tracks
    and compilations; from counts by format and kind, made in one pass."""
    counts = tracks.groupBy("file_type", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))

    def of(kind: str) -> Column:
        return F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0)).alias(kind)

    by_format = counts.groupBy("file_type").agg(F.sum("n").alias("n"), of("live"), of("compilation"))
    lossless = F.sum(F.when(F.col("file_type").isin(*LOSSLESS), F.col("n")).otherwise(0))
    commonest = F.min(F.struct((-F.col("n")).alias("minus"), "file_type"))["file_type"]
    return by_format.agg(F.count("file_type").alias("formats"), commonest.alias("commonest"), lossless.alias("lossless"), F.sum("live").alias("live"), F.sum("compilation").alias("compilation"))


def advise(facts: DataFrame, best: DataFrame, likelihood: DataFrame, mixed: DataFrame) -> DataFrame:
    """(kind, place, text): quick wins, issues, rules and steps, each kind in order from 1, from the single rows of library_facts,
    of the best of recommend_strategies, of duplicate_likelihood and of mixture. No tracks give the last step only."""
    row = facts.crossJoin(best.limit(1)).crossJoin(likelihood).crossJoin(mixed)  # tables of one row
    full, chaos, alike, genres, tracks = (F.col(c) for c in ("completeness", "chaos", "likelihood", "genres", "tracks"))
    by_genre, some = F.col("folders").contains("genre"), tracks > 0
    # fixed values: the bounds and texts below
    advice = {
        "quick_win": [
            (full < 0.8, "Fix missing metadata using MusicBrainz enhancement"),
            (alike > 0.1, "Remove duplicates to clean up the library"),
            (chaos > 0.5, "Consolidate scattered files into logical folders"),
            (F.col("formats") > 3, "Convert or organize different audio formats consistently"),
            (by_genre & (genres < 3), "Add genre tags for better categorization"),
        ],
        "issue": [
            (full < 0.6, "Low metadata quality may result in poor organization"),
            ((tracks > 50000) & (F.col("complexity") == "complex"), "Complex organization may be slow with very large libraries"),
            ((genres > 20) & by_genre, "Too many genres may create deep folder structures"),
            (alike > 0.2, "High likelihood of duplicates may waste space"),
            (chaos > 0.8, "Very disorganized library may need manual cleanup first"),
        ],
        "rule": [
            (F.col("compilation") > 5, "Compilation Handling: Compilations/{albumartist}/{album} ({year})"),
            (F.col("live") > 5, "Live Recordings: Live/{artist}/{album} ({year})"),
            (F.col("compilation") > tracks * 0.1, "Various Artists: Compilations/{albumartist}/{album} ({year})"),
            (F.col("lossless") > tracks * 0.3, "High Quality Separation: High Quality/{artist}/{album} ({year})"),
        ],
        "step": [
            (alike > 0.1, "Run duplicate detection and remove/rename duplicates"),
            (full < 0.7, "Run MusicBrainz metadata enhancement"),
            (F.col("formats") > 2, F.concat(F.lit("Consider converting non-"), "commonest", F.lit(" files for consistency"))),
            (chaos > 0.6, "Manual cleanup of folder structure inconsistencies"),
            (F.lit(True), "Normalize filenames to consistent pattern"),
        ],
    }

    def given(kind: str, condition: Column, text: str | Column) -> Column:
        shown = condition if kind == "step" else condition & some
        return F.when(shown, F.struct(F.lit(kind).alias("kind"), (F.lit(text) if isinstance(text, str) else text).alias("text")))

    lists = []
    for kind, items in advice.items():
        found = F.array_compact(F.array(*[given(kind, condition, text) for condition, text in items]))
        lists.append(F.transform(found, lambda r, i: F.struct(r["kind"].alias("kind"), (i + 1).alias("place"), r["text"].alias("text"))))
    return row.select(F.inline(F.concat(*lists)))


def preview(tracks: DataFrame, best: DataFrame, kind: Column, sample: int = 20) -> DataFrame:
    """(recording_id, path, target) of the first `sample` tracks by id: where the best structure of recommend_strategies (its
    first row) would put them. Missing genres and years' decades are named Unknown and unknown; a missing year is empty."""
    values = {
        "artist": F.coalesce("primary_artist", F.lit("Unknown Artist")),
        "album": F.coalesce("album", F.lit("Unknown Album")),
        "title": F.coalesce("title", F.lit("Unknown Title")),
        "year": F.col("year"),
        "genre": F.coalesce("genre", F.lit("Unknown")),
        "main_genre": F.coalesce("genre", F.lit("Unknown")),
        "decade": F.coalesce(F.concat((F.floor(F.col("year") / 10) * 10).cast("string"), F.lit("s")), F.lit("unknown")),
        "content_type": kind,
        "artist_first_letter": F.upper(F.left(F.coalesce("primary_artist", F.lit("Unknown Artist")), F.lit(1))),
    }
    folder = F.lit("")
    for name, (_, folders) in STRATEGIES.items():
        folder = F.when(F.col("strategy") == name, render_template(folders, values)).otherwise(folder)
    first = tracks.orderBy("recording_id").limit(sample).crossJoin(F.broadcast(best.limit(1).select("strategy")))
    file = target_file(F.col("track_number"), values["title"], F.col("file_type"))
    return first.select("recording_id", "path", F.concat(folder, F.lit("/"), file).alias("target"))
