"""Filters on tags, and joins that look up or carry over values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellac.functions import tags


def containing(tracks: DataFrame, column: str, text: str) -> DataFrame:
    """Tracks whose column contains the text, whatever the case."""
    return tracks.filter(F.lower(column).contains(text.lower()))


def page(df: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """A slice in a total order, which `order` must give."""
    return df.orderBy(*order).offset(offset).limit(limit)


def recently_added(tracks: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Tracks created in the days up to `as_of`."""
    end = F.lit(as_of).cast("timestamp")
    return tracks.filter((F.col("created_at") >= end - F.make_dt_interval(F.lit(days))) & (F.col("created_at") <= end))


def needs_enrichment(tracks: DataFrame, fields: tuple[str, ...] = ("year", "genre", "albumartist", "composer")) -> DataFrame:
    """(recording_id, missing) of tracks that lack some of the fields; their names joined by a bar."""
    missing = F.concat_ws("|", *[F.when(~tags.given(F.col(f)), F.lit(f)) for f in fields])
    return tracks.select("recording_id", missing.alias("missing")).filter("missing <> ''")


def pattern_match(text: Column, pattern: str, kind: str) -> Column:
    """Whether a text matches, whatever the case: exact, contains, starts, ends, regex or fuzzy (edit similarity of
    0.8, lengths at most half as much apart); null texts don't match."""
    text, wanted = F.lower(text), pattern.lower()
    if kind == "fuzzy":
        close = (F.length(text) <= 1.5 * len(wanted)) & (F.length(text) * 1.5 >= len(wanted))
        match = close & (tags.levenshtein_similarity(text, F.lit(wanted)) >= 0.8)
    else:
        forms = {"exact": text == wanted, "contains": text.contains(wanted), "starts": text.startswith(wanted), "ends": text.endswith(wanted), "regex": text.rlike(wanted)}
        match = forms[kind]
    return F.coalesce(match, F.lit(False))


def enrich(tracks: DataFrame, reference: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Tracks with the reference's fields where it has them; one reference row for each key, none for others."""
    found = reference.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields])
    joined = tracks.join(found, keys, "left")
    return joined.withColumns({f: F.when(tags.given(F.col(f"_{f}")), F.col(f"_{f}")).otherwise(F.col(f)) for f in fields}).select(*tracks.columns)


def infer_year_from_album(tracks: DataFrame) -> DataFrame:
    """(recording_id, year): a missing year is that of the first track of the release that has one. The release's
    year comes from a partially aggregated group-by, so a large release needs no window."""
    first = tracks.filter("year IS NOT NULL").groupBy("primary_artist", "album")
    first = first.agg(F.min_by("year", F.struct("ord1", "ord2", "recording_id")).alias("_year"))
    return tracks.join(first, ["primary_artist", "album"], "left").select("recording_id", F.coalesce("year", "_year").alias("year"))


def verify_manifest(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """(path, problem) of the manifest's files that are missing or have another size."""
    now = current.select("path", F.col("size").alias("_size"))
    problem = F.when(F.col("_size").isNull(), "missing").when(F.col("_size") != F.col("size"), "size mismatch")
    return manifest.join(now, "path", "left").select("path", problem.alias("problem")).filter("problem IS NOT NULL")


def restorable(manifest: DataFrame, backup: DataFrame, target: DataFrame) -> DataFrame:
    """(path, state) of each of the manifest's files: backup missing, target exists or restorable."""
    kept = backup.select("path", F.lit(True).alias("_kept"))
    there = target.select("path", F.lit(True).alias("_there"))
    state = F.when(F.col("_kept").isNull(), "backup missing").when(F.col("_there").isNotNull(), "target exists").otherwise("restorable")
    return manifest.join(kept, "path", "left").join(there, "path", "left").select("path", state.alias("state"))


def apply_moves(files: DataFrame, moves: DataFrame) -> DataFrame:
    """(path, moved_to) of each file: the target of its completed move, else its own path. `moves` has source, target
    and status, one completed move for each source at most."""
    done = moves.filter("status = 'completed'").select(F.col("source").alias("path"), "target")
    return files.join(done, "path", "left").select("path", F.coalesce("target", "path").alias("moved_to"))


def corrections(tracks: DataFrame, usual: DataFrame) -> DataFrame:
    """(recording_id, predicted, genre) of tracks whose genre is not the usual one of their artist."""
    predicted = usual.select("primary_artist", F.col("genre").alias("predicted"))
    return tracks.join(predicted, "primary_artist").filter("genre <> predicted").select("recording_id", "predicted", "genre")


def classification_report(found: DataFrame) -> DataFrame:
    """(label, support, precision, recall, f1) from columns actual and predicted: one pass over the confusion counts.
    A label that is never predicted has a precision of 0."""
    counts = found.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    sides = F.array(F.struct(F.col("actual").alias("label"), F.lit(True).alias("truth")), F.struct(F.col("predicted").alias("label"), F.lit(False).alias("truth")))
    rows = counts.select(F.explode(sides).alias("side"), "n", (F.col("actual") == F.col("predicted")).alias("hit"))
    by_label = rows.groupBy(F.col("side.label").alias("label")).agg(
        F.coalesce(F.sum(F.when(F.col("side.truth"), F.col("n"))), F.lit(0)).alias("support"),
        F.coalesce(F.sum(F.when(~F.col("side.truth"), F.col("n"))), F.lit(0)).alias("given"),
        F.coalesce(F.sum(F.when(F.col("side.truth") & F.col("hit"), F.col("n"))), F.lit(0)).alias("hits"),
    )
    ratio = lambda part, whole: F.round(F.when(whole > 0, part / whole).otherwise(0.0), 6)
    hits, support, given = F.col("hits"), F.col("support"), F.col("given")
    return by_label.select("label", "support", ratio(hits, given).alias("precision"), ratio(hits, support).alias("recall"), ratio(2 * hits, support + given).alias("f1"))


def fill_from_lookup(tracks: DataFrame, found: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """`tracks` with the fields that are missing filled from a lookup (artist, title, album, and the fields), and `filled`, the
    names of those that were.

    A track with artist and title takes the answer for its artist, title and album, whatever the case; without one, that for
    its artist and title. Of several answers the first by album, then by the fields, counts, so there is one a key; answers
    are reduced before the join. Values that are there, other fields, and tracks without artist or title stay.

    Only tracks that lack a field are joined, so `tracks` is read twice: best a table, not a query."""
    low = lambda c: F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))
    answer = F.struct(*[F.col(f) for f in fields])
    rows = found.filter(tags.given(F.col("artist")) & tags.given(F.col("title"))).select(low("artist").alias("_a"), low("title").alias("_t"), low("album").alias("_b"), answer.alias("_answer"))
    exact = rows.groupBy("_a", "_t", "_b").agg(F.min_by("_answer", F.to_json("_answer")).alias("_exact"))
    loose = exact.groupBy("_a", "_t").agg(F.min_by("_exact", "_b").alias("_loose"))
    lacking = ~reduce(Column.__and__, [tags.given(F.col(f)) for f in fields])
    asked = F.coalesce(lacking & tags.given(F.col("primary_artist")) & tags.given(F.col("title")), F.lit(False))
    keyed = tracks.filter(asked).withColumns({"_a": low("primary_artist"), "_t": low("title"), "_b": low("album")})
    joined = keyed.join(exact, ["_a", "_t", "_b"], "left").join(loose, ["_a", "_t"], "left").withColumn("_answer", F.coalesce("_exact", "_loose"))
    missing = {f: ~tags.given(F.col(f)) & tags.given(F.col(f"_answer.{f}")) for f in fields}
    filled = F.array_compact(F.array(*[F.when(missing[f], F.lit(f)) for f in fields]))
    kept = [F.when(missing[c], F.col(f"_answer.{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(f"`{c}`") for c in tracks.columns]
    rest = tracks.filter(~asked).select("*", F.array().cast("array<string>").alias("filled"))
    return joined.select(*kept, filled.alias("filled")).unionByName(rest)


def estimate_from_sample(tracks: DataFrame, kind: Column, n: int = 100) -> DataFrame:
    """(kind, sampled, files, megabytes): the kinds of the first n tracks by id, and what that makes of the whole: as many
    files and megabytes as the sample has, times the tracks over the sample. A report on a sample, by its nature."""
    whole = tracks.agg(F.count(F.lit(1)).alias("whole"))
    sample = tracks.select("recording_id", kind.alias("kind"), "size_bytes").orderBy("recording_id").limit(n)
    counts = sample.groupBy("kind").agg(F.count(F.lit(1)).alias("sampled"), F.sum("size_bytes").alias("bytes"))
    share = F.col("whole") / F.least(F.lit(n), F.col("whole"))
    scaled = counts.crossJoin(F.broadcast(whole))
    return scaled.select("kind", "sampled", F.round(F.col("sampled") * share, 2).alias("files"), F.round(F.col("bytes") / (1 << 20) * share, 2).alias("megabytes"))
