"""How disorganised a library is, and which structure suits it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellac.functions import tags
from shellac.operators.organizing import directory
from shellac.tables import written

#: Structures that can be recommended, by name: complexity and folders.
STRATEGIES = {
    "artist_album": ("simple", "{artist}/{album} ({year})"),
    "genre_artist_album": ("moderate", "{genre}/{artist}/{album} ({year})"),
    "decade_artist_album": ("moderate", "{decade}/{artist}/{album} ({year})"),
    "smart_content_type": ("complex", "{content_type}/{artist}/{album} ({year})"),
    "flat_smart": ("simple", "{artist_first_letter}/{artist} - {album} - {title}"),
    "collection_based": ("complex", "{main_genre}/{content_type}/{artist}/{album} ({year})"),
}


def library_facts(tracks: DataFrame, kind: Column, all_kinds: int = 6) -> DataFrame:
    """One row: tracks, completeness of title, artist, year and genre, content types, genres, decades, and `chaos`, 0 to
    1, from missing tags, formats with less than 0.7 of the tracks, mixed content types of `all_kinds`, and flat ones among
    the five folders with most tracks. No tracks give zeros."""
    filled = sum((tags.given(F.col(c)).cast("int") for c in ("title", "primary_artist", "year", "genre")), F.lit(0))
    n = F.count(F.lit(1))
    # the tracks are read once: counts by folder and what else is asked for, written, which all the rest adds up
    parts = {"folder": directory(F.col("path")), "file_type": F.col("file_type"), "kind": kind, "genre": F.col("genre"), "decade": tags.decade(F.col("year"))}
    counts = written(tracks.groupBy(*[c.alias(name) for name, c in parts.items()]).agg(n.alias("n"), F.sum(filled).alias("filled")))
    total = F.coalesce(F.sum("n"), F.lit(0))
    base = counts.agg(
        total.alias("tracks"),
        F.round(F.when(total > 0, F.sum("filled") / total / 4).otherwise(0.0), 6).alias("completeness"),
        F.count_distinct("kind").alias("kinds"),
        F.count_distinct("genre").alias("genres"),
        F.count_distinct("decade").alias("decades"),
    )
    formats = counts.groupBy("file_type").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(base.select("tracks")))  # against one row
    share = F.col("n") / F.col("tracks")
    impure = formats.agg(F.coalesce(F.sum(F.when(share < 0.7, share)), F.lit(0.0)).alias("impurity"))
    folders = counts.groupBy("folder").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "folder").limit(5)
    deep = folders.agg(F.avg((F.size(F.split("folder", "/")) > 2).cast("int")).alias("deep"))
    both = base.crossJoin(impure).crossJoin(deep)  # tables of one row
    mixed = F.least(F.lit(0.2), F.col("kinds") / all_kinds * 0.1)
    flat = F.coalesce((1 - F.col("deep")) * 0.4, F.lit(0.0))
    chaos = F.least(F.lit(1.0), (1 - F.col("completeness")) * 0.3 + F.col("impurity") * 0.2 + mixed + flat)
    return both.select(*base.columns, F.round(F.when(F.col("tracks") > 0, chaos).otherwise(0.0), 6).alias("chaos"))


def _score(name: str, complexity: str) -> Column:
    full, large, genres, kinds, chaos = (F.col(c) for c in ("completeness", "tracks", "genres", "kinds", "chaos"))
    score = F.lit(0.5)

    def add(condition: Column, points: float, fits: bool) -> None:
        nonlocal score
        if fits:
            score = score + F.when(condition, points).otherwise(0.0)

    add(full > 0.8, 0.3, name in ("artist_album", "genre_artist_album", "smart_content_type"))
    add(full < 0.5, 0.2, name == "flat_smart")
    add(large > 10000, 0.2, name in ("collection_based", "genre_artist_album"))
    add(large > 10000, -0.1, name == "flat_smart")
    add(large < 1000, 0.2, name in ("flat_smart", "artist_album"))
    add(large < 1000, -0.1, name == "collection_based")
    add(genres > 8, 0.25, "genre" in name)
    add(genres < 3, -0.1, "genre" in name)
    add(kinds > 3, 0.3, name == "smart_content_type")
    add(kinds == 1, -0.1, name == "smart_content_type")
    add(F.col("decades") > 4, 0.2, "decade" in name)
    add(chaos > 0.7, 0.2, complexity != "simple")
    add(chaos < 0.3, 0.1, complexity == "simple")
    return F.least(F.lit(1.0), score)


def recommend_strategies(facts: DataFrame, k: int = 5) -> DataFrame:
    """(strategy, complexity, folders, score, minutes): the k structures that suit the one row of library_facts best, the
    later name among equals, and whole minutes that they take."""
    pace = {"simple": 1.0, "moderate": 1.5, "complex": 2.0}
    base = F.greatest(F.lit(1.0), F.col("tracks") / 100)

    def row(name: str, complexity: str, folders: str) -> Column:
        minutes = F.floor(base * pace[complexity] * (1 + F.col("chaos") * 0.5)).cast("long")
        score = F.round(_score(name, complexity), 6)
        return F.struct(F.lit(name).alias("strategy"), F.lit(complexity).alias("complexity"), F.lit(folders).alias("folders"), score.alias("score"), minutes.alias("minutes"))

    rows = facts.select(F.inline(F.array(*[row(name, *about) for name, about in STRATEGIES.items()])))
    return rows.orderBy(F.desc("score"), F.desc("strategy")).limit(k)
