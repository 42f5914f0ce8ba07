"""Nested payloads of a lookup service, flattened."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a recording's payload has that is used here; other fields are not read.
RECORDING = (
    "id string, releases array<struct<date: string, `artist-credit`: array<struct<artist: struct<name: string>>>, "
    "media: array<struct<tracks: array<struct<number: string, recording: struct<id: string>>>>>>>, tags array<struct<name: string>>"
)
TAGS = 5


def flatten_reference(payload: Column) -> dict[str, Column]:
    """year, albumartist, track_number and genre of a recording's JSON payload.

    The first release gives the year of its date, the first credited artist with a name, and the number of the track that is
    this recording: as written, if that is a number, or its place where none is written; of several media the last that
    has it counts. genre joins the names of the first TAGS tags. Broken or null payloads, and fields that are missing, give nulls."""
    return recording_fields(F.from_json(payload, RECORDING))


def recording_fields(data: Column) -> dict[str, Column]:
    """flatten_reference of a payload that is parsed already (see RECORDING); as a column of its own it is parsed once a row."""
    release = F.get(data["releases"], F.lit(0))
    credits = F.filter(F.transform(release["artist-credit"], lambda c: c["artist"]["name"]), lambda n: n.isNotNull())

    def number(medium: Column) -> Column:
        placed = F.transform(medium["tracks"], lambda t, i: F.struct(t["number"].alias("number"), t["recording"]["id"].alias("id"), (i + 1).alias("place")))
        own = F.get(F.filter(placed, lambda t: t["id"].eqNullSafe(data["id"])), F.lit(0))
        written = F.coalesce(own["number"], F.lit("")) != ""
        return F.when(written, F.trim(own["number"]).try_cast("int")).otherwise(own["place"])

    numbers = F.filter(F.transform(release["media"], number), lambda n: n.isNotNull())
    names = F.filter(F.transform(F.slice(data["tags"], 1, TAGS), lambda t: t["name"]), lambda n: n.isNotNull())
    return {
        "year": F.get(F.split(release["date"], "-"), F.lit(0)).try_cast("int"),
        "albumartist": F.get(credits, F.lit(0)),
        "track_number": F.when(F.size(numbers) > 0, F.element_at(numbers, -1)),
        "genre": F.when(F.size(names) > 0, F.array_join(names, ", ")),
    }
