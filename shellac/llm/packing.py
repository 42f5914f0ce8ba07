"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted. Pieces are taken by decreasing length; each goes to the open bin that it
fills best, and where none has room, a bin is opened. Its length is chosen jointly with what is left: for each length
that holds the piece, the pieces left fill such a bin as far as they can, largest first, and the length of least cost
per token filled is opened. At the end each bin shrinks to the shortest permitted length that holds its contents.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellac.llm.mixing import word_count
from shellac.llm.scratch import with_position, written

#: Permitted sequence lengths in tokens.
LENGTHS = (512, 1024, 2048, 4096)
#: A sequence of c tokens costs SEQUENCE_COST + c + c * c / ATTENTION_SCALE: start-up, feed-forward and attention.
SEQUENCE_COST = 16
ATTENTION_SCALE = 65536
#: Pieces packed together; each such group is one task's unit and has bins of its own.
GROUP_PIECES = 20_000
_BIN_BITS = 20


def cost(length: int) -> float:
    """Cost of a sequence of that length, in tokens."""
    return SEQUENCE_COST + length + length * length / ATTENTION_SCALE


def _filled(room: int, kinds: list[int], counts: dict[int, int]) -> int:
    """Tokens of the pieces left (kinds: their lengths in increasing order, counts of each) that fill `room`, largest first."""
    free = room
    at = bisect.bisect_right(kinds, free)
    while at:
        size = kinds[at - 1]
        free -= size * min(counts[size], free // size)
        at = bisect.bisect_right(kinds, min(free, size - 1))
    return room - free


def best_fit(sizes: list[int], lengths: tuple[int, ...]) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each of `sizes` (given in decreasing order, none above the longest length), and the final
    length of each bin.

    Rooms of open bins are kept in lists by room, and the rooms in use in one sorted list of at most max(lengths)
    numbers, so a best fit is one binary search. Of equal rooms the last one left is filled; of equal costs the shorter
    length is opened."""
    lengths = tuple(sorted(lengths))
    counts = Counter(sizes)
    kinds = sorted(counts)
    open_bins: dict[int, list[int]] = {}
    rooms: list[int] = []
    bins, offsets, used = [], [], []
    for size in sizes:
        counts[size] -= 1
        if not counts[size]:
            kinds.pop()  # the sizes come in decreasing order
        at = bisect.bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            found = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[at]
        else:
            fills = [(size + _filled(c - size, kinds, counts), c) for c in lengths if c >= size]
            costs = [(cost(lengths[bisect.bisect_left(lengths, fill)]) / fill, c) for fill, c in fills]
            found, room = len(used), min(costs)[1]
            used.append(0)
        bins.append(found)
        offsets.append(used[found])
        used[found] += size
        if room > size:
            if room - size not in open_bins:
                open_bins[room - size] = []
                bisect.insort(rooms, room - size)
            open_bins[room - size].append(found)
    return bins, offsets, [lengths[bisect.bisect_left(lengths, u)] for u in used]


def _packer(lengths: tuple[int, ...]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["length", "position"], ascending=[False, True], kind="stable").reset_index(drop=True)
        bins, offsets, final = best_fit(pieces["length"].tolist(), lengths)
        bins = np.asarray(bins, dtype=np.int64)
        final = np.asarray(final, dtype=np.int32)
        return pd.DataFrame(
            {
                "id": pieces["id"],
                "piece": pieces["piece"],
                "start": pieces["start"],
                "length": pieces["length"],
                "bin_id": pieces["group"].to_numpy() * (1 << _BIN_BITS) + bins,
                "bin_length": final[bins],
                "bin_offset": np.asarray(offsets, dtype=np.int32),
            }
        )

    return pack


def pack_documents(
    docs: DataFrame,
    lengths: tuple[int, ...] = LENGTHS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per piece: id, piece (0 on), start and length in tokens, bin_id, bin_length, bin_offset.

    A token is a run without ASCII spaces, and each document ends with one more, its end mark, so null, empty and
    wordless texts have one piece of length 1. Documents longer than the longest permitted length give pieces of
    that length and a rest. Rows that repeat an id are packed each on its own; null ids stay null. Pieces are dealt
    to groups of GROUP_PIECES by their place in a hash order, so groups are bounded whatever ids repeat, and a rerun
    on the same rows gives the same bins. An empty table gives an empty result; other columns are not read.
    """
    lengths = tuple(sorted(lengths))
    longest = lengths[-1]
    thin = docs.select(F.col(id_column).cast("long").alias("id"), (word_count(F.col(text_column)) + 1).alias("size"))
    pieces = written(thin).select("id", "size", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / longest).cast("int"))).alias("piece"))
    start = F.col("piece").cast("long") * longest
    pieces = pieces.select(
        "id", "piece", start.alias("start"), F.least(F.lit(longest), F.col("size") - start).cast("int").alias("length"), F.xxhash64("id", "piece", "size").alias("hash")
    )
    placed = with_position(pieces, ["hash", "id", "piece", "length"], "position")
    placed = placed.withColumn("group", F.floor(F.col("position") / GROUP_PIECES).cast("long"))
    schema = "id long, piece int, start long, length int, bin_id long, bin_length int, bin_offset int"
    # pandas would turn longs with nulls into doubles, so ids travel as strings
    placed = placed.withColumn("id", F.col("id").cast("string"))
    packed = placed.groupBy("group").applyInPandas(_packer(lengths), schema.replace("id long", "id string", 1))
    return packed.withColumn("id", F.col("id").cast("long")).withColumnRenamed("id", id_column)
