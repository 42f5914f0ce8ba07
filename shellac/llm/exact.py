"""Exact duplicates by a Golomb-coded exchange of fingerprints.

Each partition of the documents sorts its distinct fingerprints and sends each owner (a range of the fingerprint
space) its share as Rice-coded gaps. Owners answer with a bitmap for each list: set where another list or the same
partition has the fingerprint again. Only the texts of such suspects are shuffled, and compared byte for byte.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shellac.llm.scratch import semi_join, written

#: Bits of a fingerprint. Clashes of different texts only make more suspects.
FINGERPRINT_BITS = 48
#: Fingerprints that one owner is meant to hold.
OWNER_ROWS = 1_000_000

SPACES = "[\\x20\\x09-\\x0D]+"
_CODED = "source long, owner int, count int, rice int, gaps binary, repeated binary"


def rice_encode(gaps: np.ndarray, rice: int) -> bytes:
    """Rice code (Golomb code of divisor 2**rice) of non-negative gaps: unary quotients, then `rice` low bits each."""
    quotients = (gaps >> np.uint64(rice)).astype(np.int64)
    stops = np.cumsum(quotients + 1) - 1
    unary = np.zeros(int(stops[-1]) + 1 if len(gaps) else 0, dtype=np.uint8)
    unary[stops] = 1
    low = ((gaps[:, None] >> np.arange(rice, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    return np.packbits(np.concatenate([unary, low])).tobytes()


def rice_decode(code: bytes, count: int, rice: int) -> np.ndarray:
    """The `count` gaps of a code."""
    if count == 0:
        return np.empty(0, dtype=np.uint64)
    bits = np.unpackbits(np.frombuffer(code, dtype=np.uint8))
    stops = np.flatnonzero(bits)[:count]
    quotients = np.diff(stops, prepend=-1) - 1
    low = bits[stops[-1] + 1 : stops[-1] + 1 + count * rice].reshape(count, rice).astype(np.uint64)
    rest = (low << np.arange(rice, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return (quotients.astype(np.uint64) << np.uint64(rice)) + rest


def _sender(owners: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    span = (1 << FINGERPRINT_BITS) // owners + 1

    def send(batches):
        parts = [batch.column(0).to_numpy() for batch in batches if batch.num_rows]
        if not parts:
            return
        prints, times = np.unique(np.concatenate(parts).astype(np.uint64), return_counts=True)
        owner = (prints // np.uint64(span)).astype(np.int64)
        rows = []
        for o in np.unique(owner):
            low, high = np.searchsorted(owner, [o, o + 1])
            own = prints[low:high] - np.uint64(o * span)
            gaps = np.diff(own, prepend=np.uint64(0))
            rice = max(0, int(math.log2(max(1.0, float(own[-1]) / len(own) * math.log(2)))))
            rows.append((TaskContext.get().partitionId(), int(o), len(own), rice, rice_encode(gaps, rice), np.packbits(times[low:high] > 1).tobytes()))
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["source", "owner", "count", "rice", "gaps", "repeated"])

    return send


def _fingerprints(row: pd.Series | dict) -> np.ndarray:
    return np.cumsum(rice_decode(row["gaps"], row["count"], row["rice"]), dtype=np.uint64)


def _answer(lists: pd.DataFrame) -> pd.DataFrame:
    """An owner's bitmap for each list that it got."""
    rows = lists.to_dict("records")
    prints = [_fingerprints(row) for row in rows]
    every, where, times = np.unique(np.concatenate(prints), return_inverse=True, return_counts=True)
    again = times > 1
    repeated = np.concatenate([np.unpackbits(np.frombuffer(row["repeated"], dtype=np.uint8), count=row["count"]) for row in rows])
    np.logical_or.at(again, where[repeated.astype(bool)], True)
    flags = np.split(again[where], np.cumsum([len(x) for x in prints])[:-1])
    return pd.DataFrame({"source": [r["source"] for r in rows], "owner": [r["owner"] for r in rows], "bitmap": [np.packbits(x).tobytes() for x in flags]})


def _marked(span_of: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A source's suspects: its coded list against the owner's bitmap."""
    span = (1 << FINGERPRINT_BITS) // span_of + 1

    def mark(batches):
        for batch in batches:
            for row in batch.to_pylist():
                bits = np.unpackbits(np.frombuffer(row["bitmap"], dtype=np.uint8), count=row["count"]).astype(bool)
                prints = _fingerprints(row)[bits] + np.uint64(row["owner"] * span)
                yield pa.RecordBatch.from_arrays([pa.array(prints.astype(np.int64))], ["print"])

    return mark


def normalised(text) -> F.Column:
    """Null as empty; each run of ASCII spaces as one space."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document, dropped ones too: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Texts are equal if identical after each run of ASCII spaces became one space; null counts as empty. The row with
    the least id of a group stays (null ids last; of rows that repeat both id and text one stays). Empty tables give an empty result; other columns are not read.
    """
    source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    norm = source.select("id", normalised(F.col("text")).alias("norm"))
    thin = norm.select(
        "id", F.shiftrightunsigned(F.xxhash64("norm"), 64 - FINGERPRINT_BITS).alias("print"), F.sha2("norm", 256).alias("sha")
    )
    thin = written(thin.withColumn("row", F.monotonically_increasing_id()))

    owners = max(1, math.ceil(thin.count() / OWNER_ROWS))
    coded = written(thin.select("print").mapInArrow(_sender(owners), _CODED))
    bitmaps = coded.groupBy("owner").applyInPandas(_answer, "source long, owner int, bitmap binary")
    answered = coded.select("source", "owner", "count", "rice", "gaps").join(bitmaps, ["source", "owner"])
    suspects = answered.mapInArrow(_marked(owners), "print long").distinct()

    # suspects' texts, compared whole: the group-by is on the bytes themselves
    named = written(thin.join(suspects, "print", "left_semi").select("id").distinct())
    texts = semi_join(source, named.filter("id IS NOT NULL"), "id")
    if not named.filter("id IS NULL").isEmpty():
        texts = texts.unionAll(source.filter("id IS NULL"))
    whole = texts.select("id", normalised(F.col("text")).alias("norm"))
    found = whole.groupBy("norm").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    found = found.select(F.sha2("norm", 256).alias("sha"), "members")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "row")).alias("first")
    # rows are grouped before the join, and the result is written, so that Spark can split a large group in the joins
    found = written(thin.groupBy("sha").agg(first).join(found, "sha"))

    out = thin.join(found, "sha", "left")
    alone = F.col("members").isNull()
    return out.select(
        F.col("id").alias(id_column),
        F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
        F.coalesce("members", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("first.row") == F.col("row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
