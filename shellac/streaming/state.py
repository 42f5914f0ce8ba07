"""Streams with a state for each key: earlier duplicates, entries that expire, deliveries tried again; and files that are new."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shellac.streaming.events import Continued, new_folder, versions


def earlier_duplicates(rows: DataFrame) -> Continued:
    """(recording_id, earlier, previous) of a stream (key, recording_id, place), for events.drained: how many rows of its key
    came before each, and the last of them.

    Rows come in the order of batches and, within one, of place and id. A batch is ranked by key in one window, whatever the
    number of its keys, and goes on from each key's last row of the batches before, which has its count and id; rows with a
    null key are left out. A key's rows of one batch are in one task, which sorts on disk where memory ends."""

    def step(batch: DataFrame, before: DataFrame | None) -> DataFrame:
        order = Window.partitionBy("key").orderBy(F.col("place").asc_nulls_last(), F.col("recording_id").asc_nulls_last())
        new = batch.filter("key IS NOT NULL").select("key", "recording_id", "place")
        earlier, last = (F.row_number().over(order) - 1).cast("long"), F.lead(F.lit(True)).over(order).isNull()
        ranked = new.select("key", "recording_id", earlier.alias("earlier"), F.lag("recording_id").over(order).alias("previous"), last.alias("last"))
        if before is None:
            return ranked
        known = before.filter("last").groupBy("key").agg((F.max("earlier") + 1).alias("n"), F.max_by("recording_id", "earlier").alias("latest"))
        first = F.when(F.col("earlier") == 0, F.col("latest"))
        return ranked.join(known, "key", "left").select("key", "recording_id", (F.col("earlier") + F.coalesce("n", F.lit(0))).alias("earlier"), F.coalesce("previous", first).alias("previous"), "last")

    shape = f"key {rows.schema['key'].dataType.simpleString()}, recording_id string, earlier long, previous string, last boolean"
    return Continued(rows, step, shape, ["recording_id", "earlier", "previous"])


def reads_with_ttl(events: DataFrame, seconds: int = 300, late: str = "1 hour") -> DataFrame:
    """(key, ts, record, value, hit) of each read in a stream (key, ts, record, value): the value stored last before it, if it
    was stored less than `seconds` ago. A row with a value stores it, one without reads.

    Rows later than `late` are dropped. The state of a key is its last entry; it goes once the watermark has passed its end, so
    state doesn't grow with keys that are no longer written. Rows of a batch count in the order of ts and record."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        value, at = state.get if state.exists else (None, None)
        found = []
        for row in pd.concat(list(parts), ignore_index=True).sort_values(["ts", "record"]).itertuples():
            now = row.ts.value // 1000
            if not pd.isna(row.value):
                value, at = float(row.value), now
            else:
                hit = at is not None and now - at < seconds * 1_000_000
                found.append((key[0], row.ts, row.record, value if hit else None, hit))
        if at is not None:
            state.update((value, at))
            ends = (at + seconds * 1_000_000) // 1000 + 1
            state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        if found:
            yield pd.DataFrame(found, columns=["key", "ts", "record", "value", "hit"])

    shape = f"key {events.schema['key'].dataType.simpleString()}, ts timestamp, record long, value double, hit boolean"
    keyed = events.withWatermark("ts", late).filter("key IS NOT NULL").groupBy("key")
    return keyed.applyInPandasWithState(step, shape, "value double, at long", "append", GroupStateTimeout.EventTimeTimeout)


def retried(deliveries: DataFrame, retries: int = 3) -> DataFrame:
    """(key, record, attempt, status) of a stream of results (key, record, ok): each key's results in the order of record are
    its attempts. A failed one is to `retry` until there were `retries` of them, then `given_up`; a good one is `delivered`;
    what comes after either is `ignored`. The state of a key is a number and a mark."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempts, over = state.get if state.exists else (0, False)
        found = []
        for row in pd.concat(list(parts), ignore_index=True).sort_values("record").itertuples():
            attempts += 1
            status = "ignored" if over else "delivered" if row.ok else "given_up" if attempts > retries else "retry"
            over = over or status in ("delivered", "given_up")
            found.append((key[0], row.record, attempts, status))
        state.update((attempts, over))
        yield pd.DataFrame(found, columns=["key", "record", "attempt", "status"])

    shape = f"key {deliveries.schema['key'].dataType.simpleString()}, record long, attempt long, status string"
    keyed = deliveries.filter("key IS NOT NULL").groupBy("key")
    return keyed.applyInPandasWithState(step, shape, "attempts long, over boolean", "append", GroupStateTimeout.NoTimeout)


def new_files(listing: DataFrame, folder: str | None = None, source: str = "listing") -> DataFrame:
    """(path, size, mtime, change) of a stream of listed files (path, size, mtime): those that are new, or differ from what was
    listed last, over all batches and all calls with this folder.

    The table of what is known has a version for each batch in the folder, and each batch goes on from the last complete one,
    so later calls do as well. Changes are written before the version: a batch that is repeated after a failure either writes
    them again or, if its version was complete, finds none. Of a path listed twice in a batch the latest counts. `source`
    names the stream's own progress, of which a folder can have several."""
    spark, folder = listing.sparkSession, folder or new_folder(listing.sparkSession)
    shape = listing.select("path", "size", "mtime").schema

    def put(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        last = (versions(session, f"{folder}/known") or [-1])[-1]
        before = session.read.schema(shape).parquet(f"{folder}/known/{last}") if last >= 0 else session.createDataFrame([], shape)
        now = batch.groupBy("path").agg(F.max_by(F.struct("size", "mtime"), F.struct("mtime", "size")).alias("now"))
        both = before.select("path", F.struct("size", "mtime").alias("was")).join(now, "path", "full")
        change = F.when(F.col("was").isNull(), "new").when(~F.col("now").eqNullSafe(F.col("was")), "modified")
        changes = both.filter("now IS NOT NULL").select("path", "now.*", change.alias("change")).filter("change IS NOT NULL")
        changes.write.mode("overwrite").parquet(f"{folder}/changes/{last + 1}")
        both.select("path", F.coalesce("now", "was").alias("last")).select("path", "last.*").write.mode("overwrite").parquet(f"{folder}/known/{last + 1}")

    writer = listing.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/state-{source}")
    writer.trigger(availableNow=True).start().awaitTermination()
    done = versions(spark, f"{folder}/changes")
    schema = shape.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", change string"
    return spark.read.schema(schema).parquet(*[f"{folder}/changes/{v}" for v in done]) if done else spark.createDataFrame([], schema)
