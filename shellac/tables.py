"""Written intermediate tables, global positions and size-checked joins."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast only if it was measured to have at most this many bytes.
BROADCAST_BYTES = 32 << 20

_OWN_FOLDER: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset, as in tests on a local master, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_FOLDER:
        _OWN_FOLDER.append("file://" + tempfile.mkdtemp(prefix="spark-shellac-"))
    return _OWN_FOLDER[0]


#: Spark's setting by which a query's shuffle files go once it is over; else they stay until the driver collects garbage.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, before)


def _place(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: cuts lineage and survives lost executors. The
    table goes when the application ends, or by `dropped`; the shuffle files that it took go at once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/shellac-{uuid.uuid4().hex}"
    with _shuffles_freed(spark):
        df.write.parquet(path)
    place, system = _place(spark, path)
    system.deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables as `written` gave them; nothing may read them any more, nor what was made from them and isn't written."""
    for table in tables:
        place, system = _place(table.sparkSession, table._written_to)
        system.delete(place, True)


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row: its texts, and 16 for each column."""
    sizes = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    return sum(sizes, F.lit(16 * len(df.columns)).cast("long"))


def if_small(df: DataFrame) -> DataFrame:
    """`df` with a broadcast hint if its rows, measured now, have BROADCAST_BYTES at most; else as it is."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes(df))).first()[0] or 0) <= BROADCAST_BYTES else df


def with_position(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds `name`, the gapless 0-based position of each row in the order of the columns `order`, without one task
    seeing all rows: a range sort, places inside each partition, and offsets from the partitions' row counts, one row each."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(offsets), "_part").select(*[f"`{c}`" for c in df.columns], (F.col("_before") + F.col("_row")).cast("long").alias(name))
