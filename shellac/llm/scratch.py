"""Written intermediate tables, global positions and size-checked joins shared by the operators here."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast only if it was measured to have at most this many bytes.
BROADCAST_BYTES = 32 << 20

_OWN_FOLDER: list[str] = []


#: Rows that Spark hands to Python at once; texts are long, so fewer than Spark's default.
PYTHON_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bounds what Python workers hold of a table of texts: at most PYTHON_ROWS rows at once in this session."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= PYTHON_ROWS:
        spark.conf.set(name, str(PYTHON_ROWS))


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


def written(df: DataFrame) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: cuts lineage and survives lost executors. The
    table goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/shellac-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def if_small(df: DataFrame) -> DataFrame:
    """`df` with a broadcast hint if its rows, measured now, have BROADCAST_BYTES at most; else as it is."""
    sizes = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    size = sum(sizes, F.lit(16 * len(df.columns)).cast("long"))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def semi_join(df: DataFrame, ids: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """Rows of `df` whose `column` occurs in `ids` (or, with left_anti, doesn't); `ids` is broadcast only if small."""
    return df.join(if_small(ids), column, how)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front as long as `df` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_position(df: DataFrame, order: list[str], name: str, within: list[str] | None = None) -> DataFrame:
    """Adds `name`, the gapless 0-based position of each row in the order of the columns `order`, without one task
    seeing all rows: a range sort, positions inside each partition, and offsets from the partitions' row counts.
    With `within` (a prefix of `order`), positions start at 0 for each value of those columns."""
    within = within or []
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.withColumn("_part", F.spark_partition_id()).withColumn(
        "_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    )
    ranged = written(ranged)
    # one row for each partition and value of `within` that it holds; each adds to the prefix sums
    spans = ranged.groupBy("_part", *within).agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
    prior = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.select("_part", *within, "_first", F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_before"))
    same = F.lit(True)
    left, right = ranged.alias("l"), offsets.alias("r")
    for c in ["_part", *within]:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    # without `within` a row for each partition
    joined = left.join(F.broadcast(right) if not within else right, same)
    return joined.select(
        *[F.col(f"l.`{c}`") for c in df.columns],
        (F.col("r._before") + F.col("l._row") - F.col("r._first")).cast("long").alias(name),
    )
