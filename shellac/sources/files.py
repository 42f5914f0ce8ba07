"""Catalogs, inventories, training rows and edit plans from files, and reports as files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shellac.operators.edits import OPERATIONS, Edit

#: Suffixes of the files that an inventory lists.
AUDIO = ("flac", "mp3", "mp4", "m4a", "wav", "ogg", "opus", "wma", "aac", "aiff")


def scan_inventory(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = AUDIO) -> DataFrame:
    """(path, size, mtime) of all files below a folder with one of the suffixes, whatever the case; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    suffix = F.lower(F.regexp_extract("path", "\\.([^./]+)$", 1))
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")).filter(suffix.isin(*suffixes))


def scan_modified(inventory: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of an inventory that are new or modified by `changes` (see curation.detect_changes)."""
    return inventory.join(changes.filter(F.col("change").isin("new", "modified")).select("path"), "path", "left_semi")


def read_catalog(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Recordings stored as JSON lines or Parquet, with the schema given, so that nothing is inferred."""
    return spark.read.schema(schema).json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.schema(schema).parquet(path)


def read_training(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(text, genre) from `csv` with a head or `json` lines; broken lines and rows without text or label go. A list of
    genres, in JSON, gives its first."""
    if kind == "csv":
        rows = spark.read.csv(path, header=True, schema="text string, genre string", mode="DROPMALFORMED", multiLine=True, escape='"', enforceSchema=False)
    elif kind == "json":
        rows = spark.read.json(path, schema="text string, genre string, genres array<string>", mode="DROPMALFORMED")
        rows = rows.select("text", F.coalesce("genre", F.get("genres", F.lit(0))).alias("genre"))
    else:
        raise ValueError(f"unknown kind of training file: {kind}")
    return rows.filter((F.trim("text") != "") & (F.trim("genre") != ""))


def read_edits(spark: SparkSession, path: str, operations: tuple[str, ...] = OPERATIONS) -> DataFrame:
    """(name, field, operation, pattern, value, conflict_strategy, condition) of an edit plan in JSON: a list of edits, or an
    object with such a list as `operations`. condition is a JSON object, null for none; the strategy is replace unless given,
    and an unknown operation is an error when the row is read."""
    edit = "name string, field string, operation string, pattern string, value string, conflict_strategy string, condition string"
    cells = ", ".join(c.replace(" ", ": ") for c in edit.split(", "))
    plan = spark.read.json(path, schema=f"{edit}, operations array<struct<{cells}>>", multiLine=True)
    own = F.array(F.struct(*[c.split(" ")[0] for c in edit.split(", ")]))
    plan = plan.select(F.inline(F.coalesce("operations", own)))
    known = F.when(F.col("operation").isin(*operations), F.col("operation"))
    checked = F.coalesce(known, F.raise_error(F.concat(F.lit("unknown operation: "), F.coalesce("operation", F.lit("none")))).cast("string"))
    return plan.withColumn("operation", checked).withColumn("conflict_strategy", F.coalesce("conflict_strategy", F.lit("replace")))


def load_edits(spark: SparkSession, path: str) -> list[Edit]:
    """The edits of a plan (see read_edits), a small file, for edits.apply_edits, with their conditions. Copies read the column
    that is their value; a rename's value is the old one, its pattern the new."""
    found = []
    for row in read_edits(spark, path).collect():
        value = json.loads(row.value) if row.value and row.value.startswith(("[", "{")) else row.value
        where = tuple((json.loads(row.condition) if row.condition else {}).items())
        changes = {"copy": dict(source=row.value), "rename": dict(old=value, value=row.pattern)}.get(row.operation, dict(value=value, pattern=row.pattern or ""))
        found.append(Edit(row.name or f"{row.operation} {row.field}", row.field, row.operation, strategy=row.conflict_strategy, where=where, **changes))
    return found


def long_form(stats: DataFrame) -> DataFrame:
    """(key, value) of each column of each row of statistics, as text; nulls stay null."""
    cells = [F.struct(F.lit(c).alias("key"), F.col(f"`{c}`").cast("string").alias("value")) for c in stats.columns]
    return stats.select(F.inline(F.array(*cells)))


def export_stats(stats: DataFrame, folder: str, kind: str) -> None:
    """Statistics in long form as `json`, `csv` with a head, or `txt` lines of key and value."""
    rows = long_form(stats)
    if kind == "txt":
        rows.select(F.concat_ws(": ", "key", F.coalesce("value", F.lit("")))).write.text(folder)
    elif kind == "csv":
        rows.write.csv(folder, header=True)
    elif kind == "json":
        rows.write.json(folder)
    else:
        raise ValueError(f"unknown kind of report: {kind}")


def export_plan(plan: DataFrame, folder: str) -> None:
    """A plan (see layout.plan_moves) as JSON lines; its conflict is nested: whether there is one, and the wanted target."""
    plan.select("recording_id", F.col("final").alias("target"), F.struct(F.col("conflict").alias("found"), F.col("target").alias("wanted")).alias("conflict")).write.json(folder)


def write_manifest(inventory: DataFrame, folder: str, snapshot: str, root: str = "") -> None:
    """A snapshot of an inventory (path, size, mtime): paths below `root`, and `kind` audio, cover or other. Written to
    the partition of its name."""
    suffix = F.lower(F.regexp_extract("path", "\\.([^./]+)$", 1))
    kind = F.when(suffix.isin(*AUDIO), "audio").when(suffix.isin("jpg", "jpeg", "png"), "cover").otherwise("other")
    below = F.when(F.startswith("path", F.lit(root)), F.substr("path", F.lit(len(root) + 1))).otherwise(F.col("path"))
    inventory.select(below.alias("path"), "size", "mtime", kind.alias("kind")).write.parquet(f"{folder}/snapshot={snapshot}")
