"""A training corpus from `documents`, stage by stage: each stage's result is written and read as the next one's docs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shellac.llm import exact, langid, mixing, neardup, packing
from shellac.llm.scratch import free_name, if_small, semi_join, written
from shellac.ship import ship

#: Identified languages that the corpus is meant to have; None takes every language learned.
LANGUAGES: tuple[str, ...] | None = None


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with a number for each row, written so that it stays the same, and that column's name."""
    row = free_name(docs, "row_key")
    return written(docs.withColumn(row, F.monotonically_increasing_id())), row


def _placed(docs: DataFrame) -> tuple[DataFrame, str]:
    """`docs` with a number for each row, and that column's name, without a copy of the texts where `docs` is a Parquet table
    as it was read: there a row is known by its file and its place in it. Other tables are written, as by _keyed, and so are
    those that have a file twice."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        return _keyed(docs)
    row, file, number = (free_name(docs, name) for name in ("row_key", "row_file", "file_number"))
    try:
        place = docs.metadataColumn("_metadata")
        placed = docs.select("*", place.getField("row_index").alias(row), place.getField("file_path").alias(file))
    except AnalysisException:
        return _keyed(docs)
    files = written(placed.groupBy(file).agg(F.count(F.lit(1)).alias("rows"), F.max(row).alias("last")))
    if not files.filter("rows != last + 1").isEmpty():
        return _keyed(docs)
    # a row for each file
    numbers = files.select(file, F.row_number().over(Window.orderBy(file)).cast("long").alias(number))
    key = F.shiftleft(F.col(number), 33) + F.col(row)
    return placed.join(if_small(numbers), file).select(*[F.col(f"`{c}`") for c in docs.columns], key.alias(row)), row


def _one_of_each(keyed: DataFrame, row: str, grouped: DataFrame, group: str) -> DataFrame:
    """Of the rows in each group (`grouped` has the row's number as doc_id, and `group`), the one of least doc_id, null
    last, and of rows that repeat an id, the first."""
    ids = keyed.select(F.col(row).alias("row"), F.col("doc_id").alias("id"))
    named = grouped.select(F.col("doc_id").alias("row"), F.col(group).alias("group")).join(ids, "row")
    first = F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first")
    # against the rows that stay, not the groups: a large group is no single key then
    stay = named.groupBy("group").agg(first).select("first.row")
    dropped = written(named.select("row").join(stay, "row", "left_anti").select(F.col("row").alias(row)))
    return semi_join(keyed, dropped, row, "left_anti").drop(row)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with an identified language and sets `lang` to it; texts without any letter go.

    Learns from the labels of documents that are not held out (see langid.identify_languages). If there are none to
    learn from, every text with a letter stays, with its `lang` as it is, whatever LANGUAGES says."""
    ship(spark)
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    labelled = docs.filter(~held_out).select("text", F.col("lang").alias("label"))
    model = langid.train_language_model(labelled)
    if model is None:
        return docs.filter(F.col("text").cast("string").rlike("\\p{L}"))
    found = langid.language_of(model, F.col("text").cast("string"))["lang_pred"]
    tagged = docs.withColumn("lang", found)
    wanted = F.col("lang") != langid.UNKNOWN
    if LANGUAGES is not None:
        wanted = wanted & F.col("lang").isin(*LANGUAGES)
    return tagged.filter(wanted).select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, that of least doc_id, of those whose texts are equal up to white space, a null counting as empty.

    Rows are told apart by a number of their own: of rows that repeat an id and a text one stays, and so it does of
    rows without an id (null ids come last). Texts of any length are compared whole; no rows give no rows."""
    ship(spark)
    keyed, row = _keyed(docs)
    found = exact.exact_duplicates(keyed, id_column=row).withColumnRenamed(row, "doc_id")
    return _one_of_each(keyed, row, found.filter("group_size > 1"), "keep_id").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row, that of least doc_id, of each group linked by similar sets of five-word shingles.

    Rows are told apart by a number of their own, as in exact_dedup. Texts without words link with nothing and stay."""
    ship(spark)
    keyed, row = _keyed(docs)
    found = neardup.near_duplicates(keyed, words=5, percent=80, id_column=row).withColumnRenamed(row, "doc_id")
    return _one_of_each(keyed, row, found, "component_id").select(*docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. The document at a source's cut comes whole, so each source is at
    most one document above its budget.

    Texts that are null or without words have no share and go. Rows are told apart by a number of their own, so rows
    that repeat an id, or have none, are taken each as often as its own place in the mix says."""
    ship(spark)
    keyed, row = _placed(docs)
    times = free_name(keyed, "times")
    taken = mixing.mix_sources(keyed, key_column=row).filter("taken > 0")
    taken = taken.select(row, F.ceil(F.col("taken") / F.col("size")).cast("int").alias(times))
    copies = keyed.join(taken, row)
    return copies.withColumn(row, F.explode(F.sequence(F.lit(1), F.col(f"`{times}`")))).select(*[copies[f"`{c}`"] for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences; see packing.pack_documents. Null and empty texts have one piece, the end
    mark; rows that repeat an id are packed each on its own."""
    ship(spark)
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_to_weights", mix_to_weights),
    ("pack", pack),
]

#: Language identification, near-duplicates and packing have no form in SQL; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each but the last written to the shared folder. An empty table gives no pieces; columns
    beside those of the contract pass through the stages whatever their names."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs)
    return docs
