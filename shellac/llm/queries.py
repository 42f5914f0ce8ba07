"""The numbered queries: each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shellac.llm import embeddings, exact, htmltext, langid, licenses, mixing, neardup, packing, pii, sharding, spelling, urls, whitening
from shellac.ship import ship

#: Setting of the session with the secret key of op4; the test tables, whose entities are invented, go without.
KEY_SETTING, TEST_KEY = "spark.shellac.surrogateKey", "for invented data only"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=8)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(_table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_personal_data(_table(spark, sf_dir, "documents"), key=spark.conf.get(KEY_SETTING, TEST_KEY))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.similar_vectors(_table(spark, sf_dir, "embeddings"), cosine=0.98)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), most_repeats=3)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_main_text(_table(spark, sf_dir, "pages"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), components=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sharding,
        op2_packing,
        op3_language_id,
        op4_pii,
        op5_url_filter,
        op6_license_scan,
        op7_minhash_near_dedup,
        op8_embedding_near_dedup,
        op9_exact_dedup,
        op10_mixing,
        op11_spelling_variants,
        op12_html_extraction,
        op13_whitening,
    )
}

_EXACT_SQL = r"""
WITH norm AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept,
  sha256(norm) AS text_sha256
FROM norm WINDOW g AS (PARTITION BY norm)
"""

ORACLE_SQL: dict[str, str] = {
    "op6_license_scan": licenses.oracle_sql(),
    "op9_exact_dedup": _EXACT_SQL,
}
