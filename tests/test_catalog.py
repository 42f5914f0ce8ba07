"""Tag functions on literal rows, and every catalog query against DuckDB on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from shellac.functions import tags
from shellac.plans import registry as queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_tag_functions(spark):
    row = spark.range(1).select(
        F.array_join(tags.split_artists(F.lit(" A, B ,,A")), "|").alias("artists"),
        tags.clean_title(F.lit("  a   b [2001]")).alias("title"),
        tags.sort_name(F.lit("The The")).alias("same"),
        tags.sort_name(F.lit("The Beatles")).alias("moved"),
        tags.word_jaccard(F.lit("a b"), F.lit("B c")).alias("jaccard"),
        tags.levenshtein_similarity(F.lit("abc"), F.lit("abd")).alias("lev"),
    ).first()
    assert row.artists == "A|B" and row.title == "a b (2001)"
    assert row.same == "The The" and row.moved == "Beatles, The"
    assert row.jaccard == pytest.approx(1 / 3) and row.lev == pytest.approx(2 / 3)


@pytest.mark.parametrize("name", sorted(queries.PAIRS))
def test_against_duckdb(spark, duck, name):
    mine, theirs = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLE_SQL[name])
    assert sorted(mine.columns) == sorted(theirs.columns)
    columns = sorted(mine.columns)
    rows = [tuple(str(r[c]) for c in columns) for r in mine.collect()]
    order = [theirs.columns.index(c) for c in columns]
    assert sorted(rows) == sorted(tuple(str(r[i]) for i in order) for r in theirs.fetchall())


@pytest.mark.parametrize("name", sorted(queries.WITHOUT_SQL))
def test_without_sql(spark, name):
    """What SQL can't express runs over whole tables; its rules are tested against brute force beside the operators."""
    rows = queries.QUERIES[name](spark, SF).collect()
    assert len(rows) == len({tuple(r)[:2] for r in rows})
    assert len(rows) > (4000 if name == "k17_genre_predictions" else 300 if name == "k18_mood_predictions" else 0)
