"""Text similarities that take a worker in Python, and similarities as functions of SQL by name."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from shellac.ship import ship


def transposition_distance(a: str, b: str) -> int:
    """Edits between two texts, where swapping two letters is one, with letters put in or left out between them one more each."""
    table, last_row = [list(range(len(b) + 1))], {}
    for i, x in enumerate(a, 1):
        row, last_equal = [i], 0
        for j, y in enumerate(b, 1):
            cost = min(table[i - 1][j - 1] + (x != y), row[-1] + 1, table[i - 1][j] + 1)
            k = last_row.get(y, 0)
            if k and last_equal:
                cost = min(cost, table[k - 1][last_equal - 1] + (i - k) + (j - last_equal) - 1)
            if x == y:
                last_equal = j
            row.append(cost)
        table.append(row)
        last_row[x] = i
    return table[-1][-1]


def _distances(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = zip(a, b, strict=True)
    return pd.Series([None if x is None or y is None else transposition_distance(x, y) for x, y in pairs], dtype="Int64")


def damerau_similarity(a: Column, b: Column) -> Column:
    """1 less the share of edits, swaps of letters among them, in the longer text; 1 for two empty texts, null for a null one.

    Equal texts don't go to the workers' function, which takes the product of the lengths for a pair: filter pairs before."""
    ship(SparkSession.getActiveSession())
    longest = F.greatest(F.length(a), F.length(b))
    # workers get nulls for pairs of equal texts
    apart = F.pandas_udf(_distances, "long")(F.when(a != b, a), F.when(a != b, b))
    return F.when(a == b, 1.0).when(a.isNotNull() & b.isNotNull(), 1 - apart / longest)


#: SQL bodies of functions of two texts; all null for a null text.
SQL_BODIES = {
    "levenshtein_similarity": "CASE WHEN greatest(length(a), length(b)) = 0 THEN 1D ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END",
    "word_jaccard": "CASE WHEN lower(a) = lower(b) THEN 1D WHEN a IS NOT NULL AND b IS NOT NULL THEN "
    "size(array_intersect(split(lower(a), ' '), split(lower(b), ' '))) / size(array_union(split(lower(a), ' '), split(lower(b), ' '))) END",
    "damerau_similarity": "CASE WHEN a = b THEN 1D ELSE 1 - transposition_distance(a, b) / greatest(length(a), length(b)) END",
}


def register_functions(spark: SparkSession) -> list[str]:
    """Makes the functions of SQL_BODIES, and transposition_distance, known to the session's SQL; returns their names."""
    ship(spark)
    spark.udf.register("transposition_distance", F.pandas_udf(_distances, "long"))
    for name, body in SQL_BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a STRING, b STRING) RETURNS DOUBLE RETURN {body}")
    return ["transposition_distance", *SQL_BODIES]
