"""Licence scan by canonical digests: whole texts, their sections and their lines against a table of known digests.

Canonical form: lower case, equivalent spellings made one, everything but letters and digits a space, and lines left
out that only state a copyright or name the licence. Line breaks don't matter inside a section, which blank lines end.
The digest of a whole text is hash-joined to the known licences' digests; so are the digests of every run of as many
sections as some known licence has, which finds licences inside longer texts, and those of single lines, for notices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shellac.llm.license_texts import DIGESTS, LICENSES, NOTICES, TITLES
from shellac.llm.scratch import if_small, written

#: Spellings that count as equal, as regular expressions on lower-case text; $1 is the first group.
EQUIVALENT = (
    ("\\(c\\)|©|&copy;", " copyright "),
    ("licence", "license"),
    ("https?://", ""),
    ("is(e|ed|es|ing|ation|ations|ational)\\b", "iz$1"),
    ("\\b(colo|favo|labo|hono|behavio)ur", "$1r"),
    ("(judg|acknowledg)ement", "$1ment"),
    ("(cata|ana)logue", "$1log"),
    ("sub-licens", "sublicens"),
    ("non[- ](commercial|infringement|exclusive)", "non$1"),
    ("per cent\\b", "percent"),
    ("whilst", "while"),
    ("fulfil\\b", "fulfill"),
    ("wilful", "willful"),
)
#: Lines that only state a copyright.
_NOTICE_OF_RIGHTS = "^copyright copyright|^(?:copyright )+(?:\\d{4}|yyyy|year|name)|^all rights reserved$"


def _clean(text: Column) -> Column:
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, one in EQUIVALENT:
        out = F.regexp_replace(out, pattern, one)
    return F.regexp_replace(out, "[^\\p{L}\\p{N}\n]+", " ")


def _lines(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), lambda line: F.trim(line))
    # the plain test first: few lines begin like a notice
    notice = lambda line: (line.startswith("copyright ") | (line == "all rights reserved")) & line.rlike(_NOTICE_OF_RIGHTS)
    return F.filter(lines, lambda line: (line != "") & ~notice(line) & ~line.isin(*TITLES))


def canonical_lines(text: Column) -> Column:
    """Canonical lines of a text, without empty, copyright and title lines; a null text gives none."""
    return _lines(_clean(text))


def _sections(clean: Column) -> Column:
    """Sections of a cleaned text, each as one line; blank lines part them."""
    joined = F.transform(F.split(clean, "\n\\s*\n"), lambda section: F.array_join(_lines(section), " "))
    return F.filter(joined, lambda section: section != "")


def _sha(text: Column) -> Column:
    return F.sha2(text, 256)


def _run_digest(digests: Column) -> Column:
    """Digest of a run of sections, from theirs."""
    return _sha(F.array_join(digests, ","))


def _section_digests(clean: Column) -> Column:
    return F.transform(_sections(clean), lambda section: F.substring(_sha(section), 1, 16))


def describe(texts: DataFrame) -> DataFrame:
    """(license_id, digest, sections, section_digest) of whole licences (license_id, text): rows of a known table."""
    digest = _sha(F.array_join(canonical_lines(F.col("text")), " "))
    parts = texts.select("license_id", digest.alias("digest"), _section_digests(_clean(F.col("text"))).alias("parts"))
    return parts.select("license_id", "digest", F.size("parts").alias("sections"), _run_digest(F.col("parts")).alias("section_digest"))


def known_licenses(spark: SparkSession) -> DataFrame:
    """The built-in table of whole licences and notices."""
    texts = spark.createDataFrame([*LICENSES, *NOTICES], "license_id string, text string")
    rows = describe(texts)
    return rows.unionAll(spark.createDataFrame(list(DIGESTS), rows.schema)) if DIGESTS else rows


def _runs(parts: Column, sections: list[int]) -> Column:
    """Digests of all runs of as many sections as given."""
    none = F.array().cast("array<string>")

    def of(k: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(parts) - k + 1), lambda i: _run_digest(F.slice(parts, i, F.lit(k))))
        return F.when(F.size(parts) >= k, runs).otherwise(none)

    return F.concat(none, *map(of, sections))


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, digest (of the canonical whole text), license_id (if the whole text is a known licence
    or notice, else null), embedded (ids of licences that are some sections of it, sorted, joined by commas; empty
    without any), notices (ids of known one-section licences and notices that are one of its lines, likewise).

    `known` has license_id, digest, sections and section_digest (see describe) and defaults to the built-in table; if a
    digest has several ids, the least counts as license_id. Nulls and texts without letters and digits have the digest
    of the empty text and no licence. Repeated rows and null ids stay; an empty table gives an empty result; other
    columns are not read. Only the numbers of sections that known licences have reach the driver, and each text gives
    as many digests as it has lines and sections, times those numbers.
    """
    known = written(known if known is not None else known_licenses(docs.sparkSession))
    empty = _sha(F.lit(""))
    whole = known.filter(F.col("digest") != empty).groupBy("digest").agg(F.min("license_id").alias("license_id"))
    counts = [r["sections"] for r in known.filter("sections > 0").select("sections").distinct().orderBy("sections").collect()]
    line = known.filter("sections = 1").select(F.lit("line").alias("kind"), F.col("digest").alias("unit"), "license_id")
    part = known.filter("sections > 0").select(F.lit("part").alias("kind"), F.col("section_digest").alias("unit"), "license_id")

    # what occurs in a text, for each distinct text that has something
    text = F.col(text_column).cast("string")
    form = _sha(F.coalesce(text, F.lit(""))).alias("form")
    lines = F.transform(_lines(F.col("clean")), lambda x: F.struct(F.lit("line").alias("kind"), _sha(x).alias("unit")))
    runs = F.transform(F.col("runs"), lambda x: F.struct(F.lit("part").alias("kind"), x.alias("unit")))
    # the cleaned text and the sections as columns, so that they are made once and not for each line and run
    units = docs.select(form, _clean(text).alias("clean")).select("form", lines.alias("lines"), _section_digests(F.col("clean")).alias("parts"))
    units = units.select("form", "lines", _runs(F.col("parts"), counts).alias("runs"))
    units = units.select("form", F.inline(F.array_distinct(F.concat("lines", runs))))
    found = units.join(if_small(line.unionAll(part)), ["kind", "unit"]).groupBy("form")

    def ids(kind: str) -> Column:
        return F.array_join(F.sort_array(F.collect_set(F.when(F.col("kind") == kind, F.col("license_id")))), ",")

    found = written(found.agg(ids("part").alias("embedded"), ids("line").alias("notices")))
    rows = docs.select(F.col(id_column).alias("id"), _sha(F.array_join(canonical_lines(text), " ")).alias("digest"), form)
    rows = rows.join(if_small(whole), "digest", "left").join(if_small(found), "form", "left")
    return rows.select(F.col("id").alias(id_column), "digest", "license_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("embedded", "notices")])


def _sql_literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle_sql() -> str:
    """The same scan in DuckDB's SQL."""

    def clean(text: str) -> str:
        out = f"lower(coalesce({text}, ''))"
        for pattern, one in EQUIVALENT:
            out = f"regexp_replace({out}, {_sql_literal(pattern)}, {_sql_literal(one.replace('$', chr(92)))}, 'g')"
        return f"regexp_replace({out}, '[^\\p{{L}}\\p{{N}}\n]+', ' ', 'g')"

    titles = ", ".join(map(_sql_literal, TITLES))

    def lines(text: str) -> str:
        out = f"list_transform(string_split({text}, chr(10)), lambda x: trim(x))"
        return f"list_filter({out}, lambda x: x <> '' AND NOT regexp_matches(x, {_sql_literal(_NOTICE_OF_RIGHTS)}) AND x NOT IN ({titles}))"

    sections = f"list_filter(list_transform(string_split_regex(clean, '\\n\\s*\\n'), lambda s: array_to_string({lines('s')}, ' ')), lambda s: s <> '')"
    parts = f"list_transform({sections}, lambda s: left(sha256(s), 16))"
    texts = ", ".join(f"({_sql_literal(k)}, {_sql_literal(t)})" for k, t in [*LICENSES, *NOTICES])
    long = "".join(f" UNION ALL SELECT '{k}', '{d}', {n}, '{s}'" for k, d, n, s in DIGESTS)
    return f"""
WITH texts AS (SELECT license_id, {clean("t")} AS clean FROM (VALUES {texts}) v(license_id, t)),
known AS (
  SELECT license_id, sha256(array_to_string({lines("clean")}, ' ')) AS digest, len({parts}) AS sections,
    sha256(array_to_string({parts}, ',')) AS section_digest FROM texts{long}
), whole AS (SELECT digest, min(license_id) AS license_id FROM known GROUP BY 1),
docs AS (SELECT row_number() OVER () AS num, doc_id, {lines("clean")} AS lines, {parts} AS parts FROM (SELECT doc_id, {clean("text")} AS clean FROM documents)),
lined AS (
  SELECT num, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
  FROM (SELECT num, sha256(unnest(lines)) AS digest FROM docs) JOIN known USING (digest) WHERE sections = 1 GROUP BY 1
), runs AS (
  SELECT num, sha256(array_to_string(list_slice(parts, spot, spot + k - 1), ',')) AS section_digest
  FROM (SELECT num, parts, k, unnest(range(1, CAST(len(parts) - k + 2 AS BIGINT))) AS spot FROM docs, (SELECT DISTINCT sections AS k FROM known) WHERE len(parts) >= k)
), inside AS (
  SELECT num, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS embedded FROM runs JOIN known USING (section_digest) GROUP BY 1
), listed AS (SELECT num, doc_id, len(lines) AS n, sha256(array_to_string(lines, ' ')) AS digest FROM docs)
SELECT doc_id, digest, license_id, coalesce(embedded, '') AS embedded, coalesce(notices, '') AS notices
FROM listed LEFT JOIN lined USING (num) LEFT JOIN inside USING (num) LEFT JOIN whole USING (digest)
"""
