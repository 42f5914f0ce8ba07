"""URL filter: host and path rules, else logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import zlib

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM_SIZES = (2, 3, 4, 5)
BUCKETS = 1 << 15
PENALTY = 0.01

#: (host, path, verdict): fits the host and its subdomains if the path starts with the rule's.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

#: Words of hosts to be blocked, words of other hosts, and the commonest pairs of letters in English, of which more
#: names of ordinary hosts are put together.
BAD_WORDS = tuple(
    """pills pharmacy meds drugs viagra casino poker slots bets betting lotto jackpot roulette xxx adult porn sexy cams
    dating escort loan cash payday forex crack warez keygen serial torrent spam seo backlinks farm ads banner click track
    tracker popup adserver prize winner claim replica fake cheap discount deals offers free bonus miracle diet""".split()
)
GOOD_WORDS = tuple(
    """news daily reading library history museum garden travel train weather recipes kitchen soup school university
    science journal music archive cycling hiking river mountain atlas maps poetry theatre cinema painting sculpture
    language grammar physics chemistry biology astronomy village council parish harbour bridge castle forest bakery
    teacher student lecture mirovan kelduna brostel quenlo vandrel dorimex sulpira hegendor rinterlo thornwell shandre
    atterlin eranole ondrath""".split()
)
LETTER_PAIRS = tuple(
    """th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic
    ne ea ra ce li ch be ma si om ur""".split()
)
_SUBDOMAINS = ("", "www.", "m.", "blog.", "")
_TOP = ("com", "org", "info", "biz", "com")
_PATHS = ("/en/{n}", "/fr/{n}?page=2&ref=x", "/de/{n}.html", "/es/{n}#top", "/en/{n}?utm_source=feed", "/{word}/{n}", "/{word}.html", "/")


def labelled_rows() -> list[tuple[str, int]]:
    """The built-in labelled URLs (1 is to be blocked): hosts of two words each, and ordinary names, with the same
    subdomains, endings and paths for both labels."""

    def url(number: int, host: str, word: str) -> str:
        path = _PATHS[number % 8].format(n=number * 37 % 997, word=word)
        return f"http{'s' if number % 3 else ''}://{_SUBDOMAINS[number % 5]}{host}.{_TOP[number // 2 % 5]}{path}"

    rows = []
    for label, words in ((1, BAD_WORDS), (0, GOOD_WORDS)):
        for i, word in enumerate(words):
            one, two, three, four = (words[(i * step + shift) % len(words)] for step, shift in ((7, 3), (11, 5), (5, 2), (3, 1)))
            hosts = [f"{word}-{one}", f"{word}{two}", f"{three}-{word}24", f"my{word}{four}"]
            rows += [(url(4 * i + k, host, one), label) for k, host in enumerate(hosts[: 4 if label else 2])]
    for i in range(120):
        host = "".join(LETTER_PAIRS[zlib.crc32(f"{i}:{k}".encode()) % len(LETTER_PAIRS)] for k in range(2 + i % 4))
        rows.append((url(i, host, host), 0))
    return rows


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if null or without ://."""
    rest = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty if null or without ://."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _chars(text: Column) -> Column:
    return F.filter(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), lambda c: c != "")


def _grams(chars: str, tag: str) -> Column:
    """Character n-grams of the column `chars`, an array of letters, each with the tag in front."""

    def of(n: int) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(chars) - n + 1), lambda i: F.concat(F.lit(tag), F.array_join(F.slice(chars, i, F.lit(n)), "")))
        return F.when(F.size(chars) >= n, grams).otherwise(F.array().cast("array<string>"))

    return F.concat(*map(of, GRAM_SIZES))


def _with_features(parsed: DataFrame) -> DataFrame:
    # the letters are columns, so that they are split once and not for each n-gram
    letters = parsed.withColumn("_host", _chars(F.col("host"))).withColumn("_path", _chars(F.col("path")))
    grams = letters.withColumn("_grams", F.concat(_grams("_host", "h"), _grams("_path", "p")))
    return HashingTF(inputCol="_grams", outputCol="_features", numFeatures=BUCKETS, binary=True).transform(grams).drop("_grams", "_host", "_path")


def _parsed(urls: DataFrame) -> DataFrame:
    return urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_rows(), "url string, label int")


def train_url_model(labelled: DataFrame) -> LogisticRegressionModel:
    """Fits the regression on a small table (url, label: 1 is to be blocked); rows with null labels are left out."""
    rows = _with_features(_parsed(labelled.filter("label IS NOT NULL"))).select("_features", F.col("label").cast("double").alias("label"))
    return LogisticRegression(featuresCol="_features", labelCol="label", regParam=PENALTY, maxIter=60).fit(rows.coalesce(1))


def _rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null without one."""
    name = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, rule_verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(rule_verdict)).otherwise(verdict)
    return name, verdict


def filter_urls(
    pages: DataFrame,
    labelled: DataFrame | None = None,
    rules: tuple[tuple[str, str, str], ...] = RULES,
    id_column: str = "page_id",
    url_column: str = "url",
) -> DataFrame:
    """One row per page: id, host, path, rule (the longest that fits, else null), verdict (allow or block), score.

    score is the model's chance that the URL is to be blocked; without a rule, 0.5 and more blocks. A null URL, or
    one without ://, has an empty host and path, fits no rule and is scored as such. Repeated rows and null ids stay
    as they are; an empty table gives an empty result; other columns are not read.
    """
    model = train_url_model(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    rows = _parsed(pages.select(F.col(id_column).alias("id"), F.col(url_column).cast("string").alias("url")))
    scored = model.transform(_with_features(rows)).withColumn("score", vector_to_array("probability")[1])
    rule, verdict = _rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select(F.col("id").alias(id_column), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")
