"""Genres learned from tags and moods learned from audio features, by Spark's own estimators on all labelled rows."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, SQLTransformer, StandardScaler, StopWordsRemover, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shellac.functions.tags import given
from shellac.tables import if_small, written

#: Words and pairs of words that count; genres named for a track, and the least probability of one.
VOCABULARY, GENRES, LEAST = 5000, 5, 0.1
HELD_OUT = 0.2
SEED = 42
MOOD_FEATURES = ("valence", "energy", "danceability", "acousticness")


def genre_text(title: Column, album: Column, artist: Column, year: Column, seconds: Column) -> Column:
    """What a genre is learned from: title and album without what is in brackets, artist, a word for the decade and one for the
    length; missing parts are left out."""

    def bare(text: Column) -> Column:
        return F.when(given(text), F.regexp_replace(F.regexp_replace(text, "\\([^)]*\\)", ""), "\\[[^\\]]*\\]", ""))

    decade = F.when((year > 1900) & (year < 2100), F.concat(F.lit("decade_"), (F.floor(year / 10) * 10).cast("string")))
    minutes = seconds / 60
    length = F.when(minutes < 2, "very_short").when(minutes < 4, "short").when(minutes < 6, "medium").when(minutes < 10, "long").otherwise("extended")
    return F.concat_ws(" ", bare(title), bare(album), F.when(given(artist), artist), decade, F.when(seconds != 0, length))


def split_rows(rows: DataFrame, label: str, keys: list[str], share: float = HELD_OUT) -> DataFrame:
    """`rows` that have a label, with held_out: about `share` of each label's, by a hash of `keys`, so that reruns agree, but
    never all: the row of the largest hash of each label is learned from. The rows are written, since learning reads them often."""
    marked = written(rows.filter(given(F.col(label))).withColumn("_hash", F.xxhash64(F.lit(SEED), *keys)))
    last = written(marked.groupBy(F.col(label).alias("_label")).agg(F.max("_hash").alias("_last")))
    joined = marked.join(if_small(last), F.col(label) == F.col("_label"))
    held = (F.pmod(F.col("_hash"), F.lit(10_000)) < int(share * 10_000)) & (F.col("_hash") < F.col("_last"))
    return joined.withColumn("held_out", held).drop("_hash", "_label", "_last")


def _weighted(rows: DataFrame, label: str) -> DataFrame:
    """Rows with weights by which each label counts as much as any other."""
    counts = rows.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("_labels"))
    # a row for each label, counted once
    weighted = rows.join(if_small(written(counts.crossJoin(F.broadcast(total)))), F.col(label) == F.col("_label"))
    return weighted.withColumn("_weight", F.col("_all") / (F.col("_labels") * F.col("_n"))).drop("_n", "_all", "_labels", "_label")


def train_genre(rows: DataFrame, text: str = "text", label: str = "genre", vocabulary: int = VOCABULARY, rounds: int = 50) -> PipelineModel:
    """Multinomial regression on the weighted words and pairs of words of `text`, each label as weighty as any other. Rows with
    held_out, where there is that column, aren't learned from; without any row it's an error."""
    known = rows.filter(given(F.col(label)) & F.col(text).isNotNull())
    known = known.filter(~F.col("held_out")) if "held_out" in rows.columns else known
    known = _weighted(known.select(F.col(text).alias("_text"), F.col(label).alias("_genre")), "_genre")
    if known.isEmpty():
        raise ValueError("no labelled rows to learn from")
    steps = [
        RegexTokenizer(inputCol="_text", outputCol="_words", pattern="[\\p{L}\\p{N}_#]{2,}", gaps=False),
        StopWordsRemover(inputCol="_words", outputCol="_kept"),
        NGram(inputCol="_kept", outputCol="_pairs", n=2),
        SQLTransformer(statement="SELECT *, concat(_kept, _pairs) AS _terms FROM __THIS__"),
        CountVectorizer(inputCol="_terms", outputCol="_counts", vocabSize=vocabulary),
        IDF(inputCol="_counts", outputCol="_weights"),
        Normalizer(inputCol="_weights", outputCol="_features"),
        StringIndexer(inputCol="_genre", outputCol="_label", handleInvalid="keep", stringOrderType="alphabetAsc"),
        LogisticRegression(featuresCol="_features", labelCol="_label", weightCol="_weight", probabilityCol="_chances", family="multinomial", maxIter=rounds, regParam=0.001),
    ]
    return Pipeline(stages=steps).fit(known)


def _named(chances: Column, labels: list[str], least: float, most: int) -> Column:
    """(label, chance) of chances above `least`, the largest first, `most` at most."""
    cells = F.zip_with(F.array(*[F.lit(v) for v in labels]), F.slice(vector_to_array(chances), 1, len(labels)), lambda v, c: F.struct((-c).alias("minus"), v.alias("label")))
    best = F.slice(F.array_sort(F.filter(cells, lambda c: -c["minus"] > least)), 1, most)
    return F.transform(best, lambda c: F.struct(c["label"].alias("label"), (-c["minus"]).alias("chance")))


def predict_genre(model: PipelineModel, rows: DataFrame, text: str = "text", least: float = LEAST, most: int = GENRES) -> DataFrame:
    """`rows` with genres: (label, chance) of each genre that is likelier than `least`, the likeliest first, `most` at most. A
    null text counts as empty."""
    plain = rows.withColumn("_text", F.coalesce(text, F.lit(""))).withColumn("_genre", F.lit(None).cast("string"))
    scored = model.transform(plain)
    return scored.select(*[F.col(f"`{c}`") for c in rows.columns], _named(F.col("_chances"), model.stages[-2].labels, least, most).alias("genres"))


def train_mood(rows: DataFrame, label: str = "mood", features: tuple[str, ...] = MOOD_FEATURES, trees: int = 100, depth: int = 10) -> PipelineModel:
    """A forest on scaled features; a missing feature counts as 0.5. Rows with held_out aren't learned from."""
    known = rows.filter(given(F.col(label)))
    known = known.filter(~F.col("held_out")) if "held_out" in rows.columns else known
    known = _moods_in(known, features).withColumn("_mood", F.col(label))
    if known.isEmpty():
        raise ValueError("no labelled rows to learn from")
    steps = [
        VectorAssembler(inputCols=[f"_{c}" for c in features], outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True),
        StringIndexer(inputCol="_mood", outputCol="_label", handleInvalid="keep", stringOrderType="alphabetAsc"),
        RandomForestClassifier(featuresCol="_scaled", labelCol="_label", probabilityCol="_chances", numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=SEED),
    ]
    return Pipeline(stages=steps).fit(known)


def _moods_in(rows: DataFrame, features: tuple[str, ...]) -> DataFrame:
    return rows.withColumns({f"_{c}": F.coalesce(F.col(c).cast("double"), F.lit(0.5)) for c in features})


def predict_mood(model: PipelineModel, rows: DataFrame, features: tuple[str, ...] = MOOD_FEATURES, most: int = 3) -> DataFrame:
    """`rows` with moods: (label, chance) of the likeliest, `most` at most."""
    scored = model.transform(_moods_in(rows, features).withColumn("_mood", F.lit(None).cast("string")))
    return scored.select(*[F.col(f"`{c}`") for c in rows.columns], _named(F.col("_chances"), model.stages[-2].labels, 0.0, most).alias("moods"))


def importances(model: PipelineModel, features: tuple[str, ...] = MOOD_FEATURES) -> dict[str, float]:
    """How much each feature tells about moods; the sum is 1."""
    return dict(zip(features, map(float, model.stages[-1].featureImportances.toArray()), strict=True))


def accuracy(predicted: DataFrame, label: str, found: str) -> DataFrame:
    """(rows, right, accuracy) of held-out rows: those whose likeliest label is theirs."""
    right = F.count_if(F.coalesce(F.get(F.col(found), F.lit(0))["label"] == F.col(label), F.lit(False)))
    return predicted.filter("held_out").agg(F.count(F.lit(1)).alias("rows"), right.alias("right"), F.coalesce(right / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias("accuracy"))
