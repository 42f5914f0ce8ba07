"""Language identification by string kernels.

The kernel of two texts is the number of n-grams (of 2 to 4 bytes) that both have, over the root of the product of
their own numbers: a blended-spectrum presence kernel. All n-grams of a text count, each hashed to one of SLOTS
places. Landmarks give Nyström features, on which one ridge regression per language tells it from the rest. Texts are
scored in batches: presence matrix times the product of the landmarks' matrix and the regressions' weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shellac.llm.scratch import small_batches
from shellac.llm.shingles import text_buffers

ORDERS = (2, 3, 4)
#: Places that n-grams are hashed to.
SLOT_BITS = 16
SLOTS = 1 << SLOT_BITS
#: Bounds of what is fitted on: distinct texts of each language and of all together, landmarks likewise. Where there are
#: more languages than SAMPLE // LEAST_PER_LABEL, each still has LEAST_PER_LABEL texts and a landmark.
SAMPLE_PER_LABEL, SAMPLE, LEAST_PER_LABEL = 300, 12_000, 4
LANDMARKS_PER_LABEL, LANDMARKS = 40, 2000
RIDGE = 1e-3
UNKNOWN = "und"

_ROWS = 256
_SEGMENT = 1 << 18
_MULTIPLY = {2: np.uint32(0x9E3779B1), 3: np.uint32(0x85EBCA77), 4: np.uint32(0xC2B2AE3D)}
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = [c if chr(c).isalpha() else 32 for c in range(128)]
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def _codes(data: np.ndarray, order: int) -> np.ndarray:
    """The n-grams of `order` bytes at all places of folded bytes."""
    room = len(data) - order + 1
    if room <= 0:
        return np.empty(0, dtype=np.uint32)
    out = data[:room].astype(np.uint32)
    for i in range(1, order):
        out <<= np.uint32(8)
        out |= data[i : i + room]
    return out


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Presence matrix (rows by SLOTS) of the texts data[offsets[i]:offsets[i + 1]], read whole in overlapping segments."""
    rows = len(offsets) - 1
    flags = np.zeros(rows * SLOTS, dtype=bool)
    first, last = int(offsets[0]), int(offsets[-1])
    for at in range(first, last, _SEGMENT):
        stop = min(last, at + _SEGMENT + max(ORDERS) - 1)
        folded = _FOLD[data[at:stop]]
        row = np.searchsorted(offsets, np.arange(at, stop), side="right") - 1 if rows > 1 else np.zeros(stop - at, dtype=np.int64)
        for order in ORDERS:
            codes = _codes(folded, order)
            mixed = codes * _MULTIPLY[order]
            place = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - SLOT_BITS)
            own = row[: len(codes)]
            inside = own == row[order - 1 : order - 1 + len(codes)]  # not over the end of a text
            flags[own[inside] * SLOTS + place[inside]] = True
    return flags.reshape(rows, SLOTS)


def _scaled(flags: np.ndarray) -> np.ndarray:
    """Presence rows over the roots of their numbers, so that their products are kernel values."""
    return flags.astype(np.float32) / np.sqrt(np.maximum(1, np.count_nonzero(flags, axis=1)))[:, None].astype(np.float32)


@dataclass
class LanguageModel:
    """Sorted labels, and for each a weight of each place and a bias: the kernel values with the landmarks are linear in
    a text's scaled presence, so landmarks and regression weights are multiplied out once."""

    labels: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def scores(self, flags: np.ndarray) -> np.ndarray:
        own = np.sqrt(np.maximum(1, np.count_nonzero(flags, axis=1)))[:, None]
        return (flags.astype(np.float32) @ self.weights) / own + self.bias


def _chunks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    data, offsets = text_buffers(column)
    for at in range(0, len(column), _ROWS):
        yield data, offsets[at : min(at + _ROWS, len(column)) + 1]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed presence of each text, beside its label and place in the sample."""
    for batch in batches:
        bits = [np.packbits(row).tobytes() for data, offsets in _chunks(batch.column(0)) for row in presence(data, offsets)]
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(bits, pa.binary())], ["label", "place", "bits"])


def _sample(labelled: DataFrame) -> tuple[DataFrame, list[str], int]:
    """Distinct texts (text, label, place from 1 on) of each label, those of least hash; the labels; landmarks of each.

    Distinct texts are what is counted and drawn from, so copies take nobody's place. One row per label reaches the
    driver; a threshold on the hash, a few times what is needed, leaves few rows to the grouping and the window."""
    usable = labelled.filter(F.col("label").isNotNull() & F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)))
    usable = usable.select(F.lower("text").alias("text"), "label")
    counts = usable.groupBy("label").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n"))
    found = {r["label"]: max(1, r["n"]) for r in counts.collect()}
    each = min(SAMPLE_PER_LABEL, max(LEAST_PER_LABEL, SAMPLE // max(1, len(found))))
    if not found:
        return usable.withColumn("place", F.lit(1)), [], 1
    # an estimate too high by half still leaves enough
    shares = labelled.sparkSession.createDataFrame([(k, min(1.0, 3 * each / n)) for k, n in found.items()], "label string, share double")
    draw = F.shiftrightunsigned(F.xxhash64("text"), 11) / F.lit(float(1 << 53))
    drawn = usable.withColumn("draw", draw).join(F.broadcast(shares), "label").filter(F.col("draw") <= F.col("share"))  # a row per label
    distinct = drawn.groupBy("label", "draw", F.sha2("text", 256).alias("digest")).agg(F.first("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("draw", "digest"))
    sample = distinct.withColumn("place", place).filter(F.col("place") <= each).select("text", "label", "place")
    return sample, sorted(found), min(LANDMARKS_PER_LABEL, max(1, LANDMARKS // len(found)))


def train_language_model(labelled: DataFrame) -> LanguageModel | None:
    """Fits on columns text and label; rows without a label or a letter are left out; None if none are left.

    Of each label's distinct texts, at most SAMPLE_PER_LABEL are taken, those of least hash (fewer, down to
    LEAST_PER_LABEL, where there are so many labels that all would be more than SAMPLE); the first of these, at most
    LANDMARKS_PER_LABEL, are landmarks. Only their packed presence rows, of bounded size, reach the driver. Repeated
    rows count once; one label alone is learned as the answer to every text; any number of labels is learned.
    """
    small_batches(labelled.sparkSession)
    sample, labels, landmarks = _sample(labelled)
    if not labels:
        return None
    rows = sample.mapInArrow(_packed, "label string, place int, bits binary").orderBy("label", "place").collect()
    flags = np.stack([np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8)) for r in rows]).astype(bool)
    marks = _scaled(flags[[r["place"] <= landmarks for r in rows]])
    kernel = np.concatenate([_scaled(flags[at : at + _ROWS]) @ marks.T for at in range(0, len(flags), _ROWS)]).astype(np.float64)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    solid = values > 1e-6 * values.max()
    project = vectors[:, solid] / np.sqrt(values[solid])
    features = kernel @ project
    target = np.array([[float(r["label"] == x) for x in labels] for r in rows])
    # every language weighs the same, whatever its share of the sample
    weight = (1 / target.sum(axis=0))[target.argmax(axis=1)][:, None]
    mean, level = (weight * features).sum(axis=0) / weight.sum(), (weight * target).sum(axis=0) / weight.sum()
    centred = features - mean
    gram = centred.T @ (weight * centred) + RIDGE * weight.sum() * np.eye(centred.shape[1])
    ridge = np.linalg.solve(gram, centred.T @ (weight * (target - level)))
    weights = (marks.T @ (project @ ridge).astype(np.float32)).astype(np.float32)
    return LanguageModel(labels, weights, (level - mean @ ridge).astype(np.float32))


def language_of(model: LanguageModel | None, text: Column) -> Column:
    """Struct of lang_pred and score for a text: `und` and 0 if it is null or has no letter, or without a model."""
    nothing = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if model is None:
        return nothing

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        names, values = [], []
        for data, offsets in _chunks(texts):
            scores = model.scores(presence(data, offsets))
            best = scores.argmax(axis=1)
            names += [model.labels[i] for i in best]
            values += np.clip(scores[np.arange(len(best)), best], 0, 1).tolist()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.float64())], ["lang_pred", "score"])

    return F.when(F.coalesce(text.rlike("\\p{L}"), F.lit(False)), predict(F.lower(text))).otherwise(nothing)


def predict_language(docs: DataFrame, model: LanguageModel | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, lang_pred (a label of the model), score (0 to 1).

    Texts that are null or have no letter, and all texts if there was nothing to learn from, get `und` and 0. Whole
    texts are read, lower-cased. Repeated rows and null ids stay; an empty table gives an empty result; other
    columns are not read.
    """
    found = docs.select(F.col(id_column), language_of(model, F.col(text_column).cast("string")).alias("found"))
    return found.select(id_column, "found.lang_pred", "found.score")


def identify_languages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score; learns from the documents that are not held out.

    Held out are those with crc32(id as text) mod 4 = 2 (a null id is not); their labels are never read.
    """
    held_out = F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(4)) == 2, F.lit(False))
    model = train_language_model(docs.filter(~held_out).select(F.col(text_column).alias("text"), F.col(label_column).cast("string").alias("label")))
    out = predict_language(docs, model, id_column, text_column)
    return out.select(id_column, held_out.alias("held_out"), "lang_pred", "score")
