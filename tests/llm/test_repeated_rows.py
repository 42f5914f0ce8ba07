"""Copies, null ids, one label only and clashing column names in language identification and the pipeline's stages."""

import re
import time

import pytest

import corpus_pipeline
from shellac.llm import langid, neardup

DE = "der schnelle braune Fuchs springt über den faulen Hund und läuft in den Wald zurück zu seinen Jungen".split()


def test_copies_take_no_label(spark):
    english = "the quick brown fox jumps over the lazy dog and runs back into the forest to its young"
    rows = [(i, english, "en") for i in range(4000)] + [(5000 + i, " ".join(DE[i % 9 :] + DE[: i % 9]), "de") for i in range(20)]
    got = langid.identify_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r.lang_pred == ("en" if r.doc_id < 4000 else "de") for r in got)


def test_one_label(spark):
    model = langid.train_language_model(spark.createDataFrame([("some words", "en")] * 3, "text string, label string"))
    got = langid.predict_language(spark.createDataFrame([(1, "other words"), (2, None)], "doc_id long, text string"), model).collect()
    assert [(r.doc_id, r.lang_pred) for r in got] == [(1, "en"), (2, "und")]


def test_more_labels_than_a_sample_each(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE", 40)
    monkeypatch.setattr(langid, "LANDMARKS", 5)
    letters = [chr(0x4E00 + 50 * i) for i in range(30)]
    rows = [(x * 3 + chr(ord(x) + 1) * k, f"l{i}") for i, x in enumerate(letters) for k in range(1, 8)]
    model = langid.train_language_model(spark.createDataFrame(rows, "text string, label string"))
    assert len(model.labels) == 30
    new = spark.createDataFrame([(i, x * 4) for i, x in enumerate(letters)], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.predict_language(new, model).collect()}
    assert sum(got[i] == f"l{i}" for i in range(30)) >= 28


def test_exact_stage_by_rows(spark):
    rows = [(1, "same"), (1, "same"), (2, "other"), (None, "zz"), (None, "zz"), (3, "same "), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, corpus_pipeline.exact_dedup(spark, docs, "").collect()), key=str)
    # "same" and "same " differ by a space at the end, which stays one
    assert got == sorted([(1, "same"), (2, "other"), (None, "zz"), (3, "same "), (4, None)], key=str)


def _linked(x, y, words, percent):
    def shingles(text):
        found = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
        return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()

    a, b = shingles(x), shingles(y)
    return bool(a and b) and 100 * len(a & b) >= percent * len(a | b)


def _texts():
    words = [f"w{i}" for i in range(400)]
    texts = []
    for base in range(12):
        own = words[base * 30 : base * 30 + 60]
        # 56 five-word shingles; a change at the end costs one each, so that pairs lie on both sides of 0.8
        texts += [" ".join(own)] + [" ".join(own[: 60 - k] + [f"x{base}_{k}_{i}" for i in range(k)]) for k in (1, 3, 5, 6, 7, 9, 15)]
    return texts


@pytest.mark.parametrize(("words", "percent"), [(5, 80), (3, 85)])
def test_components_are_brute_force(spark, words, percent):
    texts = _texts()
    docs = spark.createDataFrame([(10 * i + 3, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if _linked(texts[i], texts[j], words, percent):
                a, b = sorted((parent[i], parent[j]))
                parent = [a if p == b else p for p in parent]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, words, percent).collect()}
    assert got == {10 * i + 3: 10 * p + 3 for i, p in enumerate(parent)}
    assert len(set(parent)) < len(texts) - 12 and len(set(parent)) > 12


def test_near_repeated_ids(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(7, " ".join(base)), (7, "quite another text of seven words here"), (3, "quite another text of seven words here"), (9, " ".join(base[:59] + ["x"])), (7, " ".join(base)), (5, None), (None, " ".join(base))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    # id 7 stands in both groups, so they are one component
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == sorted([("7", "3")] * 3 + [("3", "3"), ("9", "3"), ("5", "5"), ("None", "None")])


def test_near_stage_by_rows(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join(base)), (None, " ".join(base[:59] + ["x"])), (4, " ".join(base[:59] + ["y"])), (4, "alone"), (5, ""), (5, ""), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, corpus_pipeline.near_dedup(spark, docs, "").collect()), key=str)
    assert got == sorted([(4, " ".join(base[:59] + ["y"])), (4, "alone"), (5, ""), (5, ""), (6, None)], key=str)


def test_clashing_names(spark):
    columns = "doc_id long, text string, lang string, source string, times int, time int, taken_id long, row_key int, row int, size int, key int"
    rows = [(i, f"text number {i} " * 5, "en", "ab"[i % 2], 1, 2, 3, 4, 5, 6, 7) for i in range(20)]
    docs = spark.createDataFrame(rows, columns)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 20


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_empty_table(spark, name):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, "").count() == 0


def test_very_long_text(spark):
    long = " ".join(f"word{i % 5000}" for i in range(200_000))
    docs = spark.createDataFrame([(1, long, "en", "a"), (2, long + " end", "en", "a"), (3, "short text here", "en", "b")], "doc_id long, text string, lang string, source string")
    start = time.time()
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {1, 3}
    assert corpus_pipeline.language_id(spark, docs, "").count() == 3
    pieces = corpus_pipeline.pack(spark, docs, "").groupBy("doc_id").sum("length").collect()
    assert {r[0]: r[1] for r in pieces} == {1: 200_001, 2: 200_002, 3: 4}
    assert time.time() - start < 300
