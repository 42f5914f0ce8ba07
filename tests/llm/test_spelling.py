"""Words, near words, forms and roots against a plain reading of the rules, and odd rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

from shellac.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def _expected(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            mark = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if mark % 31 == 0:
                run = run[: mark % len(run)] + run[mark % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    # words within one edit share what is left of them without one letter
    shared = defaultdict(set)
    for w in words:
        for left in {w} | {w[:k] + w[k + 1 :] for k in range(len(w))}:
            shared[left].add(w)
    near = {w: set() for w in words}
    for group in shared.values():
        for a in group:
            near[a] |= {b for b in group if _one_edit(a, b)}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        form[w] = best if best and words[best] >= 10 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def _got(frame):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(frame).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert _got(frame) == _expected([(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()])


def test_frequent_chunks_and_chains(spark, monkeypatch):
    """Words of one half each, repeated letters, chains of forms; with every key of a few pairs cut again."""
    monkeypatch.setattr(spelling, "MOST_PAIRS", 5)
    rng = random.Random(3)
    words = {"straight" + "".join(rng.choice("abé") for _ in range(rng.choice((2, 3, 4)))) for _ in range(200)}
    words |= {"aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababa", "abbababab", "Straßenbau", "École-Normale"}
    texts = [" ".join(rng.choices(sorted(words), k=60)) for _ in range(40)]
    chain = ("letterbox", 2), ("letterbux", 30), ("letterbuxx", 400), ("lettarbuxx", 5000)
    texts += [" ".join([w.upper() if i % 2 else w] * n) for i, (w, n) in enumerate(chain)]
    rows = list(enumerate(texts))
    got = _got(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == _expected(rows)
    assert any(r[1] not in (None, r[2]) for r in got)


def test_edges(spark):
    columns = "doc_id long, text string, word string, n int, key long, id string"
    rows = [(None, "Wonderful wonderful"), (1, None), (1, ""), (2, "short words only"), (2, "short words only"), (None, "wonderfull " * 3), (3, "x" * 200_000), (3, "x" * 200_000)]
    rows += [(4, "wonderful " * 100_000), (5, "wonderfil wonderfil")]
    frame = spark.createDataFrame([(*r, "w", 1, 2, "i") for r in rows], columns)
    assert _got(frame) == _expected(rows)
    assert spelling.spelling_variants(frame.limit(0)).count() == 0
