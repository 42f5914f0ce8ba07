"""Each operator on small fixtures with nulls, empty texts, ties and repeated rows, against brute force."""

import re
import zlib

import numpy as np
import pytest

from shellac.llm import components, embeddings, exact, langid, licenses, mixing, neardup, packing, pii, sharding, urls

SCHEMA = "doc_id long, text string, lang string, source string, node string, size int"
WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen".split()


@pytest.fixture(scope="module")
def docs(spark):
    base = " ".join(WORDS * 2)
    rows = [(1, base, "en", "a"), (2, base + " more", "en", "b"), (3, base.upper(), "en", None), (4, "", "de", "a"), (5, None, None, "c")]
    rows += [(6, "  \n ", "de", "b"), (7, "two words", "en", "a"), (8, "two\twords", "en", "a"), (9, "Two words", "en", "b"), (10, "eins zwei drei vier", "de", "c")]
    rows += [(1, base, "en", "a"), (None, "two words", None, None), (11, "12345 !!", "fr", "a")]
    return spark.createDataFrame([(*r, "clash", 7) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_rice_round_trip():
    gaps = np.array([0, 1, 5, 1000, 0, 123456], dtype=np.uint64)
    for rice in (0, 3, 10):
        if rice or gaps.max() < 10**7:
            assert (exact.rice_decode(exact.rice_encode(gaps, rice), len(gaps), rice) == gaps).all()


def test_exact(docs, empty):
    got = exact.exact_duplicates(docs).collect()
    assert len(got) == docs.count() and exact.exact_duplicates(empty).count() == 0
    by = {(r.doc_id, r.text_sha256): r for r in got}
    groups = {r.doc_id: (r.keep_id, r.group_size) for r in got}
    assert groups[8] == (7, 3) and groups[None] == (7, 3) and groups[5] == (4, 2) and groups[6] == (6, 1)
    assert sum(r.kept for r in got if r.doc_id == 1) == 1 and len(by) == 12


def test_near(docs, empty):
    got = {r.doc_id: r for r in neardup.near_duplicates(docs, 3, 85).collect()}
    assert neardup.near_duplicates(empty, 3, 85).count() == 0
    assert {i: got[i].component_id for i in (1, 2, 3, 7, 8, 9)} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7}
    assert got[4].n_shingles == got[5].n_shingles == got[6].n_shingles == 0 and got[4].kept and got[5].kept
    assert got[1].n_shingles == len({tuple((WORDS * 2)[i : i + 3]) for i in range(32)})


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(40, 50), (60, 60)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(21)}, 40: 40, 50: 40}


def test_mixing(docs, empty):
    got = mixing.mix_sources(docs).collect()
    assert mixing.mix_sources(empty).count() == 0 and len(got) == docs.count()
    assert all(0 <= r.taken <= 3 * r["size"] and r.target <= 3 * r.source_size for r in got)
    rows = {(r.doc_id, r.text): r.source for r in docs.collect()}
    sources = {}
    for r, source in ((r, s) for r in got for (i, t), s in rows.items() if i == r.doc_id and len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) == r["size"]):
        sources.setdefault(source, []).append(r)
    assert sum(own[0].target for own in sources.values()) == pytest.approx(sum(r["size"] for r in got))
    assert all(sum(r.taken for r in own) == int(own[0].target + 1e-6) for own in sources.values())
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sources(docs).collect()), key=str)


def test_packing(docs, empty):
    got = packing.pack_documents(docs, lengths=(8, 16, 32)).collect()
    assert packing.pack_documents(empty).count() == 0
    sizes = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) + 1 for r in docs.collect())
    assert sum(r.length for r in got) == sizes
    bins: dict = {}
    for r in got:
        bins.setdefault((r.bin_id, r.bin_length), []).append((r.bin_offset, r.length))
    for (_, length), parts in bins.items():
        end = 0
        for offset, size in sorted(parts):
            assert offset == end
            end += size
        assert length == min(c for c in (8, 16, 32) if c >= end)


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_is_brute_force(seed):
    """Bins, offsets and final lengths against plain lists."""
    rng = np.random.default_rng(seed)
    lengths = ((8, 16, 32), (10, 32), (32,), (4, 9, 32))[seed]
    sizes = sorted(rng.integers(1, (33, 12, 33, 5)[seed], 200).tolist(), reverse=True)
    used: list[int] = []
    capacity: list[int] = []
    bins, offsets, last = [], [], {}
    for n, size in enumerate(sizes):
        fits = [(capacity[i] - used[i], -last[i], i) for i in range(len(used)) if capacity[i] - used[i] >= size]
        if fits:
            i = min(fits)[2]
        else:
            best = None
            for c in lengths:
                if c >= size:
                    fill = size
                    for other in sizes[n + 1 :]:
                        if fill + other <= c:
                            fill += other
                    final = min(x for x in lengths if x >= fill)
                    best = min(best or (9e9, 0), (packing.cost(final) / fill, c))
            i = len(used)
            used.append(0)
            capacity.append(best[1])
        bins.append(i)
        offsets.append(used[i])
        used[i] += size
        last[i] = n
    assert packing.best_fit(sizes, lengths) == (bins, offsets, [min(x for x in lengths if x >= u) for u in used])


def test_sharding(docs, empty):
    got = sharding.shard_documents(docs, shards=4).collect()
    assert sharding.shard_documents(empty).count() == 0 and len(got) == docs.count()
    slots: dict = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.text_crc32 for r in got if r.doc_id == 7} == {zlib.crc32(b"two words")}


def test_language(docs, empty):
    got = {r.doc_id: r for r in langid.identify_languages(docs).collect()}
    assert langid.identify_languages(empty).count() == 0
    assert got[5].lang_pred == got[4].lang_pred == got[11].lang_pred == "und" and got[10].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items() if i is not None)


def test_urls(spark):
    rows = [(1, "http://A.NET/x"), (2, "https://w.example.net/en/1?q"), (3, "http://x.example.com/de/#t"), (4, "ftp://a.org/fr/"), (5, None), (6, "nonsense"), (7, "http://a.net")]
    got = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in (1, 2, 3, 4)] == [
        ("a.net", "/x", "net/", "block"),
        ("w.example.net", "/en/1", "example.net/en/", "allow"),
        ("x.example.com", "/de/", "example.com/de/", "block"),
        ("a.org", "/fr/", "org/fr/", "allow"),
    ]
    assert all((got[i].rule, got[i].host, got[i].path) == (None, "", "") for i in (5, 6)) and got[7].rule is None


def test_licenses(spark):
    text = "Copyright (c) 2020 Someone\n\n" + dict(licenses.LICENSES)["ISC"].upper().replace("\n", "  ")
    rows = [(1, text), (2, "prose\n  released under the MIT Licence!\nmore"), (3, None), (4, "")]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].license_id == "ISC" and got[2].license_id is None and got[2].notices == "MIT"
    assert got[3].license_id is None and got[4].digest == got[3].digest


def test_personal_data(spark):
    rows = [(1, "Mr. John Smith, +1 (212) 555-0199 or +1-212-555-0199; Mrs. Smith a.b@c.com A.B@C.COM"), (2, None), (3, ""), (4, "plain 12"), (5, "card 4111 1111 1111 1111, 8.8.8.8.")]
    got = {r.doc_id: r for r in pii.replace_personal_data(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    out = got[1].text
    assert not re.search("Smith|212|a\\.b@c", out, re.I) and got[1].entities == 6
    one, two = re.findall(r"\+1[ -]\(?(\d{3})\)?[ -](\d{3}-\d{4})", out)
    assert one == two and re.search(r"Mr\. \w+ (\w+),.*Mrs\. \1 ", out)
    assert got[2].text is None and got[3].text == "" and got[4].text == "plain 12"
    digits = [int(c) for c in re.sub(r"\D", "", got[5].text.split(",")[0])][::-1]
    assert sum(sum(divmod(d * (1 + i % 2), 10)) for i, d in enumerate(digits)) % 10 == 0


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((30, 16))
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(base)]
    rows += [(100 + i, [float(x) for x in base[i] * 2 + rng.normal(0, 0.05, 16)], i % 2) for i in range(30)]
    rows += [(200, None, 0), (201, [0.0] * 16, 0), (202, rows[0][1], None), (203, [float("nan")] * 16, 0), (204, rows[0][1], 0)]
    got = {r.vec_id: r for r in embeddings.similar_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    usable = [(i, np.array(v), k) for i, v, k in rows if v and k is not None and np.isfinite(v).all() and np.any(v)]
    for i, v, k in usable:
        want = sum(j != i and k == m and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98 for j, w, m in usable)
        assert got[i].n_links == want
    assert got[204].component_id == 0 and all(got[i].n_links == 0 and got[i].kept for i in (200, 201, 202, 203))
