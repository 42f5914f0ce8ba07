"""Shards: groups of equal texts stay whole as long as a shard has room for them."""

import pytest

from shellac.llm import sharding

SIZES = [*[100] * 6, *[40] * 10, *[3] * 60, *[2] * 40]


@pytest.mark.parametrize("large_groups", [10_000, 30, 1])
def test_groups_stay_whole(spark, monkeypatch, large_groups):
    monkeypatch.setattr(sharding, "LARGE_GROUPS", large_groups, raising=False)
    texts = [f"group {i}" for i, size in enumerate(SIZES) for _ in range(size)] + [f"single {i}" for i in range(601)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = sharding.shard_documents(docs, shards=4).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    slots, where = {}, {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
        assert r.linked == (SIZES[int(texts[r.doc_id].split()[1])] if texts[r.doc_id].startswith("group") else 1)
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {text for text, shards in where.items() if len(shards) > 1} == set()


def test_group_larger_than_a_shard(spark):
    # 400 rows in 4 shards of 100: the group of 250 needs three, nothing else needs a split
    texts = ["large"] * 250 + [f"pair {i // 50}" for i in range(100)] + [f"single {i}" for i in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sharding.shard_documents(docs, shards=4).collect()
    where = {}
    for r in got:
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert len(got) == 400 and len(where["large"]) == 3
    assert all(len(shards) == 1 for text, shards in where.items() if text != "large")
