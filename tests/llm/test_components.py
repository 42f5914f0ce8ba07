"""A long chain, whose stars grow late: one component, and hubs are found when they come up."""

from pyspark.sql import functions as F

from shellac.llm import components as c


def test_chain_grows_hubs(spark, monkeypatch):
    hubs = []
    step = c._step
    monkeypatch.setattr(c, "_step", lambda edges, large, hub: hubs.append(hub) or step(edges, large, hub))
    n = 1500
    links = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = c.components(links).collect()
    assert sorted(r.node for r in found) == list(range(n)) and {r.component for r in found} == {0}
    assert hubs[0] is None and hubs[-1] is not None
