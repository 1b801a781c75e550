import random

from pyspark.sql import functions as F

from metricledger.llm import components


def plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root) if find(x) != x}


def test_stars_take_no_round(spark, monkeypatch):
    """Edges that are stars are written once, and those that become stars are not gone through again."""
    names = []
    monkeypatch.setattr(components, "written", lambda df, name: names.append(name) or df.localCheckpoint())
    edges = spark.range(1, 50).select(F.col("id").alias("u"), (F.col("id") % 1).alias("v"))
    assert {(r.node, r.root) for r in components.stars(edges).collect()} == {(i, 0) for i in range(1, 50)}
    assert len(names) == 1
    two = spark.createDataFrame([(5, 3), (5, 2), (9, 8), (9, 8)], "u long, v long")
    assert {(r.node, r.root) for r in components.stars(two).collect()} == {(5, 2), (3, 2), (9, 8)}
    assert len(names) == 3


def test_random_graphs(spark):
    rnd = random.Random(5)
    for n, m in ((40, 30), (60, 60), (1, 0)):
        pairs = [(max(a, b), min(a, b)) for a, b in ((rnd.randrange(-n, n), rnd.randrange(-n, n)) for _ in range(m)) if a != b]
        got = components.stars(spark.createDataFrame(pairs, "u long, v long")).collect()
        assert {r.node: r.root for r in got} == plain(pairs)
        assert len(got) == len({r.node for r in got})
