"""Connected components against a plain search, at the ends of 64-bit ids, and joins with hot keys."""

import random

from pyspark.sql import functions as F

from panelnet.operators import components, graph, settle


def _plain(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in root}


def test_components_of_any_graph(spark, monkeypatch):
    monkeypatch.setattr(settle, "HOT_ROWS", 8)
    r, big = random.Random(1), 1 << 62
    edges = [(i, i + 1) for i in range(300)] + [(1000, 999), (5, 5), (None, 3), (2000, 1000), (1000, 999)]
    edges += [(big + 1, big + 5), (big + 5, 2**63 - 1), (big + 7, 2**63 - 2), (-(2**63), -4)]
    edges += [(10_000, 10_001 + i) for i in range(500)] + [(r.randrange(20_000, 20_400), r.randrange(20_000, 20_400)) for _ in range(250)]
    got = {x.node: x.component for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == _plain(edges)


def test_no_edges(spark):
    nodes = spark.createDataFrame([(3,), (2**63 - 1,)], "node_id long")
    edges = spark.createDataFrame([], "t int, src long, dst long, w double")
    assert {tuple(x) for x in graph.components(edges, nodes).collect()} == {(3, 3), (2**63 - 1, 2**63 - 1)}


def test_even_join_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(settle, "HOT_ROWS", 5)
    rows = spark.range(1000).select((F.col("id") % 97 * (F.col("id") % 3)).alias("k"), F.col("id").alias("v"))
    groups = rows.groupBy("k").agg(F.min("v").alias("m"), F.count("*").alias("n")).where("n > 1")
    want = sorted(map(tuple, rows.join(groups.drop("n"), "k").select("k", "v", "m").collect()))
    assert sorted(map(tuple, settle.even_join(rows, groups, "k", 1000).select("k", "v", "m").collect())) == want
