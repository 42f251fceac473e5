"""Components joined up within tasks as links come, before the rounds of stars."""

import random

from provgraph.operators import components as C
from provgraph.operators import graph as A

DDL = "graph_id string, src string, dst string"


def linear(edges):
    """Every node with the least of its component; an edge with a null joins nothing, but its other end is a node."""
    up = {(g, x): (g, x) for g, *ends in edges for x in ends}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for g, a, b in edges:
        if None not in (g, a, b):
            low, high = sorted((root((g, a)), root((g, b))))
            up[high] = low
    return sorted(((g, x, root((g, x))[1]) for g, x in up), key=str)


def found(table):
    return sorted((tuple(r) for r in A.weak_components(table).collect()), key=str)


def test_nulls_join_nothing(spark):
    edges = [("g", "b", "c"), ("g", "a", None), ("g", "c", None), ("g", None, "d"), (None, "a", "b"), ("g", "e", "e"), ("h", "a", "c"), ("h", None, None)]
    assert found(spark.createDataFrame(edges, DDL)) == linear(edges)
    numbers = spark.createDataFrame([("g", 10, 9), ("g", 9, -1), ("g", 5, 5), ("h", 10, 2)], "graph_id string, src int, dst bigint").selectExpr("graph_id", "src", "cast(dst as int) as dst")
    assert found(numbers) == [("g", -1, -1), ("g", 10, -1), ("g", 5, 5), ("g", 9, -1), ("h", 10, 2), ("h", 2, 2)]


def test_parts_of_few_links(spark, monkeypatch):
    """Random graphs, paths and hubs, in parts of 20 links over 3 tasks, are joined up again by their common nodes."""
    rng = random.Random(51)
    edges = [(f"g{k}", f"{k}é{rng.randrange(n)}", f"{k}é{rng.randrange(n)}") for k in range(12) for n in [rng.randrange(4, 50)] for _ in range(n)]
    edges += [("path", f"p{i}", f"p{i + 1}") for i in range(90)] + [("hub", f"x{i}", "h") for i in range(90)]
    rng.shuffle(edges)
    monkeypatch.setattr(C, "CHUNK", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        assert found(spark.createDataFrame(edges, DDL).repartition(3)) == linear(edges)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_near_rows_need_no_rounds(spark, monkeypatch):
    """Graphs whose rows lie in one task are settled there."""
    edges = [(f"g{k}", f"n{i}", f"n{i // 2}") for k in range(6) for i in range(1, 60)]
    monkeypatch.setattr(C, "_by_stars", lambda *_: 1 / 0)
    assert found(spark.createDataFrame(edges, DDL).coalesce(1)) == linear(edges)
