"""Cut vertices by forests of blocks, and by rounds that take off what hangs on a node or runs in parallel."""

import random

from test_depth import linear

from provgraph.operators import blocks as X
from provgraph.operators import depth as H

DDL = "graph_id string, src string, dst string"


def counts(table, held=0):
    return {r.graph_id: r.articulation for r in H.articulation_count(table, held=held).collect()}


def graphs(rng):
    """Random graphs, sparse and dense ones, circles of four, a pair, a path, a hub with leaves and triangles, parallel ways, and loops alone."""
    edges = [(f"g{k}", str(rng.randrange(n)), str(rng.randrange(n))) for k in range(60) for n in [rng.randrange(3, 16)] for _ in range(rng.randrange(1, 2 * n))]
    edges += [("four", *x) for x in ("ab", "bc", "cd", "da")] + [("more", *x) for x in ("ab", "bc", "cd", "da", "ax", "xy")] + [("pair", "a", "b"), ("loop", "a", "a")]
    edges += [("path", str(i), str(i + 1)) for i in range(9)] + [("hub", "h", f"x{i}") for i in range(24)] + [("hub", f"x{i}", f"x{i + 1}") for i in range(0, 14, 3)]
    edges += [("ways", end, f"m{i}") for i in range(12) for end in ("s", "t")] + [("ways", "m3", "leaf"), ("ways", "t", "out"), ("ways", "s", "s")]
    rng.shuffle(edges)
    return edges


def test_thinned_by_rounds(spark, monkeypatch):
    """Tasks of a few links, then rounds, and what they leave by levels or tours."""
    edges = graphs(random.Random(41))
    monkeypatch.setattr(X, "CHUNK", 20)
    monkeypatch.setattr(X, "SHRINK", 1)
    table = spark.createDataFrame([*edges, ("g0", None, "1"), ("none", "a", None), (None, "a", "b")], DDL)
    assert counts(table.repartition(3)) == linear(edges)[1]


def test_large_graph_needs_no_numbers(spark, monkeypatch):
    """Customers, orders and parts, as many links as 8 tasks hold, are thinned until one task holds what is left."""
    rng = random.Random(42)
    edges = [("t", f"c{rng.randrange(40)}", f"o{i}") for i in range(400)] + [("t", f"o{rng.randrange(400)}", f"p{rng.randrange(60)}") for _ in range(1600)]
    monkeypatch.setattr(X, "CHUNK", 250)
    monkeypatch.setattr(H, "_numbers", lambda *_: 1 / 0)
    assert counts(spark.createDataFrame(edges, DDL).coalesce(1)) == linear(edges)[1]
