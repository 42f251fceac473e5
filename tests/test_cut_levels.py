"""Cut vertices of large graphs level by level, without the rounds of tours."""

import random

from test_depth import linear

from provgraph.operators import depth as H

DDL = "graph_id string, src string, dst string"


def counts(table, held):
    return {r.graph_id: r.articulation for r in H.articulation_count(table, held=held).collect()}


def test_levels_need_no_tours(spark, monkeypatch):
    """Random graphs, one with further components that are small, a hub with leaves and triangles, and loops."""
    rng = random.Random(31)
    edges = [(f"g{g}", str(rng.randrange(90)), str(rng.randrange(90))) for g, n in enumerate((95, 130, 300)) for _ in range(n)]
    edges += [("hub", "h", f"x{i}") for i in range(60)] + [("hub", f"x{i}", f"x{i + 1}") for i in range(0, 40, 3)] + [("hub", "x59", "y"), ("hub", "y", "z"), ("hub", "y", "y"), ("g0", "far", "end"), ("g0", "end", "off")]
    table, want = spark.createDataFrame(edges, DDL), linear(edges)[1]
    monkeypatch.setattr(H, "cut_vertices", lambda *_: 1 / 0)
    assert counts(table, 20) == want


def test_too_deep_for_levels(spark, monkeypatch):
    """A path is left to the tours, other graphs are not; so is a large component that no root reaches."""
    rng = random.Random(32)
    edges = [("path", f"p{i}", f"p{i + 1}") for i in range(20)] + [("path", "p3", "p5"), ("path", "q", "r")]
    edges += [("star", "h", str(i)) for i in range(15)] + [("parts", f"{k}-{rng.randrange(12)}", f"{k}-{rng.randrange(12)}") for k in range(2) for _ in range(16)]
    monkeypatch.setattr(H, "LEVELS", 5)
    assert counts(spark.createDataFrame(edges, DDL), 6) == linear(edges)[1]
