"""Graphs without a cycle are peeled by their own names."""

from test_depth import linear

from provgraph.operators import depth as H


def test_acyclic_graphs_are_only_peeled(spark, monkeypatch):
    edges = [("path", f"p{i}", f"p{i + 1}") for i in range(4)] + [("path", "p0", "p3"), ("path", "p0", "p1"), ("loop", "a", "a"), ("null", None, "b")]
    rounds = [("ring", "x", "y"), ("ring", "y", "x"), ("ring", "y", "z"), ("ring", "z", "u"), ("ring", "v", "x")]
    seen, own = [], H.strong_components
    monkeypatch.setattr(H, "strong_components", lambda links: (seen.append(links.count()), own(links))[1])
    depths = lambda rows: {r.graph_id: (r.depth, r.depth_ratio) for r in H.causal_depth(spark.createDataFrame(rows, "graph_id string, src string, dst string")).collect()}
    assert depths(edges) == linear(edges)[0] and not seen
    assert depths(edges + rounds) == linear(edges + rounds)[0] and seen == [5]
