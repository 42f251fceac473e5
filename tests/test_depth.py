"""Depth and cut vertices of large graphs against linear searches, and their parts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
from plain_graphs import cut_vertices, longest_path
from pyspark.sql import functions as F

from provgraph.operators import depth as H
from provgraph.operators import graph as A
from provgraph.operators import reduce as B
from provgraph.operators.ranking import exact_quantile
from provgraph.plans.views import view

SF = "/root/testdata/sf0.001"


def told(spark, edges):
    table = spark.createDataFrame(edges, "graph_id string, src string, dst string")
    depths = {r.graph_id: (r.depth, r.depth_ratio) for r in H.causal_depth(table).collect()}
    cuts = {r.graph_id: r.articulation for r in H.articulation_count(table).collect()}
    return depths, cuts


def linear(edges):
    depths, cuts = {}, {}
    for g in {e[0] for e in edges if None not in e}:
        pairs = sorted({e[1:] for e in edges if e[0] == g and None not in e})
        names = {x: i for i, x in enumerate(sorted({x for p in pairs for x in p}))}
        src, dst = (np.array([names[p[k]] for p in pairs]) for k in (0, 1))
        far = longest_path(len(names), src, dst)
        depths[g], cuts[g] = (far, round(far / len(names), 6)), cut_vertices(len(names), src, dst)
    return depths, cuts


def test_shapes(spark):
    """A hub with a third of all edges, a cycle, a long path, trees of triangles, loops, repeats, nulls and a graph of one node."""
    rng = random.Random(8)
    edges = [("hub", "h", f"x{i}") for i in range(300)] + [("hub", f"x{i}", f"x{i + 1}") for i in range(0, 200, 3)]
    edges += [("cycle", f"c{i}", f"c{(i + 1) % 25}") for i in range(25)] + [("cycle", "c3", "tail"), ("cycle", "tail", "end")]
    edges += [("path", f"p{i:03}", f"p{i + 1:03}") for i in range(40)]
    edges += [("cactus", f"{a}", f"{b}") for k in range(30) for a, b in ((k, 30 + 2 * k), (30 + 2 * k, 31 + 2 * k), (31 + 2 * k, k), (k, k // 2))]
    edges += [("random", str(rng.randrange(80)), str(rng.randrange(80))) for _ in range(95)] + [("loop", "a", "a"), ("null", None, "b"), (None, "a", "b")]
    edges += [("two", "a", "b"), ("two", "b", "a"), ("two", "c", "d")] + edges[:50]
    assert told(spark, edges) == linear(edges)
    assert told(spark, []) == ({}, {})


def test_trade_graph(spark):
    """The one large graph of the given tables, whole."""
    table = view(spark, SF, "trade_edges")
    edges = [(r.graph_id, r.src, r.dst) for r in table.collect()]
    depths, cuts = linear(edges)
    assert {r.graph_id: (r.depth, r.depth_ratio) for r in H.causal_depth(table).collect()} == depths
    assert {r.graph_id: r.articulation for r in H.articulation_count(table).collect()} == cuts


def test_strong_components(spark):
    """Cycles that meet, cycles in a row, and what lies on none."""
    rng = random.Random(4)
    links = [(a, b) for k in range(12) for a, b in ((10 * k + 1, 10 * k + 2), (10 * k + 2, 10 * k + 3), (10 * k + 3, 10 * k + 1), (10 * k + 3, 10 * k + 11))]
    links += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(75)]
    got = {r.node: r.component for r in H.strong_components(spark.createDataFrame(links, "s bigint, d bigint")).collect()}
    reach = {}
    for u in {x for p in links for x in p}:
        seen, todo = set(), [u]
        while todo:
            v = todo.pop()
            new = {b for a, b in links if a == v} - seen
            seen |= new
            todo += new
        reach[u] = seen
    want = {u: max(v for v in reach[u] if u in reach[v]) for u in reach if any(v != u and u in reach[v] for v in reach[u])}
    assert got == want


def test_range_extremes(spark):
    rng = random.Random(9)
    low, high = [rng.randrange(1000) for _ in range(700)], [rng.randrange(1000) for _ in range(700)]
    spans = [(i, *sorted((rng.randrange(700), rng.randrange(700)))) for i in range(300)] + [(300, 0, 699), (301, 5, 5)] + [(302 + i, i, 699) for i in range(0, 699, 9)]
    values = spark.createDataFrame([(i, low[i], high[i]) for i in range(700)], "pos bigint, low bigint, high bigint")
    for fan in (2, 16):
        got = {r.id: (r.low, r.high) for r in H.range_extremes(values, spark.createDataFrame(spans, "id bigint, first bigint, last bigint"), fan).collect()}
        assert got == {i: (min(low[a : b + 1]), max(high[a : b + 1])) for i, a, b in spans}


def test_chain_depth(spark):
    """Many sources (more than one word of bits), a hub, cycles, and a path longer than any bound."""
    rng = random.Random(11)
    edges = [("many", f"s{i}", f"m{i % 7}") for i in range(200)] + [("many", f"m{i}", f"m{i + 1}") for i in range(9)]
    edges += [("path", f"{i}", f"{i + 1}") for i in range(80)] + [("path", f"q{i}", "79") for i in range(900)] + [("ring", "a", "b"), ("ring", "b", "a"), ("loop", "a", "a")]
    edges += [("random", str(rng.randrange(60)), str(rng.randrange(60))) for _ in range(70)] + [(None, "a", "b"), ("random", "x", "0")]
    table = spark.createDataFrame(edges, "graph_id string, src string, dst string")

    def plain(g, most=None):
        pairs = {e[1:] for e in edges if e[0] == g}
        into, far = {b for _, b in pairs}, []
        sources = sorted({a for a, _ in pairs} - into, key=lambda x: (hashlib.md5(x.encode()).hexdigest(), x))[:most]
        for s in sources:
            seen, front, hop = {s}, {s}, 0
            while front := {b for a, b in pairs if a in front} - seen:
                seen |= front
                hop += 1
            far.append(hop)
        return round(min((sum(far) / len(far) if far else 0) / 6, 1), 6)

    for most in (None, 5):
        got = {r.graph_id: r.chain_depth for r in B.chain_depth(table, most).collect()}
        assert {g: got[g] for g in ("many", "path", "ring", "loop", "random")} == {g: plain(g, most) for g in ("many", "path", "ring", "loop", "random")}


def test_exact_quantile(spark):
    """A hot group, a hot value, ties, one value, nulls and negative numbers, against numpy."""
    rng = random.Random(12)
    rows = [("hot", 1.5)] * 900 + [("hot", rng.gauss(0, 3)) for _ in range(501)] + [("one", 2.0), ("two", 1.0), ("two", 4.0), ("none", None), (None, 1.0), ("hot", None)] + [("ints", float(i % 11)) for i in range(100)]
    table = spark.createDataFrame(rows, "g string, x double").repartition(5)
    for share in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = {r.g: r.q for r in exact_quantile(table, "x", share, ["g"], "q").collect()}
        want = {g: float(np.quantile([x for h, x in rows if h == g and x is not None], share)) for g in ("hot", "one", "two", "ints")}
        assert set(got) == set(want) and all(abs(got[g] - want[g]) < 1e-12 for g in want)
    assert abs(exact_quantile(table, "x").first().quantile - float(np.median([x for _, x in rows if x is not None]))) < 1e-12


def test_pagerank_with_a_hub(spark):
    """A source of 30 % of the edges: the same ranks as by plain rounds, and no part much larger than the others."""
    rng = random.Random(14)
    pairs = [("h", f"x{i}") for i in range(600)] + [(f"x{rng.randrange(700)}", f"x{rng.randrange(700)}") for _ in range(1300)] + [(f"x{i}", "h") for i in range(100)]
    names = sorted({x for p in pairs for x in p})
    edges = spark.createDataFrame([("g", a, b) for a, b in pairs], "graph_id string, src string, dst string")
    nodes = spark.createDataFrame([("g", x) for x in names], "graph_id string, node string")
    rank, out = dict.fromkeys(names, 1 / len(names)), Counter(a for a, _ in pairs)
    for _ in range(20):
        got = defaultdict(float)
        for a, b in pairs:
            got[b] += rank[a] / out[a]
        rank = {x: 0.15 / len(names) + 0.85 * got[x] for x in names}
    for hub in (25, 50_000):
        found = {r.node: r["rank"] for r in A.pagerank(nodes, edges, hub=hub).collect()}
        assert set(found) == set(names) and all(abs(found[x] - rank[x]) < 1e-12 for x in names)
    salted, sizes = A.salted_sources(edges.distinct(), 25)
    sizes = sorted(r["count"] for r in salted.repartition(8, "graph_id", "src", "_salt").groupBy(F.spark_partition_id()).count().collect())
    assert sizes[-1] < 2 * sizes[len(sizes) // 2]


def test_chain_depth_of_large_graphs(spark):
    """By rounds as within tasks: levels skipped, cycles, nulls, and more levels than are looked at."""
    rng = random.Random(12)
    edges = [("layers", f"{k}-{rng.randrange(40)}", f"{k + 1}-{rng.randrange(40)}") for k in range(5) for _ in range(60)]
    edges += [("skips", f"{k}-{rng.randrange(40)}", f"{k + rng.choice((1, 1, 1, 2))}-{rng.randrange(40)}") for k in range(5) for _ in range(50)]
    edges += [("cycle", "a", "b"), ("cycle", "b", "c"), ("cycle", "c", "b"), ("cycle", "x", "y"), ("cycle", "c", "y"), ("path", "0", "1"), *(("path", f"{i}", f"{i + 1}") for i in range(8))]
    edges += [("null", None, "b"), ("null", "a", None), ("null", "c", "b"), (None, "a", "b"), ("loop", "a", "a")]
    table = spark.createDataFrame(edges, "graph_id string, src string, dst string")
    told = lambda **options: sorted(map(str, B.chain_depth(table, **options).collect()))
    assert told(max_sources=None) == told(max_sources=None, held=0) == told(max_sources=None, held=0, rounds=2)
    assert told(max_sources=4) == told(max_sources=4, held=30)


def test_chain_depth_by_levels(spark, monkeypatch):
    """600 sources that all reach the same nodes, by paths of one length: levels tell their depths without a search a source."""
    edges = [("layers", f"{k}-{i}", f"{k + 1}-{j}") for k, n in enumerate((600, 60, 6)) for i in range(n) for j in {i % 6, i % (n // 10 or 1)}]
    edges += [("layers", "0-0", "leaf"), ("layers", "1-3", "end"), ("ends early", "a", "b")]
    monkeypatch.setattr(B, "_searched", lambda *_: 1 / 0)
    got = B.chain_depth(spark.createDataFrame(edges, "graph_id string, src string, dst string"), None, held=0).collect()
    assert {r.graph_id: r.chain_depth for r in got} == {"layers": 0.5, "ends early": 0.166667}


def test_articulation_within_tasks_and_by_rounds(spark, monkeypatch):
    """Small graphs take no round; the counts are those of a linear search either way."""
    rng = random.Random(21)
    edges = [(f"g{g}", str(rng.randrange(30)), str(rng.randrange(30))) for g in range(12) for _ in range(10 + 3 * g)] + [("loop", "a", "a"), ("null", None, "b"), (None, "a", "b"), ("path", "a", "b"), ("path", "b", "c")]
    table = spark.createDataFrame(edges, "graph_id string, src string, dst string")
    want = linear(edges)[1]
    assert {r.graph_id: r.articulation for r in H.articulation_count(table, held=30).collect()} == want
    monkeypatch.setattr(H, "cut_vertices", lambda *_: 1 / 0)
    assert {r.graph_id: r.articulation for r in H.articulation_count(table).collect()} == want


def test_pagerank_within_tasks_and_by_rounds(spark, monkeypatch):
    """Small graphs take no round; ranks are the same, with repeated edges, loops, nulls, nodes that aren't listed and nodes without edges."""
    rng = random.Random(23)
    edges = [(f"g{g}", rng.randrange(30), rng.randrange(30)) for g in range(8) for _ in range(10 + 5 * g)] + [("g1", 3, 3), ("g1", None, 4), ("g1", 4, None), (None, 1, 2), ("g2", 99, 1), ("g2", 1, 99)]
    nodes = [(f"g{g}", k) for g in range(8) for k in range(30 + g)] + [("alone", 1), ("alone", 2), (None, 1), ("g1", None)]
    edges, nodes = spark.createDataFrame(edges, "graph_id string, src int, dst int"), spark.createDataFrame(nodes, "graph_id string, node int")
    told = lambda **options: {(r.graph_id, r.node): r["rank"] for r in A.pagerank(nodes, edges, **options).collect()}
    want, some = told(held=0), told(held=60)
    monkeypatch.setattr(A, "_rounds", lambda *_: 1 / 0)
    found = told()
    assert set(found) == set(want) == set(some) and all(abs(found[k] - want[k]) < 1e-12 and abs(some[k] - want[k]) < 1e-12 for k in want)
