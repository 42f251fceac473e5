"""Samples, orders and depths against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from provgraph.operators import corpora as K
from provgraph.operators import depth as H
from provgraph.operators import graph as A
from provgraph.operators import pooling as L
from provgraph.operators import reduce as B
from provgraph.operators.ranking import numbered


def graphs(seed, n, nodes, edges):
    r = random.Random(seed)
    return [(f"g{g}", r.randrange(nodes), r.randrange(nodes)) for g in range(n) for _ in range(r.randrange(1, edges))]


@pytest.fixture(scope="module")
def rows():
    return graphs(3, 40, 12, 24)


@pytest.fixture(scope="module")
def edges(spark, rows):
    return spark.createDataFrame(rows, "graph_id string, src int, dst int")


def by_graph(rows):
    out = defaultdict(set)
    for g, a, b in rows:
        out[g].add((a, b))
    return out


def reach(pairs, start):
    seen, todo = {start}, [start]
    while todo:
        u = todo.pop()
        for a, b in pairs:
            if a == u and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_numbered(spark):
    table = spark.createDataFrame([(g, i) for i in range(1000) for g in ("a", None, "b")] + [("c", 5)], "g string, x int").repartition(7)
    got = defaultdict(list)
    for r in numbered(table, [F.desc("x")], ["g"]).collect():
        got[r.g].append((r.n, r.x))
    assert all(sorted(v) == [(i, x) for i, x in enumerate(sorted((x for _, x in v), reverse=True))] for v in got.values()) and len(got[None]) == 1000
    assert sorted(r.n for r in numbered(table.where("g = 'a'"), ["x"]).collect()) == list(range(1000)) and numbered(table.limit(0), ["x"]).count() == 0


def test_depth_and_cuts(edges, rows):
    expected = {}
    for g, pairs in by_graph(rows).items():
        nodes = {x for p in pairs for x in p}
        to = {u: reach(pairs, u) for u in nodes}
        part = {u: min(v for v in nodes if v in to[u] and u in to[v]) for u in nodes}
        links = {(part[a], part[b]) for a, b in pairs if part[a] != part[b]}

        def far(u):
            return max((1 + far(b) for a, b in links if a == u), default=0)

        both = pairs | {(b, a) for a, b in pairs}
        whole = len({min(reach(both, u)) for u in nodes})
        cuts = 0
        for v in nodes:
            left = {(a, b) for a, b in both if v not in (a, b)}
            rest = nodes - {v}
            cuts += len(nodes) > 2 and len({min(reach(left, u)) for u in rest}) > whole - (not any(v in p and p[0] != p[1] for p in pairs))
        expected[g] = (max(far(part[u]) for u in nodes), cuts)
    assert {r.graph_id: (r.depth, r.articulation) for r in H.causal_depth(edges).join(H.articulation_count(edges), "graph_id").collect()} == expected


def test_bfs_order(edges, rows):
    start = edges.groupBy("graph_id").agg(F.min("src").alias("node"))
    got = defaultdict(dict)
    for r in B.bfs_order(edges, start).collect():
        got[r.graph_id][r.pos] = r.node
    for g, pairs in by_graph(rows).items():
        first = min(a for a, _ in pairs)
        order, seen = [first], {first}
        for u in order:
            new = sorted(b for a, b in pairs if a == u and b not in seen)
            order += new
            seen |= set(new)
        assert [got[g][i] for i in range(len(got[g]))] == order


def test_sample_bfs(spark):
    r = random.Random(5)
    rows = [(i, r.randrange(60), r.randrange(60)) for i in range(400)] + [(1000 + i, 0, 100 + i) for i in range(300)]
    edges = spark.createDataFrame(rows, "edge_id int, src int, dst int")
    seeds = spark.createDataFrame([(f"s{n}", n) for n in (0, 5, 9, 77)], "sample_id string, node int")
    got = [tuple(x) for x in K.sample_bfs(edges, seeds, 62, 30).select("sample_id", "edge_id", "src", "dst", "hop").collect()]
    again = [tuple(x) for x in K.sample_bfs(edges.repartition(9), seeds, 62, 30).select("sample_id", "edge_id", "src", "dst", "hop").collect()]
    assert sorted(got) == sorted(again) and {x[0] for x in got} == {"s0", "s5", "s9"}
    for s, node in (("s0", 0), ("s5", 5), ("s9", 9)):
        own = [x for x in got if x[0] == s]
        pairs = {(a, b) for _, _, a, b, _ in own} | {(b, a) for _, _, a, b, _ in own}
        assert len(own) == 62 == len({x[1] for x in own}) and reach(pairs, node) == {x for p in pairs for x in p}
    avoided = K.sample_bfs(edges, seeds, 62, 30, avoid=spark.createDataFrame([(5,)], "node int"))
    assert avoided.where("src = 5 or dst = 5").count() == 0
    assert K.sample_bfs(edges, seeds.where("sample_id = 's0'"), 62, 1, fanout=3).where("hop = 1").count() == 3
    assert K.sample_bfs(edges, seeds.limit(0)).count() == 0


def test_build_corpus(spark):
    r = random.Random(6)
    edges = spark.createDataFrame([(i, r.randrange(400), r.randrange(400)) for i in range(1500)], "edge_id int, src int, dst int")
    truth = spark.createDataFrame([(i,) for i in range(0, 40)], "uuid int")
    samples, taken = K.build_corpus(edges, truth, 4, 3, target=40, min_edges=20)
    assert sorted(x.label for x in samples.collect()) == [0, 0, 0, 1, 1, 1, 1]
    assert taken.where("sample_id like 'neg%' and (src < 40 or dst < 40)").count() == 0
    assert all(x.seed_node < 40 for x in samples.where("label = 1").collect())


def test_window_component(spark):
    r = random.Random(7)
    rows = [(i, f"n{r.randrange(30)}" if i % 4 else "far", f"n{r.randrange(30)}" if i % 4 else "away") for i in range(500)]
    got = K.sample_window_component(spark.createDataFrame(rows, "edge_id int, src string, dst string"), spark.createDataFrame([("w", 100)], "sample_id string, start int"), 20, 5).collect()
    assert len(got) == 20 and all(100 <= x.edge_id < 220 and x.src != "far" and x.src != x.dst for x in got)
    pairs = {(x.src, x.dst) for x in got} | {(x.dst, x.src) for x in got}
    assert reach(pairs, got[0].src) == {x for p in pairs for x in p}


def test_prune_shape(spark):
    """500 nodes down to 150: at most 225 stay, and no edge loses an end."""
    r = random.Random(42)
    nodes = spark.createDataFrame([("g", i, "MP") for i in range(500)] + [("small", i, "TP") for i in range(3)], "graph_id string, node_idx int, type string")
    edges = spark.createDataFrame([("g", s, r.randrange(500), r.randrange(500)) for s in (1, 2, 3, 4) for _ in range(200)] + [("small", 1, 0, 1)], "graph_id string, stage int, src int, dst int")
    kept, cut, mapping = B.prune_graph(nodes, edges)
    n = kept.where("graph_id = 'g'").count()
    assert 150 <= n <= 225 and kept.where("graph_id = 'small'").count() == 3 and mapping.count() == n + 3
    assert sorted(x.node_idx for x in kept.where("graph_id = 'g'").collect()) == list(range(n))
    assert cut.where(f"graph_id = 'g' and (src >= {n} or dst >= {n})").count() == 0 and B.prune_graph(nodes.limit(0), edges.limit(0))[0].count() == 0


def test_components_of_one_large_graph(spark):
    r = random.Random(8)
    pairs = {(r.randrange(3000), r.randrange(3000)) for _ in range(1600)} | {(5000, 5000 + i) for i in range(800)}
    got = {x.node: x.component for x in A.weak_components(spark.createDataFrame([("g", a, b) for a, b in pairs], "graph_id string, src int, dst int")).collect()}
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in parent}


def test_classifiers(spark):
    r = random.Random(9)
    rows = [(f"s{i}", y, y + r.gauss(0, 0.3), r.random()) for i in range(200) for y in [i % 2]]
    table = spark.createDataFrame(rows, "sample_id string, label int, signal double, noise double")
    scored = L.score_graphs(L.fit_classifier(table, ["signal", "noise"]), table, ["signal", "noise"])
    assert scored.where("(prob >= 0.5) = (label = 1)").count() > 180
    got = {x.feature_set: x.verdict for x in L.leakage_probe(table, {"surface": ["noise"], "structure": ["signal"]}).collect()}
    assert got == {"surface": "clean", "structure": "behaviour"}
