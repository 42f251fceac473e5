"""Euler tours, sums along lists and over subtrees, against plain recursion."""

import random

from provgraph.operators.tours import euler_tour, list_sums, subtree_sums


def plain(parents, weight):
    """node -> (size, leaves, weight) over subtrees; children have larger numbers than their parents."""
    out = {v: [1, 0, weight[v]] for v in parents}
    has = set(parents.values())
    for v in sorted(parents, reverse=True):
        out[v][1] = out[v][1] or int(v not in has)
        if parents[v] is not None:
            for i in range(3):
                out[parents[v]][i] += out[v][i]
    return {v: tuple(x) for v, x in out.items()}


def forests():
    rng = random.Random(5)
    yield {v: None if v % 97 == 0 else rng.randrange(v - v % 97, v) for v in range(500)}
    yield {0: None} | {v: v - 1 for v in range(1, 300)}  # a chain
    yield {0: None} | {v: 0 for v in range(1, 300)}  # a star
    order = list(range(400))
    rng.shuffle(order)
    yield {0: None} | {v: rng.randrange(max(0, v - 3), v) for v in range(1, 400)}


def test_subtrees(spark):
    for parents in forests():
        weight = {v: v * 7 % 13 for v in parents}
        tree = spark.createDataFrame([(v, p, weight[v]) for v, p in parents.items()], "node bigint, parent bigint, w bigint")
        got = {r.node: r for r in subtree_sums(tree, ["w"]).collect()}
        assert {v: (r["size"], r.leaves, r.w) for v, r in got.items()} == plain(parents, weight)
        for v, p in parents.items():
            if p is not None:
                assert got[p].behind - got[p]["size"] < got[v].behind - got[v]["size"] + 1 <= got[v].behind < got[p].behind


def test_lists_in_any_order(spark):
    """Numbers without any order along the lists, small blocks and several lists: what no task can join up is ranked by jumps."""
    rng = random.Random(6)
    arcs = rng.sample(range(100_000), 700)
    follows = {a: (b if k % 250 else None) for k, (a, b) in enumerate(zip(arcs, arcs[1:] + [None]), 1)}
    want, total = {}, 0
    for a in reversed(arcs):
        total = (total if follows[a] is not None else 0) + a % 5
        want[a] = total
    table = spark.createDataFrame([(a, n, a % 5) for a, n in follows.items()], "arc bigint, next bigint, v bigint")
    for block in (1, 64, 1 << 18):
        assert {r.arc: r.v for r in list_sums(table, ["v"], block).collect()} == want


def test_empty(spark):
    assert subtree_sums(spark.createDataFrame([], "node bigint, parent bigint")).count() == 0
    assert euler_tour(spark.createDataFrame([(0, None)], "node bigint, parent bigint")).collect()[0] in [(0, 1), (1, None)]
