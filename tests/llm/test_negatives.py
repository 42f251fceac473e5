"""Hard negatives against brute force over all rows, and what the bounds save."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import oracle
import pytest

from provgraph.llm import negatives
from provgraph.llm import queries as Q

SCHEMA = "vec_id bigint, embedding array<double>, label int, anchor string, row int, block int"


def brute(rows, every=100, k=5, percent=80):
    """The result's rows with their numbers, by all pairs in plain integers."""
    used = []
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        used.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = Counter()
    for a, label, v in used:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other == label) for i, other, w in used if i != a and len(w) == len(v))
        for p, i, _ in [x for x in scored if x[2]][:k]:
            fits = [(-s, j) for s, j, same in scored if not same and percent * -p <= 100 * -s <= 100 * -p][:k]
            out.update((a, i, n, j, -p, s) for n, (s, j) in enumerate(fits, 1))
    return out


def told(df):
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def clouds(n, seed, dims=12, labels=4):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 0.3, (6, dims))
    return [(i, (middle[rng.integers(6)] + rng.normal(0, 0.08, dims)).tolist(), int(rng.integers(labels)), "x", 1, 1) for i in range(n)]


@pytest.mark.parametrize("block_rows", [50, 10_000])
def test_against_all_pairs(spark, block_rows):
    rows = clouds(700, 1)
    rows += [(1000 + i, rows[3][1], i % 3, "x", 1, 1) for i in range(150)]  # one vector that many rows share: ties by id
    got = told(negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), every=50, block_rows=block_rows))
    assert got == brute(rows, every=50) and len(got) > 100


def test_odd_rows(spark):
    rows = clouds(120, 2, dims=3)
    more = [(200, None, 1), (300, [0.1, None, 0.2], 1), (400, [0.1, math.nan, 0.2], 1), (500, [math.inf, 0.0, 0.0], 1), (None, [0.1, 0.2, 0.3], 1), (600, [0.1, 0.2, 0.3], None), (700, [], 1), (701, [], 2), (702, [], 1), (800, [0.5, 0.1], 1), (801, [0.5, 0.1], 1), (802, [0.5, 0.09], 2)]
    more += [(900, [-0.5, 0.5, -0.5], 3), (1000, [0.0, 0.0, 0.0], 2), (1001, [0.0, 0.0, 0.0], 2), (-100, [0.4, 0.1, 0.2], 1), (-7, [0.4, 0.1, 0.2], 9)]
    rows += [(*r, "x", 1, 1) for r in more] + rows[:30]
    got = told(negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), every=100, block_rows=40))
    assert got == brute(rows)
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(1, [0.1], 1, "x", 1, 1)], SCHEMA)).count() == 0


def test_bounds_shrink_the_scan():
    """On vectors whose weight lies in few dimensions most cells are never read, and the answer is that of all cells."""
    rng = np.random.default_rng(4)
    cells = np.floor(rng.normal(0, 1, (64, 4000)) * np.geomspace(400, 1, 64)[:, None]).astype("<i4")
    ids = np.arange(4000, dtype="<i8")
    block = negatives.Block(4000, ids.tobytes(), (ids * 0).tobytes(), cells.tobytes())
    query = cells[:, 7].astype(np.int64)
    rows, scores, read = negatives.bond_scan(block, query, np.arange(4000), negatives._largest(5))
    exact = query @ cells.astype(np.int64)
    assert negatives._best(ids[rows], scores, 5) == negatives._best(ids, exact, 5) and read < 0.5 * cells.size


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op12_equals_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    got = Q.op12_bond_scan(spark, path)
    assert oracle.difference(got, oracle.connect(path), Q.OP12_SQL) == "" and got.count() > 0
