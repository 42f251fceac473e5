"""Vectors on graphs against a plain loop."""

import math
import random
from statistics import fmean, median

from provgraph.operators import pooling as L


def test_outlier_in_a_later_component(spark):
    r = random.Random(8)
    held = {g: [[r.gauss(0, 1) for _ in range(6)] for _ in range(30)] for g in ("a", "b")}
    held["b"][4][5] = 60.0
    table = spark.createDataFrame([(g, n, v) for g, vs in held.items() for n, v in enumerate(vs)], "graph_id string, node int, vec array<double>")
    found = {(x.graph_id, x.node): x.x for x in L.centre_distances(table).collect()}
    ratio = {x.graph_id: x.ratio for x in L.anomaly_ratio(L.centre_distances(table)).collect()}
    for g, vs in held.items():
        centre = [fmean(c) for c in zip(*vs)]
        far = [math.dist(v, centre) for v in vs]
        assert all(abs(found[g, n] - x) < 1e-8 for n, x in enumerate(far))
        mad = median(abs(x - median(far)) for x in far)
        assert ratio[g] == round(fmean(0.6745 * abs(x - median(far)) / mad > 3.5 for x in far), 6)
    assert ratio["b"] > 0
