"""Labelled corpora of subgraphs: breadth-first samples, window components, quotas, mixed sources and noise recipes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provgraph.operators.graph import weak_components
from provgraph.operators.joins import hold_out, restrict
from provgraph.operators.ranking import numbered
from provgraph.operators.sampling import draw, drawn_number, mix_in_noise, uniform
from provgraph.session import materialize

#: Shares that samples of another source are given (fixed values): node types, and edge codes with RF taking the rest.
NODE_SHARES = {"process": 0.29, "socket": 0.07}
EDGE_SHARES = {"FR": 0.15, "WF": 0.32, "EX": 0.05, "ST": 0.05, "RCV": 0.05}
#: Noise ratios of the corpora: of all families, of held-out families, of held-out variants (fixed values).
RATIOS = {"all": (0.0, 0.5, 1.0, 2.0), "families": (0.0, 3.0, 5.0, 7.0), "variants": (0.0, 1.0, 2.0)}


def edge_rings(edges: DataFrame, avoid: DataFrame | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges without those that touch a node of ``avoid``, the rows (node, _i, edge_id, next) that number each node's edges in the order of their draws, and (node, _degree)."""
    if avoid is not None:
        bad = avoid.select(F.col(avoid.columns[0]).alias("_bad")).distinct()
        for c in ("src", "dst"):
            edges = edges.join(bad.hint("merge"), F.col(c) == F.col("_bad"), "left_anti")
    ends = edges.select("edge_id", F.col("src").alias("node"), F.col("dst").alias("next")).unionByName(edges.where("src != dst").select("edge_id", F.col("dst").alias("node"), F.col("src").alias("next")))
    ring = materialize(numbered(ends.withColumn("_draw", draw(seed, "edge_id")), ["_draw", "edge_id"], ["node"], "_i").drop("_draw"))
    return edges, ring, materialize(ring.groupBy("node").agg(F.count("*").alias("_degree")))


def sample_bfs(edges: DataFrame, seeds: DataFrame, target: int = 62, min_edges: int = 30, avoid: DataFrame | None = None, fanout: int | None = None, seed: int = 0, rings: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """Edges with ``sample_id`` and ``hop``: for every seed (sample_id, node) the edges met breadth-first, up to ``target``.

    All seeds advance together, one join a level. The edges of a node lie in a ring, in the order of their draws, which a sample
    enters at a place of its own. A level takes its nodes in the order of their draws as far as the budget can need them; of the
    edges that each brings from its place on, at most ``target``, those not taken yet go into the sample in the order of their draws
    while the budget lasts. So a sample looks at fewer than 3 * target edges a level however many a node has, is connected and holds
    every edge once, and it stops short of the target only where its component ends. ``fanout`` bounds what one node brings to a level. Edges that
    touch a node of ``avoid`` (node) are never taken. Samples of fewer than ``min_edges`` edges are left out. Edges are
    (edge_id, src, dst, ...); loops count as edges. A seed without edges gives nothing. ``rings`` are
    what ``edge_rings`` gave for these edges, ``avoid`` and ``seed``, for callers that sample again.
    """
    edges, ring, degrees = rings or edge_rings(edges, avoid, seed)
    front = materialize(seeds.select("sample_id", "node").distinct())
    met, taken, hop = front, None, 0
    while not front.isEmpty():
        hop += 1
        asked, used = front.join(degrees.hint("merge"), "node"), F.lit(0)
        if taken is not None:
            asked, used = asked.join(taken.groupBy("sample_id").agg(F.count("*").alias("_used")).hint("merge"), "sample_id", "left"), F.coalesce("_used", F.lit(0))
        most = F.lit(target) if fanout is None else F.least(F.lit(target), fanout + used)  # of so many, as many as are wanted aren't taken yet
        asked = asked.withColumn("_left", target - used).where("_left > 0").withColumn("_offer", F.least("_degree", most))
        at = drawn_number(seed, "sample_id", "node")
        if fanout is None:  # an edge has two ends, so 2 * target offers hold target edges
            earlier = Window.partitionBy("sample_id").orderBy(at, "node").rowsBetween(Window.unboundedPreceding, -1)
            asked = asked.withColumn("_before", F.coalesce(F.sum("_offer").over(earlier), F.lit(0))).where(F.col("_before") < 2 * target)
        slots = asked.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.col("_offer").cast("int") - 1))).select("sample_id", "node", "_left", ((at + F.col("_slot")) % F.col("_degree")).alias("_i"))
        found = ring.join(slots.hint("merge"), ["node", "_i"])
        if taken is not None:
            found = found.join(taken.select("sample_id", "edge_id").hint("merge"), ["sample_id", "edge_id"], "left_anti")
        drawn = draw(seed, "sample_id", "edge_id")
        if fanout is not None:
            by_node = Window.partitionBy("sample_id", "node").orderBy(drawn, "edge_id")
            found = found.withColumn("_f", F.row_number().over(by_node)).where(F.col("_f") <= fanout).drop("_f")
        once = found.groupBy("sample_id", "edge_id", "_left").agg(F.collect_set("next").alias("next"))
        place = Window.partitionBy("sample_id").orderBy(drawn, "edge_id")
        level = materialize(once.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= F.col("_left")).select("sample_id", "edge_id", "next", F.lit(hop).alias("hop")))
        taken = level if taken is None else taken.unionByName(level)
        new = level.select("sample_id", F.explode("next").alias("node")).distinct().join(met.hint("merge"), ["sample_id", "node"], "left_anti")
        front = materialize(new)
        met = met.unionByName(front)
    if taken is None:
        return edges.limit(0).withColumns({"sample_id": F.lit(None).cast(seeds.schema["sample_id"].dataType), "hop": F.lit(0)})
    enough = taken.groupBy("sample_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_edges)
    kept = taken.select("sample_id", "edge_id", "hop").join(enough.select("sample_id").hint("merge"), "sample_id", "left_semi")
    return edges.join(kept.hint("merge"), "edge_id")


def build_corpus(edges: DataFrame, truth: DataFrame, n_pos: int, n_neg: int, seed: int = 0, target: int = 62, min_edges: int = 30, tries: int = 50) -> tuple[DataFrame, DataFrame]:
    """samples (sample_id, label, seed_node) and their edges: ``n_pos`` samples around marked nodes, ``n_neg`` around others that touch no marked node.

    Seeds are drawn in the order of their md5, first twice as many as are wanted, then doubled until enough samples are
    large enough or n * ``tries`` seeds were drawn. Truth is (uuid).
    """
    bad = truth.select(F.col("uuid").alias("node")).distinct()
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    parts = []
    for label, n, pool, avoid in ((1, n_pos, nodes.join(bad.hint("merge"), "node", "left_semi"), None), (0, n_neg, nodes.join(bad.hint("merge"), "node", "left_anti"), bad)):
        order = [draw(seed, "node"), F.col("node")]
        drawn, most, rings = 2 * n, n * tries, edge_rings(edges, avoid, seed)
        while True:
            picked = pool.orderBy(*order).limit(min(drawn, most))
            seeds = picked.select(F.concat(F.lit("pos_" if label else "neg_"), F.col("node").cast("string")).alias("sample_id"), "node", draw(seed, "node").alias("_draw"))
            seeds = materialize(seeds)
            got = materialize(sample_bfs(edges, seeds, target, min_edges, avoid, seed=seed, rings=rings))
            good = seeds.join(got.select("sample_id").distinct().hint("merge"), "sample_id", "left_semi")
            if drawn >= most or good.count() >= n or seeds.count() < drawn:
                break
            drawn *= 2
        first = materialize(good.orderBy("_draw", "node").limit(n))
        samples = first.select("sample_id", F.lit(label).alias("label"), F.col("node").alias("seed_node"))
        parts.append((samples, got.join(first.select("sample_id").hint("merge"), "sample_id", "left_semi")))
    return parts[0][0].unionByName(parts[1][0]), parts[0][1].unionByName(parts[1][1])


def sample_window_component(edges: DataFrame, starts: DataFrame, target: int = 62, min_edges: int = 30, seed: int = 0) -> DataFrame:
    """Edges with ``sample_id`` and ``hop``: from each start (sample_id, start) the next 6 * target edges by edge_id, of these the largest weak component, of that a breadth-first sample.

    The search begins at the component's node of most edges, ties to the smaller name; loops are left out; of components of
    one size the one with the smallest node counts.
    """
    placed = numbered(edges, ["edge_id"], name="_at")
    rows = starts.withColumn("_at", F.explode(F.sequence(F.col("start"), F.col("start") + 6 * target - 1))).select(F.col("sample_id").alias("graph_id"), "_at")
    window = materialize(placed.join(rows.hint("merge"), "_at").where("src != dst").drop("_at"))
    parts = materialize(weak_components(window.select("graph_id", "src", "dst")))
    largest = parts.groupBy("graph_id", "component").agg(F.count("*").alias("_n")).groupBy("graph_id").agg(F.min_by("component", F.struct(-F.col("_n"), "component")).alias("component"))
    inside = parts.join(largest.hint("merge"), ["graph_id", "component"], "left_semi").select("graph_id", "node")
    held = materialize(window.join(inside.hint("merge"), (window.graph_id == inside.graph_id) & (window.src == inside.node), "left_semi"))
    degree = held.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).groupBy("graph_id", "node").agg(F.count("*").alias("_d"))
    hub = degree.groupBy("graph_id").agg(F.min_by("node", F.struct(-F.col("_d"), "node")).alias("node"))
    tag = lambda c: F.concat_ws("\x1f", "graph_id", c)
    own = held.withColumns({"_edge": F.col("edge_id"), "edge_id": tag(F.col("edge_id").cast("string")), "_src": F.col("src"), "_dst": F.col("dst"), "src": tag("src"), "dst": tag("dst")})
    found = sample_bfs(own, hub.select(F.col("graph_id").alias("sample_id"), tag("node").alias("node")), target, min_edges, seed=seed)
    return found.withColumns({"edge_id": F.col("_edge"), "src": F.col("_src"), "dst": F.col("_dst")}).select(*edges.columns, "sample_id", "hop")


def assign_types_by_quota(edges: DataFrame, shares: Mapping[str, float] = NODE_SHARES) -> DataFrame:
    """(graph_id, node, type): the round(share * N) nodes (at least one) of most edges out are processes, of the rest the round(share * N) of least degree sockets, all others files.

    Rounding is half to even; ties go to larger degree for processes, then to the smaller name.
    """
    keys = ["graph_id", "node"]
    sides = edges.select("graph_id", F.col("src").alias("node"), F.lit(1).alias("o")).unionByName(edges.select("graph_id", F.col("dst").alias("node"), F.lit(0).alias("o")))
    degree = materialize(sides.groupBy(*keys).agg(F.sum("o").alias("_out"), F.count("*").alias("_d")))
    n = degree.groupBy("graph_id").agg(F.count("*").alias("_n"))
    ranked = numbered(degree, [F.desc("_out"), F.desc("_d"), "node"], ["graph_id"], "_p").join(n.hint("merge"), "graph_id")
    split = ranked.withColumn("_proc", F.col("_p") < F.greatest(F.lit(1), F.bround(F.col("_n") * shares["process"], 0)))
    rest = numbered(split.where("not _proc"), ["_d", "node"], ["graph_id"], "_s")
    others = rest.select(*keys, F.when(F.col("_s") < F.bround(F.col("_n") * shares["socket"], 0), "socket").otherwise("file").alias("type"))
    return split.where("_proc").select(*keys, F.lit("process").alias("type")).unionByName(others)


def assign_actions_by_quota(edges: DataFrame, types: DataFrame, shares: Mapping[str, float] = EDGE_SHARES, seed: int = 0) -> DataFrame:
    """(graph_id, edge_id, code): of a graph's E edges round(share * E) get each code, the others RF.

    Edges that touch a socket (types: graph_id, node, type) come first in the order of the draw, and the codes are dealt in
    the order ST, RCV, then the others by name, RF last: network codes go to sockets as far as there are any. Rounding is half to even.
    """
    order = [c for c in ("ST", "RCV") if c in shares] + sorted(c for c in shares if c not in ("ST", "RCV"))
    sockets = types.where("type = 'socket'").select("graph_id", "node")
    touching = edges.select("graph_id", "edge_id", F.explode(F.array("src", "dst")).alias("node")).join(sockets.hint("merge"), ["graph_id", "node"], "left_semi").select("graph_id", "edge_id").distinct().withColumn("_net", F.lit(0))
    drawn = edges.select("graph_id", "edge_id", draw(seed, "edge_id").alias("_draw")).join(touching.hint("merge"), ["graph_id", "edge_id"], "left").withColumn("_net", F.coalesce("_net", F.lit(1)))
    size = edges.groupBy("graph_id").agg(F.count("*").alias("_e"))
    placed = numbered(drawn, ["_net", "_draw", "edge_id"], ["graph_id"], "_at").join(size.hint("merge"), "graph_id")
    code, upto = F.lit("RF"), F.lit(0.0)
    bounds = []
    for c in order:
        upto = upto + F.bround(F.col("_e") * shares[c], 0)
        bounds.append((c, upto))
    for c, bound in reversed(bounds):
        code = F.when(F.col("_at") < bound, c).otherwise(code)
    return placed.select("graph_id", "edge_id", code.alias("code"))


def mix_sources(a: DataFrame, b: DataFrame, n: int, share: float = 0.3, seed: int = 0) -> DataFrame:
    """(slot, source, sample_id): for slots 1 to n a sample of ``b`` with chance ``share``, else of ``a`` (sample_id), by the draw; where a source is empty the other one serves.

    Samples of a source are taken in the order of their draws, round and round.
    """
    slots = a.sparkSession.range(1, n + 1).withColumnRenamed("id", "slot").withColumn("_b", uniform(seed, "slot") < share)
    sizes = a.agg(F.count("*").alias("_na")).crossJoin(b.agg(F.count("*").alias("_nb")))
    chosen = slots.crossJoin(F.broadcast(sizes)).withColumn("source", F.when(F.col("_b") & (F.col("_nb") > 0) | (F.col("_na") == 0), "b").otherwise("a"))
    number = numbered(chosen.where("_na + _nb > 0"), ["slot"], ["source"], "_k")
    ring = lambda df, name: numbered(df.select("sample_id", draw(seed, "sample_id").alias("_draw")), ["_draw", "sample_id"], name="_i").select(F.lit(name).alias("source"), "sample_id", "_i")
    pool = ring(a, "a").unionByName(ring(b, "b"))
    at = number.withColumn("_i", F.col("_k") % F.when(F.col("source") == "a", F.col("_na")).otherwise(F.col("_nb")))
    return at.join(pool.hint("merge"), ["source", "_i"]).select("slot", "source", "sample_id")


def reference_sample(vectors: DataFrame, labels: DataFrame, max_graphs: int = 30, max_nodes: int = 3000, seed: int = 0) -> DataFrame:
    """Vectors (graph_id, node, vec) of the first ``max_graphs`` graphs with label 0 (graph_id, label), at most ``max_nodes`` of them by the draw: both bounds are the feature."""
    first = labels.where("label = 0").select("graph_id").distinct().orderBy("graph_id").limit(max_graphs)
    return vectors.join(first.hint("merge"), "graph_id", "left_semi").withColumn("_draw", draw(seed, "graph_id", "node")).orderBy("_draw", "graph_id", "node").limit(max_nodes).drop("_draw")


def corpus_builder(samples: DataFrame, edges: DataFrame, recipe: str = "all", held_out: Sequence[str] = (), ratios: Sequence[float] | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """samples (sample_id, origin, label, camo_ratio) and edges (sample_id, edge_id, origin) of a test corpus: negatives as they are, and positives at each noise ratio.

    ``all`` takes every positive, ``families`` only those whose ``apt`` is held out, ``variants`` those whose
    ``variant_type`` is. Tables: samples (sample_id, label, apt, variant_type), edges (sample_id, edge_id). Noise comes from the
    negatives' edges, by ``mix_in_noise``.
    """
    column = {"all": None, "families": "apt", "variants": "variant_type"}[recipe]
    pos, neg = samples.where("label = 1"), samples.where("label = 0")
    if column:
        pos = restrict(pos, column, held_out)
    own = lambda df: edges.join(df.select("sample_id").hint("merge"), "sample_id", "left_semi")
    pool = own(neg)
    mixed = materialize(mix_in_noise(own(pos).withColumnRenamed("sample_id", "graph_id"), pool, ratios or RATIOS[recipe], seed))
    of = lambda name: F.regexp_replace("sample_id", r"__camo[0-9.]+$", "").alias(name)
    made = mixed.select("sample_id", of("origin"), F.lit(1).alias("label"), "camo_ratio").distinct()
    plain = neg.select("sample_id", F.col("sample_id").alias("origin"), F.lit(0).alias("label"), F.lit(0.0).alias("camo_ratio"))
    return made.unionByName(plain), mixed.select("sample_id", "edge_id", "origin").unionByName(pool.select("sample_id", "edge_id", F.lit("own").alias("origin")))


def train_corpus(samples: DataFrame, held_out: Sequence[str], column: str = "apt") -> DataFrame:
    """The samples that a model may learn from where ``held_out`` values of ``column`` are tested on."""
    return hold_out(samples, column, held_out)
