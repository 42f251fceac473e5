"""Graph algorithms and reduction over (graph_id, node) and (graph_id, src, dst)."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provgraph.operators.components import connected_components, joined_nodes, ranked
from provgraph.operators.ranking import numbered
from provgraph.operators.small import HELD, per_graph, split
from provgraph.session import Scratch, materialize


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select("graph_id", F.col("src").alias("node")).unionByName(edges.select("graph_id", F.col("dst").alias("node")))


def with_total(rows: DataFrame, total: Column, name: str, by: str = "graph_id") -> DataFrame:
    """``rows`` with an aggregate of their graph: a grouped value joined back, so that a large graph's rows stay spread over tasks."""
    return rows.join(rows.groupBy(F.col(by).alias("_of")).agg(total.alias(name)), F.col(by) == F.col("_of")).drop("_of")


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node, centrality): edges in and out over n - 1; 1 in a graph of one node."""
    deg = endpoints(edges).groupBy("graph_id", "node").agg(F.count("*").alias("_d"))
    joined = with_total(nodes.select("graph_id", "node"), F.count("*"), "_n").join(deg, ["graph_id", "node"], "left")
    return joined.select("graph_id", "node", F.round(F.when(F.col("_n") > 1, F.coalesce("_d", F.lit(0)) / (F.col("_n") - 1)).otherwise(1.0), 6).alias("centrality"))


def salted_sources(weights: DataFrame, hub: int) -> tuple[DataFrame, DataFrame]:
    """Edges (graph_id, src, dst, ...) with ``_salt``, which deals a source of more than ``hub`` edges over as many parts of about that size, and (graph_id, src, _salts) of those sources."""
    sizes = weights.groupBy("graph_id", "src").agg(F.ceil(F.count("*") / hub).cast("int").alias("_salts")).where("_salts > 1")
    marked = weights.join(sizes.hint("merge"), ["graph_id", "src"], "left")
    return marked.withColumn("_salt", F.pmod(F.xxhash64("dst"), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts"), sizes


def _ranks(src: list, dst: list, of_edge: list, iterations: int, damping: float) -> tuple[list, list]:
    """The nodes of one small graph, of rows (src, dst) for edges and (src) for nodes, and their ranks."""
    nodes = [a for a, edge in zip(src, of_edge) if not edge]
    pairs = Counter((a, b) for a, b, edge in zip(src, dst, of_edge) if edge)
    out, copies, known = Counter(), Counter(nodes), set(nodes) - {None}
    for (a, _), m in pairs.items():
        out[a] += m
    given = [(a, b, copies[a] * m / out[a]) for (a, b), m in pairs.items() if a in known and b in known]
    one = 1.0 / len(nodes) if nodes else 0.0
    rank = dict.fromkeys(nodes, one)
    for _ in range(iterations):
        got = dict.fromkeys(rank, 0.0)
        for a, b, w in given:
            got[b] += w * rank[a]
        rank = {v: (1 - damping) * one + damping * x for v, x in got.items()}
    return nodes, [rank[v] for v in nodes]


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 20, damping: float = 0.85, cut: int = 5, hub: int = 50_000, held: int = HELD) -> DataFrame:
    """(graph_id, node, rank) after fixed rounds; several edges count, and nodes without edges out keep their mass to themselves.

    Graphs of up to ``held`` nodes and edges are ranked whole in tasks, larger ones by rounds of joins (``_rounds``).
    """
    node, scratch = nodes.schema["node"].dataType, Scratch(edges.sparkSession)
    listed = nodes.select("graph_id", F.col("node").alias("src"), F.lit(None).cast(edges.schema["dst"].dataType).alias("dst"), F.lit(False).alias("of_edge"))
    rows = listed.unionByName(edges.select("graph_id", "src", "dst", F.lit(True).alias("of_edge"))).where("graph_id is not null")
    small, large = split(rows, scratch, held, ["of_edge"])
    if small is None:
        return _rounds(nodes, edges, iterations, damping, cut, hub)
    found = per_graph(small, lambda a, b, e: _ranks(a, b, e, iterations, damping), "node array<string>, rank array<double>")
    ranks = found.select("graph_id", F.inline(F.arrays_zip("node", "rank"))).select("graph_id", F.col("node").cast(node).alias("node"), "rank")
    if large is not None:
        of_node, of_edge = large.where("not of_edge").select("graph_id", F.col("src").cast(node).alias("node")), large.where("of_edge").select("graph_id", "src", "dst")
        ranks = ranks.unionByName(_rounds(of_node, of_edge, iterations, damping, cut, hub))
    ranks = scratch.table(ranks)
    scratch.drop_others(ranks)
    return ranks


def _rounds(nodes: DataFrame, edges: DataFrame, iterations: int, damping: float, cut: int, hub: int) -> DataFrame:
    """``pagerank`` of graphs of any size.

    Edges are grouped by pair with their weight once. Weights are dealt by source and nodes by name into the same number of
    partitions and kept, so of a round only what the nodes give is shuffled, summed by target before it is; every ``cut`` rounds the ranks
    are written, so plans stay short and lost executors cost few rounds. A source of more than ``hub`` edges is split: its
    edges lie in several parts, each of which gets a copy of its rank; what a target gets is combined in its own part first, so neither kind of hub is one task.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = edges.groupBy("graph_id", "src").agg(F.count("*").alias("_o"))
    weights = edges.groupBy("graph_id", "src", "dst").agg(F.count("*").alias("_m")).join(out, ["graph_id", "src"]).select("graph_id", "src", "dst", (F.col("_m") / F.col("_o")).alias("_w"))
    weights, split = salted_sources(materialize(weights), hub)
    weights, split = materialize(weights), split.select("graph_id", F.col("src").alias("node"), "_salts")
    one = with_total(nodes.select("graph_id", "node"), F.count("*"), "_n").join(split.hint("merge"), ["graph_id", "node"], "left")
    one = materialize(one.select("graph_id", "node", (1.0 / F.col("_n")).alias("_one"), F.coalesce("_salts", F.lit(1)).alias("_salts")))
    weighted, base = weights.repartition(parts, "graph_id", "src", "_salt").persist(), one.repartition(parts, "graph_id", "node").persist()
    ranks = base.select("graph_id", "node", "_salts", F.col("_one").alias("rank"))
    for i in range(iterations):
        given = ranks.select("graph_id", F.col("node").alias("src"), "rank", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
        got = weighted.join(given.hint("shuffle_hash"), ["graph_id", "src", "_salt"]).groupBy("graph_id", F.col("dst").alias("node")).agg(F.sum(F.col("_w") * F.col("rank")).alias("_got"))
        ranks = base.join(got.hint("shuffle_hash"), ["graph_id", "node"], "left").select("graph_id", "node", "_salts", ((1 - damping) * F.col("_one") + damping * F.coalesce("_got", F.lit(0.0))).alias("rank"))
        if (i + 1) % cut == 0 or i + 1 == iterations:
            ranks = materialize(ranks)
    weighted.unpersist()
    base.unpersist()
    return ranks.select("graph_id", "node", "rank")


def stage_coverage(edges: DataFrame) -> DataFrame:
    """(graph_id, node, n_stages): in how many stages a node occurs."""
    ends = edges.select("graph_id", "stage", F.col("src").alias("node")).unionByName(edges.select("graph_id", "stage", F.col("dst").alias("node")))
    return ends.groupBy("graph_id", "node").agg(F.count_distinct("stage").alias("n_stages"))


def importance(nodes: DataFrame, edges: DataFrame, weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> DataFrame:
    """(graph_id, node, importance): PageRank times n, degree centrality, and stage coverage over the largest; halves round up (by 1e-9)."""
    joined = pagerank(nodes, edges).join(degree_centrality(nodes, edges), ["graph_id", "node"]).join(stage_coverage(edges), ["graph_id", "node"], "left").withColumn("_s", F.coalesce("n_stages", F.lit(0)))
    total = joined.groupBy("graph_id").agg(F.count("*").alias("_n"), F.greatest(F.max("_s"), F.lit(1)).alias("_most"))
    score = weights[0] * F.col("rank") * F.col("_n") + weights[1] * F.col("centrality") + weights[2] * (F.col("_s") / F.col("_most"))
    return joined.join(total, "graph_id").select("graph_id", "node", F.round(score + 1e-9, 6).alias("importance"))


def k_hop(edges: DataFrame, seeds: DataFrame, k: int = 3, directed: bool = False) -> DataFrame:
    """(graph_id, node, hop): nodes within k steps of the seeds, with the least number of steps."""
    step = edges.select("graph_id", F.col("src").alias("node"), F.col("dst").alias("next"))
    if not directed:
        step = step.unionByName(edges.select("graph_id", F.col("dst").alias("node"), F.col("src").alias("next")))
    step = materialize(step.where("node != next").distinct())
    seen = materialize(seeds.select("graph_id", "node").distinct().withColumn("hop", F.lit(0)))
    front = seen
    for hop in range(1, k + 1):
        reached = front.select("graph_id", "node").join(step, ["graph_id", "node"]).select("graph_id", F.col("next").alias("node")).distinct()
        front = materialize(reached.join(seen, ["graph_id", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(front)
    return seen


def weak_components(edges: DataFrame) -> DataFrame:
    """(graph_id, node, component): the smallest node joined with a node by edges in either direction, loops included; an edge with a null joins nothing."""
    key = lambda c: F.struct("graph_id", F.col(c).alias("node"))
    pair = lambda a, b: F.struct(key(a).alias("a"), key(b).alias("b"))
    whole = F.col("graph_id").isNotNull() & F.col("src").isNotNull() & F.col("dst").isNotNull()
    if edges.schema["src"].dataType == edges.schema["dst"].dataType and all(ranked(edges.schema[c].dataType) for c in ("graph_id", "src")):
        links = edges.select(F.inline(F.when(whole, F.array(pair("src", "dst"))).otherwise(F.array(pair("src", "src"), pair("dst", "dst")))))
        return joined_nodes(links).select("node.graph_id", "node.node", F.col("component.node").alias("component"))
    joined = connected_components(edges.where(whole).select(key("src").alias("a"), key("dst").alias("b")), "a", "b").select("node.graph_id", "node.node", F.col("component.node").alias("component"))
    every = endpoints(edges).distinct()
    return every.join(joined, ["graph_id", "node"], "left").select("graph_id", "node", F.coalesce("component", "node").alias("component"))


def compress_recent(edges: DataFrame, ratio: float, floor: int = 50, order: str = "edge_id") -> DataFrame:
    """A graph's newest max(floor, E * ratio) edges; graphs of up to ``floor`` edges stay whole."""
    ranked = with_total(numbered(edges, [F.desc(order)], ["graph_id"], "_r"), F.count("*"), "_e")
    return ranked.where(F.col("_r") < F.greatest(F.lit(floor), F.floor(F.col("_e") * ratio))).drop("_e", "_r")


def compression_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """(graph_id, before, after, ratio, loss): 1 - after / before, and what of it lies above one half."""
    b = before.groupBy("graph_id").agg(F.count("*").alias("before"))
    a = after.groupBy("graph_id").agg(F.count("*").alias("after"))
    ratio = 1 - F.coalesce("after", F.lit(0)) / F.col("before")
    return b.join(a, "graph_id", "left").select("graph_id", "before", F.coalesce("after", F.lit(0)).alias("after"), F.round(ratio, 6).alias("ratio"), F.round(F.greatest(F.lit(0.0), ratio - 0.5), 6).alias("loss"))
