"""Smaller graphs that keep what matters: pruning by importance, visiting orders, depths and what a reduction costs."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provgraph.operators.graph import endpoints, importance, k_hop
from provgraph.operators.ranking import numbered
from provgraph.operators.small import HELD, per_graph, split
from provgraph.session import Scratch, materialize

#: Levels that ``graded_depths`` looks at.
ROUNDS = 12


def prune_graph(nodes: DataFrame, edges: DataFrame, target: int = 150, stage: int = 1, min_cov: float = 0.6, hops: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and map (graph_id, old_idx, new_idx) of graphs cut down to about ``target`` nodes.

    Tables: nodes (graph_id, node_idx, ...), edges (graph_id, stage, src, dst, ...). A graph of up to ``target`` nodes stays
    as it is. Of another stay its ``target`` most important nodes, the most important floor(min_cov * n) (at least one) of
    the n nodes of ``stage``, and, up to 1.5 * target nodes in all, what lies within ``hops`` of its min(5, target / 10) nodes
    of largest degree, by importance. If the first two are more than 1.5 * target, the least important go, of the stage too.
    Edges stay if both ends do; nodes are numbered again in the old order. Ties go to the smaller index. Nodes and edges
    without a graph, and edges to nodes that aren't listed, are left out. Empty tables give empty tables.
    """
    budget, keys = int(target * 1.5), ["graph_id", "node"]
    listed = nodes.select("graph_id", F.col("node_idx").alias("node")).where("graph_id is not null and node is not null").distinct()
    large = listed.groupBy("graph_id").agg(F.count("*").alias("_n")).where(F.col("_n") > target).select("graph_id")
    rows, links = listed.join(large.hint("merge"), "graph_id"), edges.join(large.hint("merge"), "graph_id", "left_semi")
    rated = materialize(importance(rows, links))
    order = Window.partitionBy("graph_id").orderBy(F.desc("importance"), "node")
    first = rated.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= target).select(*keys, "importance")
    at_stage = rated.join(endpoints(links.where(F.col("stage") == stage)).distinct().hint("merge"), keys, "left_semi")
    wanted = at_stage.groupBy("graph_id").agg(F.greatest(F.lit(1), F.floor(F.count("*") * min_cov)).alias("_k"))
    of_stage = numbered(at_stage, [F.desc("importance"), "node"], ["graph_id"], "_r").join(wanted.hint("merge"), "graph_id").where("_r < _k").select(*keys, "importance")
    chosen = materialize(first.unionByName(of_stage).distinct())
    degree = endpoints(links).groupBy(*keys).agg(F.count("*").alias("_d"))
    hubs = degree.withColumn("_r", F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("_d"), "node"))).where(F.col("_r") <= min(5, target // 10))
    near = rated.join(k_hop(links, hubs.select(*keys), hops).select(*keys).hint("merge"), keys, "left_semi").join(chosen.select(*keys).hint("merge"), keys, "left_anti")
    room = chosen.groupBy("graph_id").agg((F.lit(budget) - F.count("*")).alias("_room"))
    nearest = near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= budget - target).join(room.hint("merge"), "graph_id").where("_r <= _room").select(*keys, "importance")
    kept = chosen.unionByName(nearest).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= budget).select(*keys)
    small = listed.join(large.hint("merge"), "graph_id", "left_anti")
    mapping = materialize(small.unionByName(kept).withColumn("new_idx", F.row_number().over(Window.partitionBy("graph_id").orderBy("node")) - 1).select("graph_id", F.col("node").alias("old_idx"), "new_idx"))
    end = lambda c: mapping.select("graph_id", F.col("old_idx").alias(c), F.col("new_idx").alias(f"_{c}")).hint("merge")
    cut = edges.join(end("src"), ["graph_id", "src"]).join(end("dst"), ["graph_id", "dst"]).withColumns({"src": F.col("_src"), "dst": F.col("_dst")}).select(edges.columns)
    return nodes.join(end("node_idx"), ["graph_id", "node_idx"]).withColumn("node_idx", F.col("_node_idx")).select(nodes.columns), cut, mapping


def retention_report(nodes: DataFrame, edges: DataFrame, kept_nodes: DataFrame, kept_edges: DataFrame) -> DataFrame:
    """(graph_id, stage, before, after, retention): how many nodes (stage ``nodes``) and edges (``edges``, and each stage by its number) of a graph a reduction keeps.

    A stage or graph of which nothing is kept has retention 0; one that had nothing has no row.
    """

    def counted(node_rows: DataFrame, edge_rows: DataFrame, name: str) -> DataFrame:
        parts = node_rows.select("graph_id", F.lit("nodes").alias("stage")).unionByName(edge_rows.select("graph_id", F.explode(F.array(F.lit("edges"), F.col("stage").cast("string"))).alias("stage")))
        return parts.where("stage is not null").groupBy("graph_id", "stage").agg(F.count("*").alias(name))

    after = F.coalesce("after", F.lit(0))
    both = counted(nodes, edges, "before").join(counted(kept_nodes, kept_edges, "after"), ["graph_id", "stage"], "left")
    return both.select("graph_id", "stage", "before", after.alias("after"), F.round(after / F.col("before"), 6).alias("retention"))


def bfs_order(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(graph_id, node, pos): the order, from 0, in which a breadth-first search along the edges from each graph's start (graph_id, node) meets the nodes.

    Nodes found from an earlier node come first; those found from one node follow their names. One round a level: the new
    nodes take the least place among their finders. A level is numbered by graph; loops and repeated edges don't count.
    """
    step = materialize(edges.where("src != dst").select("graph_id", F.col("src").alias("node"), F.col("dst").alias("next")).distinct())
    front = materialize(start.select("graph_id", "node").groupBy("graph_id").agg(F.min("node").alias("node")).select("graph_id", "node", F.lit(0).cast("bigint").alias("pos")))
    seen, keys = front, ["graph_id", "node"]
    while not front.isEmpty():
        met = front.join(step.hint("merge"), keys).groupBy("graph_id", F.col("next").alias("node")).agg(F.min("pos").alias("_by"))
        new = met.join(seen.select(*keys).hint("merge"), keys, "left_anti")
        last = front.groupBy("graph_id").agg(F.max("pos").alias("_last"))
        front = materialize(numbered(new, ["_by", "node"], ["graph_id"], "_n").join(last.hint("merge"), "graph_id").select("graph_id", "node", (F.col("_last") + 1 + F.col("_n")).alias("pos")))
        seen = seen.unionByName(front)
    return seen


def _reached(src: list, dst: list, max_sources: int | None) -> tuple[int, int]:
    """Steps to the farthest node, summed over the sources of one small graph, and how many sources there are."""
    follow: dict = {}
    for a, b in zip(src, dst):
        if a is not None:
            follow.setdefault(a, set()).add(b)
    sources, steps = set(src) - (set(dst) - {None}), 0
    if max_sources is not None:
        sources = sorted(sources, key=lambda a: "" if a is None else hashlib.md5(a.encode()).hexdigest())[:max_sources]
    for source in sources:
        seen = front = {source}
        while front := {b for a in front for b in follow.get(a, ())} - seen:
            seen = seen | front
            steps += 1
    return steps, len(sources)


def graded_depths(step: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> DataFrame | None:
    """(graph_id, node, far) of nodes without edges in (graph_id, node, next; distinct): the steps to the farthest node, where levels tell them; None for none.

    Level by level the edges go whose node has none in. If no edge that a source can reach skips a level, all its
    paths to a node are equally long, so its farthest node is as far as its longest path goes, which comes back from the last
    level to the first. Other sources (of an edge that skips one, leads to a cycle or past ``rounds`` levels) have no row. Each edge is read a few
    times, however many sources reach it.
    """
    keys, levels, size = ["graph_id", "node"], [], step.count()
    live = step
    while size and len(levels) < rounds:
        fed = scratch.table(live.select("graph_id", F.col("next").alias("node")).distinct())
        marks = fed.select(*(F.col(c).alias(f"_{c}") for c in keys)).hint("merge")
        told = scratch.table(live.join(marks, (F.col("graph_id") == F.col("_graph_id")) & (F.col("node") == F.col("_node")), "left").select("graph_id", "node", "next", F.col("_node").isNotNull().alias("_fed")))
        before, size = size, told.where("_fed").count()
        if size == before:
            break
        levels.append(told.where("not _fed"))
        live = told.where("_fed").select("graph_id", "node", "next")
    deeper, none = live.unionByName(live.select("graph_id", "node", F.col("node").alias("next"))) if size else None, F.lit(None).cast("int")
    after = None
    for gone in reversed(levels):
        whole = F.col("graph_id").isNotNull() & F.col("node").isNotNull() & F.col("next").isNotNull()
        below = [] if after is None else [after]
        below += [] if deeper is None else [deeper.select("graph_id", F.col("next").alias("node"), none.alias("far")).where("node is not null").distinct()]
        steps = gone.select("graph_id", "node", F.when(whole, 1).alias("_far"))
        if below:
            ahead = reduce(DataFrame.unionByName, below).select(F.col("graph_id").alias("_g"), F.col("node").alias("_v"), "far").hint("merge")
            joined = gone.join(ahead, (F.col("graph_id") == F.col("_g")) & (F.col("next") == F.col("_v")), "left")
            steps = joined.select("graph_id", "node", F.when(whole, F.when(F.col("_v").isNull(), 1).otherwise(F.col("far") + 1)).alias("_far"))
        after = scratch.table(steps.groupBy(*keys).agg(F.when(F.count("_far") == F.count("*"), F.max("_far")).alias("far")))
        edges = gone.select("graph_id", "node", "next")
        deeper = edges if deeper is None else deeper.unionByName(edges)
    return None if after is None else after.where("far is not null")


def chain_depth(edges: DataFrame, max_sources: int | None = 50, held: int = HELD, rounds: int = ROUNDS) -> DataFrame:
    """(graph_id, chain_depth): over nodes without edges in, the mean number of steps to the farthest node that each reaches, over 6 and at most 1.

    ``max_sources`` takes the sources of least md5 (None: all); a graph without sources has 0. Graphs of up to ``held`` edges are searched whole
    in tasks. Of larger ones ``graded_depths`` tells the sources that levels settle, and ``_searched`` searches from the others.
    """
    scratch = Scratch(edges.sparkSession)
    small, large = split(edges.select("graph_id", "src", "dst"), scratch, held)
    parts = [] if small is None else [per_graph(small, lambda a, b: _reached(a, b, max_sources), "_steps bigint, _sources bigint")]
    if large is not None:
        parts.append(_large_depths(large, max_sources, rounds, scratch))
    mean = F.when(F.col("graph_id").isNotNull() & (F.col("_sources") > 0), F.col("_steps") / F.col("_sources")).otherwise(0.0)
    result = scratch.table(reduce(DataFrame.unionByName, parts).select("graph_id", F.round(F.least(mean / 6, F.lit(1.0)), 6).alias("chain_depth")))
    scratch.drop_others(result)
    return result


def _large_depths(edges: DataFrame, max_sources: int | None, rounds: int, scratch: Scratch) -> DataFrame:
    """(graph_id, _steps, _sources): the sums over the sources of each graph."""
    keys = ["graph_id", "node"]
    every = edges.select("graph_id").distinct()
    step = scratch.table(edges.select("graph_id", F.col("src").alias("node"), F.col("dst").alias("next")).distinct())
    sources = step.select(*keys).distinct().join(step.select("graph_id", F.col("next").alias("node")).distinct().hint("merge"), keys, "left_anti")
    if max_sources is not None:
        sources = numbered(sources, [F.md5(F.col("node").cast("string")), "node"], ["graph_id"], "_n").where(F.col("_n") < max_sources).select(*keys)
    sources = scratch.table(sources)
    graded = graded_depths(step, scratch, rounds)
    steps, open_sources = [], sources
    if graded is not None:
        steps.append(sources.join(graded.hint("merge"), keys).groupBy("graph_id").agg(F.sum("far").cast("bigint").alias("_steps")))
        open_sources = scratch.table(sources.join(graded.select(*keys).hint("merge"), keys, "left_anti"))
    if not open_sources.isEmpty():
        steps.append(_searched(step, open_sources, scratch))
    total = sources.groupBy("graph_id").agg(F.count("*").alias("_sources"))
    summed = reduce(DataFrame.unionByName, steps).groupBy("graph_id").agg(F.sum("_steps").alias("_steps")) if steps else total.select("graph_id", F.lit(0).cast("bigint").alias("_steps"))
    return every.join(total.hint("merge"), "graph_id", "left").join(summed.hint("merge"), "graph_id", "left").select("graph_id", F.coalesce("_steps", F.lit(0)).alias("_steps"), F.coalesce("_sources", F.lit(0)).alias("_sources"))


def _searched(step: DataFrame, sources: DataFrame, scratch: Scratch) -> DataFrame:
    """(graph_id, _steps): the steps to the farthest node, summed over the sources (graph_id, node) along the edges (graph_id, node, next).

    All sources are searched at once: a source is one bit of a 63-bit word, a node holds the words of the sources that have reached it and that did so in the last
    round. A round ors what its neighbours pass on, which combines before it is shuffled, so it writes one row a node and word, not
    one a source and node. The search ends when no node gets a new source.
    """
    keys, alive = ["graph_id", "node", "word"], []
    bit = F.expr("shiftleft(1L, cast(_n % 63 as int))")
    placed = numbered(sources, ["node"], ["graph_id"], "_n")
    state = scratch.table(placed.select("graph_id", "node", F.floor(F.col("_n") / 63).cast("int").alias("word"), bit.alias("seen"), bit.alias("new")))
    while True:
        given = state.where("new != 0").join(step.hint("merge"), ["graph_id", "node"]).groupBy("graph_id", F.col("next").alias("node"), "word").agg(F.bit_or("new").alias("_got"))
        old, got = F.coalesce("seen", F.lit(0).cast("bigint")), F.coalesce("_got", F.lit(0).cast("bigint"))
        after = scratch.table(state.drop("new").join(given.hint("merge"), keys, "full").select(*keys, old.bitwiseOR(got).alias("seen"), got.bitwiseAND(F.bitwise_not(old)).alias("new")))
        scratch.drop(state)
        state = after
        fresh = scratch.table(state.where("new != 0").groupBy("graph_id", "word").agg(F.bit_or("new").alias("_new")))
        if fresh.isEmpty():
            break
        alive.append(fresh.select("graph_id", F.bit_count("_new").cast("bigint").alias("_steps")))  # a source has news in each round up to its farthest node
    none = sources.select("graph_id", F.lit(0).cast("bigint").alias("_steps")).distinct()
    return reduce(DataFrame.unionByName, alive, none).groupBy("graph_id").agg(F.sum("_steps").alias("_steps"))
