"""Cut vertices of large graphs by thinning: tasks replace their links by forests of blocks, rounds of joins take off what hangs on one node or runs in parallel.

Links are (graph_id, a, b) with text for nodes: a node's name behind ``v``, or a block's own name behind ``b``. A block stands for nodes that no
single node parts; it is a node itself, but none that counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.operators.components import connected_components
from provgraph.session import Scratch

#: Links that a task holds at a time.
CHUNK = 1 << 20
#: A round must leave fewer than this share of the links for another to follow.
SHRINK = 0.8


def _blocks(n: int, a: np.ndarray, b: np.ndarray) -> Iterator[list[int]]:
    """The nodes of each block (two for a bridge) of distinct links a < b between nodes 0 to n - 1, by Tarjan's search in depth."""
    tail, head = np.concatenate([a, b]), np.concatenate([b, a])
    heads = head[np.argsort(tail, kind="stable")].tolist()
    ends = np.cumsum(np.bincount(tail, minlength=n))
    at, end = [0, *ends[:-1].tolist()], ends.tolist()
    order, low, above, count = [0] * n, [0] * n, [-1] * n, 0
    for root in range(n):
        if order[root]:
            continue
        count += 1
        order[root] = low[root] = count
        path, open_ = [root], [root]
        while path:
            node = path[-1]
            if at[node] < end[node]:
                to = heads[at[node]]
                at[node] += 1
                if not order[to]:
                    count += 1
                    order[to] = low[to] = count
                    above[to] = node
                    path.append(to)
                    open_.append(to)
                elif to != above[node] and order[to] < low[node]:
                    low[node] = order[to]
                continue
            path.pop()
            if path and low[node] >= order[path[-1]]:
                block = [path[-1]]
                while block[-1] != node:
                    block.append(open_.pop())
                yield block
            elif path and low[node] < low[path[-1]]:
                low[path[-1]] = low[node]


def _by_chunk(found: Callable[..., pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's links (graph_id, a, b), ``CHUNK`` at a time, as ``found(number, graphs, names, a, b)``: of each node the graph and the name, and the distinct links by nodes' places."""
    held = CHUNK

    def coded(number: int, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        rows = table.num_rows
        of = table.column("graph_id").combine_chunks().dictionary_encode()
        ends = pa.chunked_array([c for name in ("a", "b") for c in table.column(name).chunks]).combine_chunks().dictionary_encode()
        wide = len(ends.dictionary)
        if len(of.dictionary) == 1:
            keys, place = np.arange(wide), ends.indices.to_numpy().astype(np.int64)
        else:
            keys, place = np.unique(np.tile(of.indices.to_numpy().astype(np.int64), 2) * wide + ends.indices.to_numpy(), return_inverse=True)
        a, b = np.minimum(place[:rows], place[rows:]), np.maximum(place[:rows], place[rows:])
        links = np.sort((a * len(keys) + b)[a != b])
        links = links[np.diff(links, prepend=-1) > 0]
        return found(number, of.dictionary.take(pa.array(keys // wide)), ends.dictionary.take(pa.array(keys % wide)), links // len(keys), links % len(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, part = 0, 0, []
        for batch in batches:
            part.append(batch)
            rows += batch.num_rows
            if rows >= held:
                yield coded(number, part)
                number, rows, part = number + 1, 0, []
        if rows:
            yield coded(number, part)

    return run


def _forest(number: int, graphs: pa.Array, names: pa.Array, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """A link for each bridge, and for each larger block one from each of its nodes to the block."""
    first, second, blocks = [], [], 0
    for block in _blocks(len(names), a, b):
        if len(block) == 2:
            first.append(block[0])
            second.append(block[1])
        else:
            first.extend(block)
            second.extend([len(names) + blocks] * len(block))
            blocks += 1
    lead = f"b{TaskContext.get().partitionId()}-{number}-"
    every = pa.chunked_array([names, pa.array([f"{lead}{i}" for i in range(blocks)], names.type)]).combine_chunks()
    own, to = pa.array(first, pa.int64()), pa.array(second, pa.int64())
    return pa.RecordBatch.from_arrays([graphs.take(own), every.take(own), every.take(to)], names=["graph_id", "a", "b"])


def _cuts(_: int, graphs: pa.Array, names: pa.Array, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """The nodes that several blocks share."""
    met, cuts = bytearray(len(names)), []
    for block in _blocks(len(names), a, b):
        for node in block:
            met[node] += met[node] < 2
    cuts = pa.array(np.flatnonzero(np.frombuffer(met, np.uint8) == 2))
    return pa.RecordBatch.from_arrays([graphs.take(cuts), names.take(cuts)], names=["graph_id", "node"])


def block_forests(links: DataFrame) -> DataFrame:
    """Fewer links (graph_id, a, b; a < b, distinct) that leave the same nodes joined whichever node goes: of each task's links, ``CHUNK`` at a time, the forest of blocks."""
    found = links.select("graph_id", "a", "b").mapInArrow(_by_chunk(_forest), links.select("graph_id", "a", "b").schema)
    return found.select("graph_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _merged(live: DataFrame, scratch: Scratch) -> DataFrame:
    """The links with blocks made one that are linked, or that share two nodes: whichever node goes, they stay joined.

    Of the blocks of a node only the smallest is held against the others, so a node of many blocks makes no more rows than it has links.
    """
    of = live.where("a like 'b%' and b like 'v%'").select("graph_id", F.col("b").alias("node"), F.col("a").alias("block"))
    least = of.groupBy("graph_id", "node").agg(F.min("block").alias("_a"), F.count("*").alias("_n")).where("_n > 1").select("graph_id", "node", "_a")
    shared = of.join(least.hint("merge"), ["graph_id", "node"]).where("block != _a").groupBy("graph_id", F.col("_a").alias("a"), F.col("block").alias("b")).agg(F.count("*").alias("_n")).where("_n > 1")
    pairs = scratch.table(shared.select("a", "b").unionByName(live.where("b like 'b%'").select("a", "b")))
    if pairs.isEmpty():
        return live
    same = scratch.table(connected_components(pairs, "a", "b"))
    name = lambda c: same.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    within, beside = live.where("b like 'v%'"), live.where("b like 'b%'")
    a, b = F.coalesce("_a", "a"), F.coalesce("_b", "b")
    moved = within.join(name("a"), "a", "left").select("graph_id", a.alias("a"), "b").unionByName(beside.join(name("a"), "a", "left").join(name("b"), "b", "left").select("graph_id", a.alias("a"), b.alias("b")))
    found = scratch.table(moved.where("a != b").select("graph_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    scratch.drop(live, pairs, same)
    return found


def _absorbed(live: DataFrame, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """The links, some maybe twice, with nodes that have links to two of a block's nodes in the block, and without links between two nodes of a block; the tables to drop after it.

    Of a node's blocks only the smallest takes in others.
    """
    own = scratch.table(live.where("a like 'b%' and b like 'v%'").groupBy("graph_id", F.col("b").alias("node")).agg(F.min("a").alias("block")))
    side = lambda c: own.select("graph_id", F.col("node").alias(c), F.col("block").alias(f"_{c}")).hint("merge")
    apart = live.where("a like 'v%'").join(side("a"), ["graph_id", "a"], "left").join(side("b"), ["graph_id", "b"], "left").where("_a is null or _b is null or _a != _b")
    apart = scratch.table(apart.select("graph_id", "a", "b", "_a", "_b"))
    met = apart.select("graph_id", F.col("a").alias("node"), F.col("_b").alias("block")).unionByName(apart.select("graph_id", F.col("b").alias("node"), F.col("_a").alias("block")))
    joined = scratch.table(met.where("block is not null").groupBy("graph_id", "node", "block").agg(F.count("*").alias("_n")).where("_n > 1").select("graph_id", "node", "block"))
    inside = lambda c, of: joined.select("graph_id", F.col("node").alias(c), F.col("block").alias(of)).hint("merge")
    kept = scratch.table(apart.join(inside("a", "_b"), ["graph_id", "a", "_b"], "left_anti").join(inside("b", "_a"), ["graph_id", "b", "_a"], "left_anti").select("graph_id", "a", "b"))
    scratch.drop(own, apart)
    return live.where("a like 'b%'").unionByName(kept).unionByName(joined.select("graph_id", F.col("block").alias("a"), F.col("node").alias("b"))), [joined, kept]


def _round(live: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The links that a round leaves; the (graph_id, node) that something was taken from, once each time; the (graph_id, node) that went.

    A node of one link goes, of two that only join each other the smaller one. Of several nodes (no blocks) that have links to the same two others alone all go, and
    a link between the two stays for them. Two such pairs can each be the other's neighbours only as a circle of four, of which the
    pair goes that comes after the other.
    """
    both = live.select("graph_id", F.col("a").alias("node"), F.col("b").alias("to")).unionByName(live.select("graph_id", F.col("b").alias("node"), F.col("a").alias("to")))
    few = both.groupBy("graph_id", "node").agg(F.count("*").alias("n"), F.min("to").alias("lo"), F.max("to").alias("hi"))
    low = scratch.table(few.withColumn("n", F.when(F.col("lo") == F.col("hi"), 1).otherwise(F.col("n"))).where("n = 1 or n = 2 and node like 'v%'"))
    ends = [F.when(F.col("n") == 1, F.least("node", "lo")).otherwise(F.col("lo")).alias("p"), F.when(F.col("n") == 1, F.greatest("node", "lo")).otherwise(F.col("hi")).alias("q")]
    same = low.select("graph_id", "n", "node", *ends).groupBy("graph_id", "n", "p", "q").agg(F.count("*").alias("m"), F.min("node").alias("first"))
    told = scratch.table(same.where("n = 1 or m > 2 or m = 2 and (p like 'b%' or first > p)"))
    leaves, pairs = told.where("n = 1"), told.where("n = 2").select("graph_id", F.col("p").alias("lo"), F.col("q").alias("hi"))
    twins = scratch.table(low.where("n = 2").join(pairs.hint("merge"), ["graph_id", "lo", "hi"], "left_semi").select("graph_id", "node", "lo", "hi"))
    flagged = lambda d, a, b, flag: d.select("graph_id", F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.lit(flag).alias("flag"))
    rows = [flagged(live, "a", "b", 0), flagged(leaves, "p", "q", 1), flagged(twins, "node", "lo", 1), flagged(twins, "node", "hi", 1), flagged(pairs, "lo", "hi", 2)]
    left = scratch.table(reduce(DataFrame.unionByName, rows).groupBy("graph_id", "a", "b").agg(F.max("flag").alias("flag")).where("flag != 1").select("graph_id", "a", "b"))
    bare = scratch.table(leaves.select("graph_id", F.when(F.col("first") == F.col("p"), F.col("q")).otherwise(F.col("p")).alias("node")))
    gone = scratch.table(leaves.select("graph_id", F.col("first").alias("node")).unionByName(twins.select("graph_id", "node")))
    scratch.drop(low, told, twins)
    return left, bare, gone


def thinned_cuts(links: DataFrame, core: Callable[[DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    """(graph_id, node): the cut vertices of links (graph_id, a, b), by their names without the ``v``.

    What hangs on a node is counted where it is taken off: a node with one such part is cut if it has another link, one with two is in any case. What is
    left after the rounds is searched in one task if it has at most ``CHUNK`` links, and otherwise by ``core``.
    """
    live, bare, gone = scratch.table(block_forests(links)), [], []
    size = live.count()
    while size > CHUNK:
        live = _merged(live, scratch)
        thin, used = _absorbed(live, scratch)
        left, taken, went = _round(thin, scratch)
        bare.append(taken)
        gone.append(went)
        scratch.drop(live, *used)
        before, size, live = size, left.count(), left
        if size >= SHRINK * before:
            break
    node = live.schema["b"].dataType.simpleString()
    whole = lambda: live.coalesce(1).mapInArrow(_by_chunk(_cuts), f"graph_id {live.schema['graph_id'].dataType.simpleString()}, node {node}")
    cuts = whole() if size <= CHUNK else core(live)
    if bare:
        hung = reduce(DataFrame.unionByName, bare).groupBy("graph_id", "node").agg(F.count("*").alias("n")).where("node like 'v%'")
        linked = [*gone, live.select("graph_id", F.col("a").alias("node")), live.select("graph_id", F.col("b").alias("node"))]
        once = hung.where("n = 1").select("graph_id", "node").join(reduce(DataFrame.unionByName, linked).hint("merge"), ["graph_id", "node"], "left_semi")
        cuts = cuts.unionByName(hung.where("n > 1").select("graph_id", "node")).unionByName(once)
    return scratch.table(cuts.where("node like 'v%'").distinct().select("graph_id", F.expr("substring(node, 2)").alias("node")))
