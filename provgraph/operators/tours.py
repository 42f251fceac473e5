"""Trees and linked lists of any size: Euler tours of parent tables, sums along lists, sums over subtrees."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.operators.ranking import running_totals
from provgraph.session import Scratch

#: Most arcs that a task holds at a time while it shortens its part of the lists.
BLOCK = 1 << 18


def euler_tour(tree: DataFrame) -> DataFrame:
    """(arc, next) of the Euler tours of trees (node, parent; a root's parent is null): arc 2 v enters node v and 2 v + 1 leaves it.

    Nodes are distinct numbers from 0 on. A leaf is left right after it is entered, children are visited in the order of their numbers, and the tour of a
    tree ends (next is null) when its root is left. First children are a grouped minimum and next siblings come from
    ``running_totals``, so that a node's children are spread over tasks however many they are. An empty table gives no row.
    """
    below = tree.where("parent is not null").select("parent", "node")
    first = below.groupBy(F.col("parent").alias("_of")).agg(F.min("node").alias("_first"))
    siblings = running_totals(below, [], "node", ["parent"]).select(F.col("node").alias("_node"), F.col("next_node").alias("_sibling"))
    placed = tree.join(first.hint("merge"), F.col("node") == F.col("_of"), "left").join(siblings.hint("merge"), F.col("node") == F.col("_node"), "left")
    enter = F.struct((F.col("node") * 2).alias("arc"), F.coalesce(F.col("_first") * 2, F.col("node") * 2 + 1).alias("next"))
    leave = F.struct((F.col("node") * 2 + 1).alias("arc"), F.coalesce(F.col("_sibling") * 2, F.col("parent") * 2 + 1).alias("next"))
    return placed.select(F.inline(F.array(enter, leave)))


def _runs(arc: np.ndarray, follows: np.ndarray, sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Shortens the lists among the arcs of one block: ``sums`` become sums to the end of an arc's run, the part of its list that lies in
    the block without a gap. Returns each arc's last arc of its run (as a place) and whether it is the first of it."""
    by = np.argsort(arc)
    at = np.searchsorted(arc, follows, sorter=by)
    at = by[np.minimum(at, len(arc) - 1)]
    to = np.where(arc[at] == follows, at, -1)
    first = np.ones(len(arc), bool)
    first[to[to >= 0]] = False
    last = np.arange(len(arc))
    while (to >= 0).any():
        here = np.flatnonzero(to >= 0)
        there = to[here]
        added, ends, jumps = [s[there] for s in sums], last[there], to[there]
        for s, more in zip(sums, added):
            s[here] += more
        last[here], to[here] = ends, jumps
    return last, first


def list_sums(arcs: DataFrame, values: Sequence[str], block: int = BLOCK) -> DataFrame:
    """(arc, values): for each arc of linked lists (arc, next, values; all bigint) the sums of the values from it to the end of its list, itself included.

    First every task joins up the arcs of its range of numbers, ``block`` at a time: where lists run through near numbers
    little is left of them but one arc a run. What is left is ranked by pointer jumping: a round doubles how far every arc
    sees, so there are about as many rounds as the longest of the shortened lists has binary digits, each one join of written tables; arcs
    that see their end aren't moved again. Every arc then adds what its run's end leads to. Arcs are distinct, at most one
    leads to any, and no list is a ring. ``next`` is null at an end. An empty table gives no row.
    """
    scratch, names = Scratch(arcs.sparkSession), list(values)
    ddl = ", ".join(["arc bigint", "follows bigint", "first boolean", *(f"{v} bigint" for v in names)])

    def shorten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0

        def flush() -> pd.DataFrame:
            pdf = pd.concat(held)
            held.clear()
            arc, follows = pdf["arc"].to_numpy(np.int64), pdf["next"].fillna(-1).to_numpy(np.int64)
            sums = [pdf[v].to_numpy(np.int64).copy() for v in names]
            last, first = _runs(arc, follows, sums)
            to = pd.Series(follows[last]).astype("Int64")
            return pd.DataFrame({"arc": arc, "follows": to.mask(to < 0), "first": first, **dict(zip(names, sums))})

        for pdf in batches:
            held.append(pdf)
            rows += len(pdf)
            if rows >= block:
                yield flush()
                rows = 0
        if held:
            yield flush()

    near = arcs.select("arc", "next", *names).repartitionByRange("arc").sortWithinPartitions("arc")
    runs = scratch.table(near.mapInPandas(shorten, ddl))
    live = scratch.table(runs.where("first").select("arc", F.col("follows").alias("next"), *names))
    while not live.where("next is not null").isEmpty():
        ahead = live.select(F.col("arc").alias("_arc"), F.col("next").alias("_next"), *(F.col(v).alias(f"_{v}") for v in names))
        jumped = live.where("next is not null").join(ahead.hint("merge"), F.col("next") == F.col("_arc"))
        step = scratch.table(jumped.select("arc", F.col("_next").alias("next"), *((F.col(v) + F.col(f"_{v}")).alias(v) for v in names)).unionByName(live.where("next is null")))
        scratch.drop(live)
        live = step
    onward = live.select(F.col("arc").alias("_arc"), *(F.col(v).alias(f"_{v}") for v in names))
    ended = runs.where("follows is null").select("arc", *names)
    joined = runs.where("follows is not null").join(onward.hint("merge"), F.col("follows") == F.col("_arc"))
    return ended.unionByName(joined.select("arc", *((F.col(v) + F.col(f"_{v}")).alias(v) for v in names)))


def subtree_sums(tree: DataFrame, values: Sequence[str] = ()) -> DataFrame:
    """(node, behind, size, leaves, values) of trees (node, parent, values): over each node's subtree, itself included, the number of
    nodes and of childless ones and the sums of the values.

    They are differences between the sums at a node's two arcs, where values lie on the arcs that enter. ``behind`` counts the
    nodes that the tour enters from the node's arc on, so a subtree has the numbers above behind - size up to behind.
    """
    enter = F.col("arc") % 2 == 0
    own = tree.select((F.col("node") * 2).alias("_arc"), *values)
    weighed = euler_tour(tree.select("node", "parent")).join(own.hint("merge"), F.col("arc") == F.col("_arc"), "left")
    arcs = weighed.select(
        "arc", "next", enter.cast("bigint").alias("_nodes"), (enter & (F.col("next") == F.col("arc") + 1)).cast("bigint").alias("_leaves"), *(F.coalesce(v, F.lit(0)).cast("bigint").alias(v) for v in values)
    )
    sums = list_sums(arcs, ["_nodes", "_leaves", *values])
    net = lambda c, name: F.sum(F.when(enter, F.col(c)).otherwise(-F.col(c))).alias(name)
    of_node = sums.groupBy(F.floor(F.col("arc") / 2).cast("bigint").alias("node"))
    return of_node.agg(F.max("_nodes").alias("behind"), net("_nodes", "size"), net("_leaves", "leaves"), *(net(v, v) for v in values))
