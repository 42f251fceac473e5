"""Connected components of an undirected edge table: within tasks and then by alternating stars, or by contraction, which shuffles less often where links are few."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, IntegerType, LongType, ShortType, StringType, StructField, StructType

from provgraph.session import Scratch

#: Links that a task joins up at a time between the rounds' nodes.
HELD = 1 << 18
#: Links that a task joins up at a time as they come.
CHUNK = 1 << 20


def ranked(kind: DataType) -> bool:
    """Whether tasks can tell the order of such nodes: text, whole numbers, or structs of them."""
    parts = [f.dataType for f in kind.fields] if isinstance(kind, StructType) else [kind]
    return all(t in (StringType(), LongType(), IntegerType(), ShortType(), ByteType()) for t in parts)


def _ranks(values: pa.Array) -> np.ndarray:
    """Numbers that are ordered, and equal, as the values are in Spark; null comes first."""
    if pa.types.is_struct(values.type):
        code = np.zeros(len(values), np.int64)
        for part in values.flatten():
            rank = _ranks(part)
            wide = int(rank.max(initial=0)) + 1
            if int(code.max(initial=0)) * wide >= 1 << 62:
                code = np.unique(code, return_inverse=True)[1]
            code = code * wide + rank
        return code
    coded = values.dictionary_encode()
    rank = np.empty(len(coded.dictionary), np.int64)
    rank[pc.array_sort_indices(coded.dictionary).to_numpy()] = np.arange(1, len(rank) + 1)
    return np.append(rank, 0)[pc.fill_null(coded.indices, len(rank)).to_numpy()]


def _least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each node 0 to n - 1 the smallest that links a, b join it with: roots are hung from smaller neighbours and skipped to until no link has two."""
    root = np.arange(n)
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while not np.array_equal(up := root[root], root):
            root = up


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root): the nodes of links (a, b), ``CHUNK`` at a time, with the smallest node that those links join them with."""
    rows, part = 0, []

    def flush() -> pa.RecordBatch:
        both = pa.concat_arrays([batch.column(i) for i in (0, 1) for batch in part])
        _, first, place = np.unique(_ranks(both), return_index=True, return_inverse=True)
        nodes = both.take(pa.array(first))
        return pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(_least(len(first), place[:rows], place[rows:])))], names=["node", "root"])

    for batch in batches:
        part.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK:
            yield flush()
            rows, part = 0, []
    if rows:
        yield flush()


def joined_nodes(links: DataFrame, before: int | None = None) -> DataFrame:
    """(node, component): every node of links (a, b; no nulls, of a type that is ``ranked``), loops included, with the smallest node of its component.

    Each task joins up its links as they come, a bounded number at a time. Then only a node that several such parts have joins their
    smallest nodes, and only those are joined up again: by one task if it can hold their links, in parts as long as these are fewer than half of the links
    ``before``, and otherwise by the rounds of stars. So a table whose near rows belong together is shuffled once by node, and a node has no more rows in it than there are parts.
    """
    scratch = Scratch(links.sparkSession)
    kind = links.schema["a"].dataType
    found = links.select("a", "b").mapInArrow(_chunks, StructType([StructField("node", kind), StructField("root", kind)]))
    order = Window.partitionBy("node").orderBy("root")
    placed = found.select("node", "root", F.first("root").over(order).alias("least"), F.lag("root").over(order).alias("_last"))
    placed = scratch.table(placed.where("_last is null or root != _last").select("node", "root", "least"))
    pairs = scratch.table(placed.where("root != least").select(F.col("root").alias("a"), F.col("least").alias("b")).distinct())
    nodes, size = placed.where("root = least").select("node", F.col("least").alias("component")), pairs.count()
    if not size:
        return nodes
    if size <= CHUNK:
        parts = scratch.table(pairs.coalesce(1).mapInArrow(_chunks, found.schema)).withColumnRenamed("root", "component")
    elif before is None or 2 * size < before:
        parts = joined_nodes(pairs.coalesce(-(-size // CHUNK)), size)
    else:
        parts = _by_stars(pairs.select(F.col("a").alias("hi"), F.col("b").alias("lo")), scratch)
    parts = parts.select(F.col("node").alias("_node"), F.col("component").alias("_component"))
    return nodes.join(parts, F.col("component") == F.col("_node"), "left").select("node", F.coalesce("_component", "component").alias("component"))


def _mark(links: DataFrame) -> tuple:
    """Count and order-free digest of the links; equal for equal sets."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def _shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (hi, lo) that join the same nodes as those met, ``HELD`` at a time, but hang each node from the first met of its component."""
    rows, schema = [], None

    def flush() -> pa.RecordBatch:
        place, nodes, above = {}, [], []

        def root(node: object) -> int:
            at = place.setdefault(tuple(node.values()) if isinstance(node, dict) else node, len(nodes))
            if at == len(nodes):
                nodes.append(node)
                above.append(at)
            while above[at] != at:
                above[at] = above[above[at]]
                at = above[at]
            return at

        for lo, hi in rows:
            a, b = root(lo), root(hi)
            above[max(a, b)] = min(a, b)
        rows.clear()
        for at in range(len(above)):  # parents come first
            above[at] = above[above[at]]
        out = [(nodes[i], nodes[r]) for i, r in enumerate(above) if i != r]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], schema.field("lo").type) for i in (0, 1)], names=["hi", "lo"])

    for batch in batches:
        schema = batch.schema
        rows.extend(zip(batch.column("lo").to_pylist(), batch.column("hi").to_pylist()))
        if len(rows) >= HELD:
            yield flush()
    if rows:
        yield flush()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): every node of an edge with the smallest node of its component.

    Nodes may be of any orderable type (a struct too); those that are ``ranked`` are joined up within tasks first (``joined_nodes``). Edges with a null end and
    loops link nothing; an empty table gives no row.
    """
    a, b = F.col(src), F.col(dst)
    links = edges.where(a.isNotNull() & b.isNotNull() & (a != b))
    if edges.schema[src].dataType == edges.schema[dst].dataType and ranked(edges.schema[src].dataType):
        return joined_nodes(links.select(a.alias("a"), b.alias("b")))
    return _by_stars(links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), Scratch(edges.sparkSession))


def _by_stars(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of distinct links (hi, lo; no loops).

    First each task joins up the links of its range of nodes, a bounded number at a
    time, so that components of near nodes are settled and of others little is left. A round then links every larger neighbour of a node to the node's smallest
    neighbour (large star), then every smaller one (small star), until nothing changes: then each component is a star around its smallest node.
    A round is two grouped minima and two equi joins, written once; the minima combine before the shuffle, and a hub's links
    are only joined, so they can be split. Nothing is collected but a count and a digest a round.
    """
    near = links.repartitionByRange("lo", "hi").sortWithinPartitions("lo", "hi").mapInArrow(_shortened, links.schema)
    live = scratch.table(near.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).distinct())
    before, now = None, _mark(live)
    while now != before and now[0]:
        both = live.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(live.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("_u"), F.least("u", "_m").alias("_m"))
        large = both.where("v > u").join(least.hint("merge"), F.col("u") == F.col("_u")).select(F.col("v").alias("hi"), F.col("_m").alias("lo"))
        root = large.groupBy("hi").agg(F.min("lo").alias("_r")).select(F.col("hi").alias("_h"), "_r")
        small = large.join(root.hint("merge"), F.col("hi") == F.col("_h"))
        linked = small.where("lo != _r").select(F.col("lo").alias("hi"), F.col("_r").alias("lo")).unionByName(small.where("lo = _r").select("hi", "lo"))
        step = scratch.table(linked.distinct())
        before, now = now, _mark(step)
        scratch.drop(live)
        live = step
    stars = live.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return stars.unionByName(live.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


def to_roots(parents: DataFrame, scratch: Scratch) -> DataFrame:
    """Pointer jumping: (node, parent) with parents of parents until every parent is a root."""
    held = None
    while True:
        up = parents.select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
        jumped = scratch.table(
            parents.join(up, parents.parent == up["_n"], "left").select("node", F.coalesce("_p", "parent").alias("parent"), (F.coalesce("_p", "parent") != F.col("parent")).alias("_moved"))
        )
        if held is not None:
            scratch.drop(held)
        held, parents = jumped, jumped.select("node", "parent")
        if jumped.where("_moved").isEmpty():
            return parents


def contracted_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): every node of an edge with the smallest node of its component.

    Nodes may be of any orderable type (a struct too). Each round hangs every node below its smallest neighbour, jumps
    to the roots and replaces the edges by edges between roots; at least half the nodes vanish a round. Work is grouped
    minima and equi joins on written tables, never a collected graph; all but the last table are removed again. Edges with a
    null end and loops link nothing; an empty table gives no row.
    """
    a, b = F.col(src), F.col(dst)
    scratch = Scratch(edges.sparkSession)
    live = scratch.table(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    maps: list[DataFrame] = []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("_least"))
        roots = to_roots(near.select("node", F.least("node", "_least").alias("parent")), scratch)
        maps.append(roots)
        end = lambda c: roots.select(F.col("node").alias(f"_n{c}"), F.col("parent").alias(f"_p{c}"))
        step = scratch.table(
            live.join(end("a"), F.col("a") == F.col("_na")).join(end("b"), F.col("b") == F.col("_nb")).where("_pa != _pb").select(F.least("_pa", "_pb").alias("a"), F.greatest("_pa", "_pb").alias("b")).distinct()
        )
        scratch.drop(live)
        live = step
    if not maps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = maps[-1]
    for earlier in reversed(maps[:-1]):
        last = out.select(F.col("node").alias("_n"), F.col("parent").alias("_p"))
        out = earlier.join(last, earlier.parent == last["_n"], "left").select("node", F.coalesce("_p", "parent").alias("parent"))
    found = scratch.table(out.select("node", F.col("parent").alias("component")))
    scratch.drop_others(found)
    return found
