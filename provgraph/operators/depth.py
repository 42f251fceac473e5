"""Causal depth and cut vertices of graphs of any size: strong components, peeling by levels, spanning trees and Euler tours as rounds of joins.

All graphs of a table go through the same rounds together; a round is a few joins of written tables, keyed by node, so neither a
large graph nor a hub is one task's work. Tables that no later round reads are removed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.operators.blocks import thinned_cuts
from provgraph.operators.components import connected_components, contracted_components, to_roots
from provgraph.operators.ranking import running_totals
from provgraph.operators.small import HELD, PLAIN, per_graph, split
from provgraph.operators.tours import list_sums, subtree_sums
from provgraph.session import Scratch

#: Positions that one step of ``range_extremes`` sums up.
FAN = 16
#: Most levels below its root for which a graph's cut vertices are told level by level.
LEVELS = 24


def _numbers(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(graph_id, node, id) with ids from 1 on, near for the nodes of a graph, and distinct (graph_id, s, d) between them; rows with a null don't count."""
    simple = scratch.table(edges.where("graph_id is not null and src is not null and dst is not null").select("graph_id", "src", "dst").distinct())
    ends = simple.select("graph_id", F.col("src").alias("node")).unionByName(simple.select("graph_id", F.col("dst").alias("node"))).distinct()
    nodes = scratch.table(ends.repartitionByRange("graph_id", "node").sortWithinPartitions("graph_id", "node").withColumn("id", F.monotonically_increasing_id() + 1))
    side = lambda c, name: nodes.select("graph_id", F.col("node").alias(c), F.col("id").alias(name)).hint("merge")
    return nodes, scratch.table(simple.join(side("src", "s"), ["graph_id", "src"]).join(side("dst", "d"), ["graph_id", "dst"]).select("graph_id", "s", "d"))


def _trimmed(links: DataFrame, scratch: Scratch) -> DataFrame:
    """The links (s, d) without those that no cycle can hold: again and again those go whose source has no link in or whose target has none out."""
    size = links.count()
    while size:
        fed, feeding = links.select(F.col("d").alias("s")).distinct(), links.select(F.col("s").alias("d")).distinct()
        kept = scratch.table(links.join(fed.hint("merge"), "s", "left_semi").join(feeding.hint("merge"), "d", "left_semi").select("s", "d"))
        before, size = size, kept.count()
        scratch.drop(links)
        links = kept
        if size == before:
            break
    return links


def strong_components(links: DataFrame) -> DataFrame:
    """(node, component): every node of a directed cycle of links (s, d; bigint) with the largest node of its strongly connected component.

    Forward-backward search for all components at once: links that can't lie on a cycle are trimmed; then every node takes the largest node
    that reaches it as its colour, which is the same for a whole component; from each node that is its own colour a search
    backwards within the colour finds its component. Links of found nodes and between colours go, and it starts again with what is left;
    each turn finds one component a colour at least. A search takes as many rounds as its longest shortest path.
    """
    scratch, found = Scratch(links.sparkSession), []
    live = _trimmed(scratch.table(links.where("s != d").select("s", "d").distinct()), scratch)
    while not live.isEmpty():
        colours = scratch.table(live.select(F.col("s").alias("node")).distinct().select("node", F.col("node").alias("colour"), F.lit(True).alias("moved")))
        while not colours.where("moved").isEmpty():
            news = live.join(colours.where("moved").select(F.col("node").alias("s"), "colour").hint("merge"), "s").groupBy(F.col("d").alias("_node")).agg(F.max("colour").alias("_colour"))
            larger = F.coalesce(F.col("_colour") > F.col("colour"), F.lit(False))
            step = scratch.table(colours.join(news.hint("merge"), F.col("node") == F.col("_node"), "left").select("node", F.when(larger, F.col("_colour")).otherwise(F.col("colour")).alias("colour"), larger.alias("moved")))
            scratch.drop(colours)
            colours = step
        of = lambda c: colours.select(F.col("node").alias(c), F.col("colour").alias(f"_{c}")).hint("merge")
        same = scratch.table(live.join(of("s"), "s").join(of("d"), "d").where("_s = _d").select("s", "d", F.col("_s").alias("colour")))
        scratch.drop(live)
        front = scratch.table(colours.where("node = colour").select("node", "colour"))
        reached = front
        while not front.isEmpty():
            back = same.join(front.select(F.col("node").alias("d")).hint("merge"), "d", "left_semi").select(F.col("s").alias("node"), "colour").distinct()
            front = scratch.table(back.join(reached.select("node").hint("merge"), "node", "left_anti"))
            reached = reached.unionByName(front)
        done = scratch.table(reached.select("node", F.col("colour").alias("component")))
        found.append(done)
        left = lambda c: done.select(F.col("node").alias(c)).hint("merge")
        live = _trimmed(scratch.table(same.join(left("s"), "s", "left_anti").join(left("d"), "d", "left_anti").select("s", "d")), scratch)
    if not found:
        return links.select(F.col("s").alias("node"), F.col("d").alias("component")).limit(0)
    result = scratch.table(reduce(DataFrame.unionByName, found))
    scratch.drop_others(result)
    return result


def longest_paths(links: DataFrame) -> DataFrame:
    """(graph_id, depth): most edges on a path of acyclic links (graph_id, s, d), for graphs with any.

    Level by level the links go whose source has no link in: a graph lasts as many rounds as its longest path has edges.
    """
    scratch, levels = Scratch(links.sparkSession), []
    live = scratch.table(links.select("graph_id", "s", "d").distinct())
    while not live.isEmpty():
        levels.append(scratch.table(live.groupBy("graph_id").agg(F.lit(1).alias("level"))))
        step = scratch.table(live.join(live.select(F.col("d").alias("s")).distinct().hint("merge"), "s", "left_semi").select("graph_id", "s", "d"))
        scratch.drop(live)
        live = step
    if not levels:
        return links.groupBy("graph_id").agg(F.count("*").alias("depth"))
    result = scratch.table(reduce(DataFrame.unionByName, levels).groupBy("graph_id").agg(F.count("*").alias("depth")))
    scratch.drop_others(result)
    return result


def _peeled(links: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """(graph_id, depth) of the graphs of links (graph_id, src, dst; no loops) without a cycle, and the (graph_id) of those with one, None for none.

    Level by level the links go whose source has no link in, by the nodes' own names; where nothing goes any more there is a cycle.
    """
    levels, live = [], links
    size = live.count()
    while size:
        levels.append(scratch.table(live.select("graph_id").distinct()))
        fed = live.select("graph_id", F.col("dst").alias("src")).distinct()
        step = scratch.table(live.join(fed.hint("merge"), ["graph_id", "src"], "left_semi").select("graph_id", "src", "dst"))
        before, size, live = size, step.count(), step
        if size == before:
            break
    if not levels:
        return links.groupBy("graph_id").agg(F.count("*").alias("depth")), None
    depths = reduce(DataFrame.unionByName, levels).groupBy("graph_id").agg(F.count("*").alias("depth"))
    if not size:
        return depths, None
    rest = scratch.table(live.select("graph_id").distinct())
    return depths.join(rest.hint("merge"), "graph_id", "left_anti"), rest


def causal_depth(edges: DataFrame) -> DataFrame:
    """(graph_id, depth, depth_ratio) of edges (graph_id, src, dst): the longest path, in edges, between strongly connected components, and that over the number of nodes.

    Repeated edges count once, a loop makes its node one of the graph; edges with a null don't count, and a graph without others has no row.
    Graphs without a cycle are peeled as they are; only those with one are numbered and go through ``strong_components``.
    """
    scratch = Scratch(edges.sparkSession)
    named = scratch.table(edges.where("graph_id is not null and src is not null and dst is not null").select("graph_id", "src", "dst"))
    depths, cyclic = _peeled(named.where("src != dst"), scratch)
    if cyclic is not None:
        links = _numbers(named.join(cyclic.hint("merge"), "graph_id", "left_semi"), scratch)[1]
        parts = strong_components(links.select("s", "d"))
        end = lambda c: parts.select(F.col("node").alias(f"_n{c}"), F.col("component").alias(f"_c{c}")).hint("merge")
        merged = links.join(end("s"), F.col("s") == F.col("_ns"), "left").join(end("d"), F.col("d") == F.col("_nd"), "left")
        depths = depths.unionByName(longest_paths(merged.select("graph_id", F.coalesce("_cs", "s").alias("s"), F.coalesce("_cd", "d").alias("d")).where("s != d")))
    nodes = named.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).distinct()
    sizes = nodes.groupBy("graph_id").agg(F.count("*").alias("_n"))
    depth = F.coalesce("depth", F.lit(0)).cast("bigint")
    out = scratch.table(sizes.join(depths.hint("merge"), "graph_id", "left").select("graph_id", depth.alias("depth"), F.round(depth / F.col("_n"), 6).alias("depth_ratio")))
    scratch.drop_others(out)
    return out


def spanning_forest(links: DataFrame) -> DataFrame:
    """The links (a, b, e; e distinct) of a spanning forest: in every round each component takes its link of least e, components that links join become one, and links inside go. At least half the components vanish a round."""
    scratch, chosen = Scratch(links.sparkSession), []
    live = scratch.table(links.where("a != b").select("a", "b", "e"))
    while not live.isEmpty():
        both = live.select("a", "b", "e").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b"), "e"))
        pick = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.min(F.struct("e", "b")).alias("_p")).select("node", "_p.e", F.col("_p.b").alias("to")))
        chosen.append(pick.select("e").distinct())
        other = pick.select(F.col("node").alias("_to"), F.col("e").alias("_e")).hint("merge")
        hung = pick.join(other, F.col("to") == F.col("_to")).select("node", F.when((F.col("e") == F.col("_e")) & (F.col("node") < F.col("to")), F.col("node")).otherwise(F.col("to")).alias("parent"))
        roots = to_roots(hung, scratch)
        end = lambda c: roots.select(F.col("node").alias(f"_n{c}"), F.col("parent").alias(f"_p{c}")).hint("merge")
        moved = live.join(end("a"), F.col("a") == F.col("_na")).join(end("b"), F.col("b") == F.col("_nb")).where("_pa != _pb")
        step = scratch.table(moved.groupBy(F.least("_pa", "_pb").alias("a"), F.greatest("_pa", "_pb").alias("b")).agg(F.min("e").alias("e")))
        scratch.drop(live)
        live = step
    if not chosen:
        return live
    result = scratch.table(links.select("a", "b", "e").join(reduce(DataFrame.unionByName, chosen).distinct().hint("merge"), "e", "left_semi").select("a", "b", "e"))
    scratch.drop_others(result)
    return result


def rooted(forest: DataFrame) -> DataFrame:
    """(node, parent) of a forest of links (a, b, e): each tree hangs from its smallest node, which has the parent 0; nodes are numbers from 1 on.

    Each link is two arcs. What follows an arc is the next of the arcs that leave its target, going round after its twin, which makes one
    tour of each tree; cut at the root and ranked, it meets each link's arc away from the root first.
    """
    scratch = Scratch(forest.sparkSession)
    out = scratch.table(forest.select(F.inline(F.array(F.struct((F.col("e") * 2).alias("arc"), F.col("a").alias("tail")), F.struct((F.col("e") * 2 + 1).alias("arc"), F.col("b").alias("tail"))))))
    trees = scratch.table(contracted_components(forest, "a", "b"))
    first = out.groupBy(F.col("tail").alias("_of")).agg(F.min("arc").alias("_first"))
    turned = running_totals(out, [], "arc", ["tail"]).join(first.hint("merge"), F.col("tail") == F.col("_of")).join(trees.hint("merge"), F.col("tail") == F.col("node"))
    twin = F.col("arc").bitwiseXOR(F.lit(1))
    arcs = turned.select(twin.alias("arc"), F.coalesce("next_arc", F.when(F.col("node") != F.col("component"), F.col("_first"))).alias("next"), F.lit(1).cast("bigint").alias("left"))
    ranks = scratch.table(list_sums(arcs, ["left"]).join(out.hint("merge"), "arc"))
    ahead, back = (ranks.where(F.col("arc") % 2 == k).select(F.floor(F.col("arc") / 2).cast("bigint").alias("e"), F.col("left").alias(f"_l{k}"), F.col("tail").alias(f"_t{k}")) for k in (0, 1))
    down = F.col("_l0") > F.col("_l1")
    hung = ahead.join(back.hint("merge"), "e").select(F.when(down, F.col("_t1")).otherwise(F.col("_t0")).alias("node"), F.when(down, F.col("_t0")).otherwise(F.col("_t1")).alias("parent"))
    result = scratch.table(hung.unionByName(trees.where("node = component").select("node", F.lit(0).cast("bigint").alias("parent"))))
    scratch.drop_others(result)
    return result


def range_extremes(values: DataFrame, queries: DataFrame, fan: int = FAN) -> DataFrame:
    """(id, low, high): least ``low`` and greatest ``high`` of the values (pos, low, high; one a place from 0 on) at the places from ``first`` to ``last`` of each query (id, first, last).

    A query that spans less than two blocks of ``fan`` places looks them up; a longer one looks up what sticks out of its whole blocks and asks
    for the rest one level up, where a block is one place. So a level has a ``fan``-th of the places, short queries end
    at once, and none looks up more than 2 ``fan`` places a level.
    """
    scratch, parts = Scratch(queries.sparkSession), []
    values, queries = scratch.table(values.select("pos", "low", "high")), scratch.table(queries.select("id", "first", "last"))
    while not queries.isEmpty():
        block = lambda c: F.floor(F.col(c) / fan).cast("bigint")
        far = F.col("last") - F.col("first") >= 2 * fan
        head, tail = F.sequence("first", block("first") * fan + fan - 1), F.sequence(block("last") * fan, "last")
        asked = queries.select("id", F.explode(F.when(far, F.concat(head, tail)).otherwise(F.sequence("first", "last"))).alias("_pos"))
        met = asked.join(values.hint("merge"), F.col("_pos") == F.col("pos"))
        parts.append(scratch.table(met.groupBy("id").agg(F.min("low").alias("low"), F.max("high").alias("high"))))
        queries = scratch.table(queries.where(far).select("id", (block("first") + 1).alias("first"), (block("last") - 1).alias("last")).where("first <= last"))
        values = scratch.table(values.groupBy(block("pos").alias("pos")).agg(F.min("low").alias("low"), F.max("high").alias("high")))
    if not parts:
        return queries.select("id", F.col("first").alias("low"), F.col("last").alias("high"))
    result = scratch.table(reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.min("low").alias("low"), F.max("high").alias("high")))
    scratch.drop_others(result)
    return result


def cut_vertices(links: DataFrame) -> DataFrame:
    """(node): the nodes of undirected links (a, b; numbers from 1 on, a < b, distinct) that split their component when they go.

    Tarjan and Vishkin: a spanning forest is rooted and numbered by Euler tours. A tree link is named by its lower node. Two tree links
    lie in one block if a link outside the forest joins their lower nodes and neither is below the other, or if one follows the
    other and a link outside the forest leads from below the lower one to outside of what lies below the upper one; components of these relations are the blocks, and a
    node that tree links of several blocks meet in is a cut vertex. What a subtree's links reach is a range of the numbers, from ``range_extremes``.
    """
    scratch = Scratch(links.sparkSession)
    named = scratch.table(links.select("a", "b").withColumn("e", F.monotonically_increasing_id()))
    if named.isEmpty():
        return named.select(F.col("a").alias("node"))
    forest = spanning_forest(named)
    tree = rooted(forest)
    above = F.lit(None).cast("bigint")
    whole = tree.unionByName(tree.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("node"), above.alias("parent")))
    placed = scratch.table(subtree_sums(whole).join(tree.hint("merge"), "node").select("node", "parent", F.col("behind").alias("pos"), "size"))
    at = lambda c: placed.select(F.col("node").alias(c), F.col("pos").alias(f"_p{c}"), F.col("size").alias(f"_s{c}")).hint("merge")
    beside = scratch.table(named.join(forest.select("e").hint("merge"), "e", "left_anti").join(at("a"), "a").join(at("b"), "b").select("a", "b", "_pa", "_sa", "_pb", "_sb"))
    reach = placed.select("pos", F.col("pos").alias("_to")).unionByName(beside.select(F.col("_pa").alias("pos"), F.col("_pb").alias("_to"))).unionByName(beside.select(F.col("_pb").alias("pos"), F.col("_pa").alias("_to")))
    values = reach.groupBy("pos").agg(F.min("_to").alias("low"), F.max("_to").alias("high"))
    spans = placed.where("parent > 0").select(F.col("node").alias("id"), (F.col("pos") - F.col("size") + 1).alias("first"), F.col("pos").alias("last"))
    extremes = range_extremes(values, spans)
    upper = placed.select(F.col("node").alias("_up"), F.col("pos").alias("_pos"), F.col("size").alias("_size"), F.col("parent").alias("_over")).hint("merge")
    leaving = placed.where("parent > 0").select("node", "parent").join(extremes.hint("merge"), F.col("node") == F.col("id")).join(upper, F.col("parent") == F.col("_up"))
    leaving = leaving.where("_over > 0 and (low <= _pos - _size or high > _pos)").select(F.col("node").alias("a"), F.col("parent").alias("b"))
    apart = beside.where("not (_pb > _pa - _sa and _pb <= _pa) and not (_pa > _pb - _sb and _pa <= _pb)").select("a", "b")
    blocks = contracted_components(apart.unionByName(leaving), "a", "b").select(F.col("node").alias("_node"), F.col("component").alias("_block"))
    lower = placed.where("parent > 0").join(blocks.hint("merge"), F.col("node") == F.col("_node"), "left").select("node", "parent", F.coalesce("_block", "node").alias("block"))
    met = lower.select("node", "block").unionByName(lower.select(F.col("parent").alias("node"), "block"))
    result = scratch.table(met.groupBy("node").agg(F.min("block").alias("_lo"), F.max("block").alias("_hi")).where("_lo != _hi").select("node"))
    scratch.drop_others(result)
    return result


def _cut_names(src: list, dst: list) -> tuple[list | None]:
    """The cut vertices of one small graph (None: it has no edge without a null), by Tarjan's search in depth."""
    beside: dict = {}
    for a, b in zip(src, dst):
        if a is not None and b is not None:
            beside.setdefault(a, set()).add(b)
            beside.setdefault(b, set()).add(a)
    order, low, cuts = {}, {}, set()
    for root in beside:
        if root in order:
            continue
        order[root] = low[root] = len(order)
        path, children = [(root, None, iter(beside[root]))], 0
        while path:
            node, above, ahead = path[-1]
            for to in ahead:
                if to not in order:
                    order[to] = low[to] = len(order)
                    path.append((to, node, iter(beside[to])))
                    break
                if to != above:
                    low[node] = min(low[node], order[to])
            else:
                path.pop()
                if above == root:
                    children += 1
                elif above is not None and low[node] >= order[above]:
                    cuts.add(above)
                if above is not None:
                    low[above] = min(low[above], low[node])
        if children > 1:
            cuts.add(root)
    return (list(cuts) if beside else None,)


def _cuts(src: list, dst: list) -> tuple[int | None]:
    """How many nodes of one small graph are cut vertices, None as in ``_cut_names``."""
    (cuts,) = _cut_names(src, dst)
    return (None if cuts is None else len(cuts),)


def cuts_by_levels(links: DataFrame, roots: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(node) of the cut vertices of the components in which ``roots`` (node; one a component at most) lie; the (node) of level ``LEVELS`` + 1, None
    where no component is so deep (what is said of one that is doesn't count); the arcs (u, v; both ways) that no root reaches.

    Nodes get levels by a search in breadth from the roots. What a node v cuts off lies below its level, as all else has a shortest path to
    the root past it: it is a component of the nodes of deeper levels that touches v and no other node of v's level. So the levels are taken from
    the deepest up, and a level's nodes are joined up with each other and by the components below them. A root is a cut vertex if several touch it. Each link is
    met at the level of its upper end only; a round is a few joins by node.
    """
    live = scratch.table(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))))
    fronts, met = [scratch.table(roots.select("node"))], []
    while True:
        told = scratch.table(live.join(fronts[-1].select(F.col("node").alias("u"), F.lit(True).alias("met")).hint("shuffle_hash"), "u", "left").select("u", "v", F.coalesce("met", F.lit(False)).alias("met")))
        met.append(scratch.table(told.where("met").select("u", "v")))
        scratch.drop(live)
        live = scratch.table(told.where("not met").select("u", "v"))
        scratch.drop(told)
        known = reduce(DataFrame.unionByName, fronts[-2:])
        new = scratch.table(met[-1].select(F.col("v").alias("node")).distinct().join(known.hint("merge"), "node", "left_anti"))
        deep = not new.isEmpty()
        if not deep or len(fronts) > LEVELS:
            break
        fronts.append(new)
    found, labels = [], None
    for own, arcs in list(zip(fronts, met))[:0:-1]:
        ends = own.select(F.col("node").alias("v"), F.col("node").alias("to"), F.lit(False).alias("below"))
        ends = ends.unionByName(labels.select(F.col("node").alias("v"), F.col("component").alias("to"), F.lit(True).alias("below"))) if labels is not None else ends
        pairs = scratch.table(arcs.join(ends.hint("merge"), "v").where("below or u < to").select("u", "to", "below").distinct())
        under = scratch.table(pairs.where("below").groupBy("to").agg(F.min("u").alias("_lo"), F.max("u").alias("_hi")))
        found.append(under.where("_lo = _hi").select(F.col("_lo").alias("node")))
        joint = pairs.where("below").join(under.where("_lo != _hi").hint("merge"), "to").where("u != _lo").select("u", F.col("_lo").alias("to"))
        parts = connected_components(pairs.where("not below").select("u", "to").unionByName(joint), "u", "to")
        last, labels = labels, scratch.table(own.join(parts.hint("merge"), "node", "left").select("node", F.coalesce("component", "node").alias("component")))
        scratch.drop(pairs, arcs, *([last] if last is not None else []))
    if labels is not None:
        at_root = met[0].join(labels.hint("merge"), F.col("v") == F.col("node")).groupBy("u").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"))
        found.append(at_root.where("_lo != _hi").select(F.col("u").alias("node")))
    cuts = scratch.table(reduce(DataFrame.unionByName, found).distinct() if found else fronts[0].limit(0))
    return cuts, new if deep else None, live


def large_cuts(nodes: DataFrame, links: DataFrame, held: int, scratch: Scratch) -> DataFrame:
    """(node): the cut vertices of large graphs, nodes (graph_id, id) and links (graph_id, a, b; a < b, distinct).

    Each graph is searched from a node of most links (``cuts_by_levels``). Other components of up to ``held`` links are searched whole in
    tasks; larger ones and graphs that are too deep go through ``cut_vertices``.
    """
    ends = links.select("graph_id", F.col("a").alias("node")).unionByName(links.select("graph_id", F.col("b").alias("node")))
    busy = ends.groupBy("graph_id", "node").agg(F.count("*").alias("_n")).groupBy("graph_id").agg(F.max(F.struct("_n", "node"))["node"].alias("node"))
    cuts, deep, beyond = cuts_by_levels(links, busy, scratch)
    rest = beyond.where("u < v").select(F.col("u").alias("src"), F.col("v").alias("dst"))
    parts, tours = [cuts], []
    if deep is not None:
        of = scratch.table(deep.join(nodes.select("graph_id", "id").hint("merge"), F.col("node") == F.col("id")).select("graph_id").distinct())
        theirs = nodes.join(of.hint("merge"), "graph_id", "left_semi").select(F.col("id").alias("node"))
        parts = [cuts.join(theirs.hint("merge"), "node", "left_anti")]
        tours.append(links.join(of.hint("merge"), "graph_id", "left_semi").select("a", "b"))
        rest = rest.join(theirs.withColumnRenamed("node", "src").hint("merge"), "src", "left_anti")
    rest = scratch.table(rest)
    if not rest.isEmpty():
        of = connected_components(rest).select(F.col("node").alias("src"), F.col("component").alias("graph_id"))
        small, large = split(scratch.table(rest.join(of.hint("merge"), "src").select("graph_id", "src", "dst")), scratch, held)
        if small is not None:
            parts.append(per_graph(small, _cut_names, "cuts array<string>").select(F.explode("cuts").alias("node")).select(F.col("node").cast("bigint")))
        if large is not None:
            tours.append(large.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    if tours:
        parts.append(cut_vertices(reduce(DataFrame.unionByName, tours)))
    return scratch.table(reduce(DataFrame.unionByName, parts))


def _numbered_cuts(edges: DataFrame, held: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The nodes (graph_id, node, id) of edges (graph_id, src, dst), and the cut vertices (graph_id, node) by ``large_cuts``."""
    nodes, links = _numbers(edges, scratch)
    simple = scratch.table(links.where("s != d").select("graph_id", F.least("s", "d").alias("a"), F.greatest("s", "d").alias("b")).distinct())
    cuts = large_cuts(nodes, simple, held, scratch).select(F.col("node").alias("id"))
    return nodes, nodes.join(cuts.hint("merge"), "id", "left_semi").select("graph_id", "node")


def articulation_count(edges: DataFrame, held: int = HELD) -> DataFrame:
    """(graph_id, articulation): how many nodes split their undirected component when they go, for each graph of edges (graph_id, src, dst).

    Directions, loops and repeated edges don't matter; edges with a null don't count, and a graph without others has no row. Graphs of up to
    ``held`` edges are searched whole in tasks, larger ones are thinned out (``thinned_cuts``) if their nodes are text or whole numbers; what that leaves, where a task can't hold
    it, is searched level by level, and graphs of more than ``LEVELS`` levels by the rounds of ``cut_vertices``.
    """
    scratch, parts = Scratch(edges.sparkSession), []
    small, large = split(edges.select("graph_id", "src", "dst").where("graph_id is not null"), scratch, held)
    if small is not None:
        parts.append(per_graph(small, _cuts, "articulation bigint").where("articulation is not null"))
    if large is not None and all(isinstance(large.schema[c].dataType, PLAIN) for c in large.columns):
        whole = large.where("src is not null and dst is not null")
        named = whole.select("graph_id", *(F.concat(F.lit("v"), F.col(c).cast("string")).alias(to) for c, to in (("src", "a"), ("dst", "b"))))
        cuts = thinned_cuts(named, lambda rest: _numbered_cuts(rest.select("graph_id", F.col("a").alias("src"), F.col("b").alias("dst")), held, scratch)[1], scratch)
        found = cuts.groupBy("graph_id").agg(F.count("*").alias("_n"))
        parts.append(whole.select("graph_id").distinct().join(found.hint("merge"), "graph_id", "left").select("graph_id", F.coalesce("_n", F.lit(0).cast("bigint")).alias("articulation")))
    elif large is not None:
        nodes, cuts = _numbered_cuts(large, held, scratch)
        marked = nodes.join(cuts.withColumn("_cut", F.lit(1)).hint("merge"), ["graph_id", "node"], "left")
        parts.append(marked.groupBy("graph_id").agg(F.count("_cut").alias("articulation")))
    out = scratch.table(reduce(DataFrame.unionByName, parts))
    scratch.drop_others(out)
    return out
