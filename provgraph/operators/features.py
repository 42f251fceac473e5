"""Per-graph aggregates and node features. Edge columns: graph_id, edge_id, actorID, actor_type, objectID, object, action."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provgraph.functions.names import action_risk, lookup
from provgraph.operators.ranking import numbered

# Buckets of node types (5 is unknown) and of actions.
NODE_BUCKET = {"MP": 0, "TP": 1, "process": 1, "thread": 1, "MF": 2, "TF": 3, "file": 3, "module": 3, "SO": 4, "network": 4, "socket": 4, "ip": 4}
ACTION_BUCKET = {"WF": 0, "WR": 0, "write": 0, "RF": 1, "RD": 1, "RCV": 1, "read": 1, "EX": 2, "execute": 2, "clone": 2, "ST": 3, "mmap": 3, "send": 3, "FR": 4, "load": 4, "LOAD": 4, "IJ": 2, "inject": 2}
# The tactics that a whole chain has.
REQUIRED_TACTICS = ["initial-access", "execution", "persistence", "defense-evasion", "command-and-control", "exfiltration"]


def sides(edges: DataFrame) -> DataFrame:
    """(graph_id, node, type, out, edge_id, action): both ends of every edge."""
    end = lambda node, kind, out: edges.select("graph_id", F.col(node).alias("node"), F.col(kind).alias("type"), F.lit(out).alias("out"), "edge_id", "action")
    return end("actorID", "actor_type", 1).unionByName(end("objectID", "object", 0))


def node_degrees(edges: DataFrame) -> DataFrame:
    """(graph_id, node, in_deg, out_deg, degree, max_degree) over the multigraph."""
    each = sides(edges).groupBy("graph_id", "node").agg(F.sum(1 - F.col("out")).alias("in_deg"), F.sum("out").alias("out_deg"), F.count("*").alias("degree"))
    most = each.groupBy("graph_id").agg(F.max("degree").alias("max_degree"))
    return each.join(most, "graph_id")


def _shares() -> list[Column]:
    bucket = lookup(F.trim("action"), ACTION_BUCKET, -1)
    known = F.count_if(bucket >= 0)
    return [F.when(known > 0, F.count_if(bucket == i) / known).otherwise(0.0) for i in range(5)]


def node_action_freq(edges: DataFrame) -> DataFrame:
    """(graph_id, node, freq array[5]): shares of the five action groups over a node's edge sides."""
    return sides(edges).groupBy("graph_id", "node").agg(F.array(*_shares()).alias("freq"))


def node_features(edges: DataFrame) -> DataFrame:
    """(graph_id, node, features array[30]): type one-hot 6, action shares 5, degrees over the graph's largest 3, zeros 16.

    A node's type is that of its first edge side, the actor's before the object's. One aggregation by node.
    """
    each = sides(edges).groupBy("graph_id", "node").agg(
        F.min_by("type", F.struct("edge_id", -F.col("out"))).alias("type"), F.array(*_shares()).alias("freq"), F.sum(1 - F.col("out")).alias("in_deg"), F.sum("out").alias("out_deg"), F.count("*").alias("degree")
    )
    most = F.greatest("_most", F.lit(1))
    each = each.join(each.groupBy("graph_id").agg(F.max("degree").alias("_most")), "graph_id")
    bucket = lookup(F.trim("type"), NODE_BUCKET, 5)
    hot = F.array(*(F.when(bucket == i, 1.0).otherwise(0.0) for i in range(6)))
    return each.select("graph_id", "node", F.concat(hot, "freq", F.array(*(F.col(c) / most for c in ("degree", "in_deg", "out_deg"))), F.array_repeat(F.lit(0.0), 16)).alias("features"))


def index_graph(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (graph_id, node, idx by first appearance) and edges (graph_id, edge_id, src_idx, dst_idx)."""
    first = sides(edges).groupBy("graph_id", "node").agg(F.min(F.struct("edge_id", -F.col("out"))).alias("_first"))
    nodes = numbered(first, ["_first", "node"], ["graph_id"], "_i").select("graph_id", "node", F.col("_i").cast("int").alias("idx"))
    end = lambda c, to: nodes.select("graph_id", F.col("node").alias(c), F.col("idx").alias(to))
    indexed = edges.select("graph_id", "edge_id", "actorID", "objectID").join(end("actorID", "src_idx"), ["graph_id", "actorID"]).join(end("objectID", "dst_idx"), ["graph_id", "objectID"])
    return nodes, indexed.select("graph_id", "edge_id", "src_idx", "dst_idx")


def graph_state(edges: DataFrame) -> DataFrame:
    """(graph_id, n_nodes, n_edges, density): edges over nodes."""
    nodes = sides(edges).groupBy("graph_id").agg(F.count_distinct("node").alias("n_nodes"), F.sum("out").alias("n_edges"))
    return nodes.withColumn("density", F.round(F.col("n_edges") / (F.col("n_nodes") + 1e-9), 6))


def density_mean_degree(edges: DataFrame) -> DataFrame:
    """(graph_id, density, mean_degree) of the simple digraph: E / (N (N - 1)) and 2 E / N."""
    n = sides(edges).groupBy("graph_id").agg(F.count_distinct("node").alias("_n"))
    e = edges.select("graph_id", "actorID", "objectID").distinct().groupBy("graph_id").agg(F.count("*").alias("_e"))
    density = F.when(F.col("_n") > 1, F.col("_e") / (F.col("_n") * (F.col("_n") - 1))).otherwise(0.0)
    return n.join(e, "graph_id").select("graph_id", F.round(density, 6).alias("density"), F.round(2 * F.col("_e") / F.col("_n"), 6).alias("mean_degree"))


def clustering_coefficient(edges: DataFrame) -> DataFrame:
    """(graph_id, clustering): mean local coefficient of the undirected simple graph without loops; 0 up to two nodes.

    Wedges start at the lower end in (degree, name) order, so a hub is the middle of few.
    """
    all_nodes = sides(edges).select("graph_id", "node").distinct()
    pair = edges.where("actorID != objectID").select("graph_id", F.least("actorID", "objectID").alias("a"), F.greatest("actorID", "objectID").alias("b")).distinct()
    ends = pair.select("graph_id", F.col("a").alias("node")).unionByName(pair.select("graph_id", F.col("b").alias("node")))
    degree = ends.groupBy("graph_id", "node").agg(F.count("*").alias("d"))
    deg = lambda c: degree.select("graph_id", F.col("node").alias(c), F.col("d").alias(f"d{c}"))
    ranked = pair.join(deg("a"), ["graph_id", "a"]).join(deg("b"), ["graph_id", "b"])
    low = F.struct("da", "a") < F.struct("db", "b")
    out = ranked.select("graph_id", F.when(low, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("v"))
    wedge = out.alias("x").join(out.alias("y"), (F.col("x.graph_id") == F.col("y.graph_id")) & (F.col("x.u") == F.col("y.u")) & (F.col("x.v") < F.col("y.v")))
    wedge = wedge.select(F.col("x.graph_id").alias("graph_id"), F.col("x.u").alias("u"), F.col("x.v").alias("a"), F.col("y.v").alias("b"))
    corner = wedge.join(pair, ["graph_id", "a", "b"]).select("graph_id", F.explode(F.array("u", "a", "b")).alias("node"))
    triangles = corner.groupBy("graph_id", "node").agg(F.count("*").alias("t"))
    local = F.when(F.col("d") > 1, 2 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0)
    joined = all_nodes.join(degree, ["graph_id", "node"], "left").join(triangles, ["graph_id", "node"], "left").select("graph_id", F.coalesce(local, F.lit(0.0)).alias("c"))
    return joined.groupBy("graph_id").agg(F.round(F.when(F.count("*") > 2, F.avg("c")).otherwise(0.0), 6).alias("clustering"))


def stage_hubs(edges: DataFrame, k: int = 1) -> DataFrame:
    """(graph_id, stage, node, rank, score): the k nodes of largest degree in each stage of edges (graph_id, stage, src, dst), ties by name."""
    degree = edges.select("graph_id", "stage", F.explode(F.array("src", "dst")).alias("node")).groupBy("graph_id", "stage", "node").agg(F.count("*").alias("score"))
    top = Window.partitionBy("graph_id", "stage").orderBy(F.desc("score"), "node")
    return degree.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("graph_id", "stage", "node", "rank", "score")


def hub_nodes(edges: DataFrame, k: int = 1, by: str = "degree") -> DataFrame:
    """(graph_id, node, rank): the k nodes of largest degree (or out_deg), ties by name."""
    top = Window.partitionBy("graph_id").orderBy(F.desc(by), "node")
    return node_degrees(edges).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).select("graph_id", "node", "rank", F.col(by).alias("score"))


def sink_ratio(edges: DataFrame) -> DataFrame:
    """(graph_id, sinks, sink_ratio, avg_degree): nodes with edges in but none out."""
    return node_degrees(edges).groupBy("graph_id").agg(
        F.count_if((F.col("out_deg") == 0) & (F.col("in_deg") > 0)).alias("sinks"),
        F.round(F.count_if((F.col("out_deg") == 0) & (F.col("in_deg") > 0)) / F.count("*"), 6).alias("sink_ratio"),
        F.round(F.avg("degree"), 6).alias("avg_degree"),
    )


def edge_type_distribution(edges: DataFrame) -> DataFrame:
    """(graph_id, action, n, share)."""
    counts = edges.groupBy("graph_id", "action").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("graph_id")), 6))


def risk_impact(edges: DataFrame) -> DataFrame:
    """(graph_id, impact): mean risk of the actions, 1 at most."""
    return edges.groupBy("graph_id").agg(F.round(F.least(F.avg(action_risk(F.col("action"))), F.lit(1.0)), 6).alias("impact"))


def surface_features(edges: DataFrame, codes: Sequence[str] = ("read", "write", "execute", "clone", "send", "mmap")) -> DataFrame:
    """(graph_id, n_nodes, n_edges, 3 node type shares, a share for each of the six codes)."""
    nodes = sides(edges).groupBy("graph_id", "node").agg(F.min_by("type", F.struct("edge_id", -F.col("out"))).alias("type"))
    shares = nodes.groupBy("graph_id").agg(F.count("*").alias("n_nodes"), *(F.round(F.count_if(F.col("type") == t) / F.count("*"), 6).alias(f"share_{t}") for t in ("process", "file", "socket")))
    acts = edges.groupBy("graph_id").agg(F.count("*").alias("n_edges"), *(F.round(F.count_if(F.col("action") == a) / F.count("*"), 6).alias(f"share_{a}") for a in codes))
    return shares.join(acts, "graph_id")


def connected_ratio(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, connectivity): share of the listed nodes that have an edge."""
    used = sides(edges).select("graph_id", "node").distinct().withColumn("_used", F.lit(1.0))
    return nodes.join(used, ["graph_id", "node"], "left").groupBy("graph_id").agg(F.round(F.avg(F.coalesce("_used", F.lit(0.0))), 6).alias("connectivity"))


def tactic_coverage(chain: DataFrame, required: list[str] = REQUIRED_TACTICS) -> DataFrame:
    """(graph_id, coverage): share of the required tactics that a chain (graph_id, tactic) has."""
    return chain.groupBy("graph_id").agg(F.round(F.count_distinct(F.when(F.col("tactic").isin(required), F.col("tactic"))) / len(required), 6).alias("coverage"))


def label_novelty(nodes: DataFrame, references: DataFrame, max_refs: int = 10) -> DataFrame:
    """(graph_id, novelty): 1 - the mean Jaccard similarity of a graph's labels with each of the first ``max_refs`` reference graphs; 0.5 without any.

    Tables are (graph_id, label). Common labels are counted by a join on the label, so nothing is collected; a pair without
    one has similarity 0. The bound on references is the reference's own.
    """
    own, ref = nodes.select("graph_id", "label").distinct(), references.select("graph_id", "label").distinct()
    first = ref.select("graph_id").distinct().orderBy("graph_id").limit(max_refs)
    ref = ref.join(F.broadcast(first), "graph_id").select(F.col("graph_id").alias("_ref"), "label")
    sizes, ref_sizes = own.groupBy("graph_id").agg(F.count("*").alias("_a")), ref.groupBy("_ref").agg(F.count("*").alias("_b"))
    common = own.join(ref.hint("merge"), "label").groupBy("graph_id", "_ref").agg(F.count("*").alias("_c"))
    alike = common.join(sizes.hint("merge"), "graph_id").join(F.broadcast(ref_sizes), "_ref").groupBy("graph_id").agg(F.sum(F.col("_c") / (F.col("_a") + F.col("_b") - F.col("_c"))).alias("_s"))
    n = first.agg(F.count("*").alias("_n"))
    mean = F.coalesce("_s", F.lit(0.0)) / F.col("_n")
    return sizes.join(alike.hint("merge"), "graph_id", "left").crossJoin(F.broadcast(n)).select("graph_id", F.round(F.when(F.col("_n") > 0, 1 - mean).otherwise(0.5), 6).alias("novelty"))


def mean_transition_quality(transitions: DataFrame) -> DataFrame:
    """(graph_id, value): the mean of a graph's scores (graph_id, score) that aren't null; 0.5 without any."""
    return transitions.groupBy("graph_id").agg(F.round(F.coalesce(F.avg("score"), F.lit(0.5)), 6).alias("value"))


def stage_validity_ratio(reports: DataFrame) -> DataFrame:
    """(graph_id, value): the share of a graph's stage reports (graph_id, valid) that are valid; 0.5 without any (all null)."""
    return reports.groupBy("graph_id").agg(F.round(F.coalesce(F.avg(F.col("valid").cast("int")), F.lit(0.5)), 6).alias("value"))


def mask_validity(edges: DataFrame) -> DataFrame:
    """(graph_id, validity): the share of edges (graph_id, legal) that the action mask allows."""
    return edges.groupBy("graph_id").agg(F.round(F.avg(F.coalesce("legal", F.lit(False)).cast("int")), 6).alias("validity"))


def graph_structure(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, n_nodes, unique_labels, isolated, bridge_edges) of nodes (graph_id, node, label) and edges (graph_id, src, dst, is_bridge)."""
    used = edges.select("graph_id", F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("_used", F.lit(1))
    listed = nodes.join(used.hint("merge"), ["graph_id", "node"], "left").groupBy("graph_id").agg(F.count("*").alias("n_nodes"), F.count_distinct("label").alias("unique_labels"), F.count_if(F.col("_used").isNull()).alias("isolated"))
    bridges = edges.groupBy("graph_id").agg(F.count_if("is_bridge").alias("_b"))
    return listed.join(bridges.hint("merge"), "graph_id", "left").select("graph_id", "n_nodes", "unique_labels", "isolated", F.coalesce("_b", F.lit(0)).alias("bridge_edges"))


def node_role(nodes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Nodes with ``role``.

    Without edges, for assembled graphs (graph_id, node, is_bridge, is_hub): bridge, hub, then input, output and executable
    artifacts by what the id holds, else internal. With edges (graph_id, src, dst), for sampled graphs (graph_id, node, type):
    the node of most edges out is the hub (ties by name), other processes are internal, the rest input if nothing goes out of
    them, else output.
    """
    if edges is None:
        holds = lambda part: F.contains("node", F.lit(part))
        yes = lambda c: F.coalesce(F.col(c), F.lit(False))
        role = F.when(yes("is_bridge"), "bridge").when(yes("is_hub") | holds("__p0_"), "hub").when(holds("__fin"), "input_artifact").when(holds("__fh"), "output_artifact").when(holds("__exec"), "executable_artifact").otherwise("internal")
        return nodes.withColumn("role", role)
    out = edges.groupBy("graph_id", F.col("src").alias("node")).agg(F.count("*").alias("_out"))
    degree = nodes.join(out.hint("merge"), ["graph_id", "node"], "left").withColumn("_out", F.coalesce("_out", F.lit(0)))
    hub = degree.groupBy("graph_id").agg(F.min_by("node", F.struct(-F.col("_out"), "node")).alias("_hub"))
    role = F.when(F.col("node") == F.col("_hub"), "hub").when(F.col("type") == "process", "internal").when(F.col("_out") == 0, "input").otherwise("output")
    return degree.join(hub.hint("merge"), "graph_id").withColumn("role", role).select(*nodes.columns, "role")


# Weights of the quality score and of its macro and micro blends.
QUALITY = {"coverage": 0.25, "connectivity": 0.2, "validity": 0.25, "novelty": 0.05, "depth": 0.1, "transition": 0.1, "stage_validity": 0.05}
MACRO = {"coverage": 0.45, "transition": 0.35, "novelty": 0.15, "stage_validity": 0.05}
MICRO = {"validity": 0.35, "connectivity": 0.25, "depth": 0.2, "stage_validity": 0.2}


def graph_quality_score(parts: DataFrame, weights: Mapping[str, float] = QUALITY) -> DataFrame:
    """Parts (coverage, connectivity, validity, novelty, depth, transition, stage_validity) with total, macro and micro, each a weighted sum. A null part makes its sums null."""
    blend = lambda table: F.round(sum(F.col(c) * w for c, w in table.items()), 6)
    return parts.withColumns({"total": blend(weights), "macro": blend(MACRO), "micro": blend(MICRO)})
