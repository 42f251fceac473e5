"""The registered queries of chains, ordered patterns and vectors on graphs, with their SQL; they join those of ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.functions.names import TACTICS
from provgraph.operators import chains as T
from provgraph.operators import evaluate as M
from provgraph.operators import features as G
from provgraph.operators import pooling as L
from provgraph.plans.queries import CONF, ORACLES, PRED, PRED2, RANKS, SM, _add, _ends
from provgraph.plans.views import with_views

# Vectors on graphs.
_nodes = lambda d: d.select(F.col("grp").alias("graph_id"), F.col("id").alias("node"), "vec")
_attention = lambda d: d.select(F.col("grp").alias("graph_id"), F.col("id").alias("src"), (F.col("id") % 7 / 10).alias("weight"))
_add(
    "m10_pool_top_nodes", "vectors", lambda d: L.pool_top_nodes(_nodes(d), _attention(d)),
    """select grp as graph_id, cast(dim as int) as dim, round(sum(w * cast(vec[dim + 1] as double)) / sum(w), 6) as value from (select *, id % 7 / 10 as w, count(*) over (partition by grp) as n, row_number() over (partition by grp order by id % 7 desc, id) as r from vectors), unnest(range(64)) t(dim)
    where r <= least(n, greatest(12, ceil(n * 0.5))) group by grp, dim""",
)
_degrees = lambda d: G.node_degrees(d).select("graph_id", "node", F.array("in_deg", "out_deg").alias("vec"))
_add(
    "m12_aggregate_neighbors", "small_graphs",
    lambda d: L.aggregate_neighbors(_ends(d), _degrees(d)).select("graph_id", "node", *(F.round(F.col("vec")[i], 6).alias(c) for i, c in enumerate(("own_in", "own_out", "near_in", "near_out")))),
    f"""select v.graph_id, v.node, v.i as own_in, v.o as own_out, round(coalesce(m.i, 0), 6) as near_in, round(coalesce(m.o, 0), 6) as near_out from deg v left join
    (select e.graph_id, e.actorID as node, avg(d.i) as i, avg(d.o) as o from (select distinct graph_id, actorID, objectID from small_graphs) e join deg d on d.graph_id = e.graph_id and d.node = e.objectID group by e.graph_id, e.actorID) m on m.graph_id = v.graph_id and m.node = v.node""",
)
ORACLES["m12_aggregate_neighbors"] = ORACLES["m12_aggregate_neighbors"].replace(" select v.graph_id", f", deg as (select graph_id, node, cast(sum(1 - o) as double) as i, cast(sum(o) as double) as o from {SM} group by all) select v.graph_id", 1)
_next = lambda d: d.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
DOT = "list_dot_product(cast({a} as double[]), cast({b} as double[]))"
_add("m14_edge_score", "vectors", lambda d: L.edge_score(_next(d), d), f"select a.id as src, b.id as dst, round(1 / (1 + exp(-{DOT.format(a='a.vec', b='b.vec')})), 6) as score from vectors a join vectors b on b.id = a.id + 1")
_add(
    "m16_anomaly_ratio", "vectors", lambda d: L.anomaly_ratio(d.select(F.col("grp").alias("graph_id"), F.element_at("vec", 1).cast("double").alias("x")), 2.0),
    """select graph_id, round(avg(case when mad > 0 and 0.6745 * d / mad > 2.0 then 1 else 0 end), 6) as ratio from (select *, median(d) over (partition by graph_id) as mad from (select grp as graph_id, abs(cast(vec[1] as double) - median(cast(vec[1] as double)) over (partition by grp)) as d from vectors)) group by graph_id""",
)
_metrics = lambda d, p: M.binary_metrics(M.confusion(M.threshold_predict(d, 0.5, p), ["grp"]))
EPS = "select grp, round(2 * (tp / (tp + fp + 1e-9)) * (tp / (tp + fn + 1e-9)) / (tp / (tp + fp + 1e-9) + tp / (tp + fn + 1e-9) + 1e-9), 6) as f1, round(tp / (tp + fn + 1e-9), 6) as recall, round(fn / (tp + fn + 1e-9), 6) as fn_rate from (select grp, {c} from {p} group by grp)"
_add(
    "m6_metric_deltas", "scores", lambda d: L.metric_deltas(_metrics(d, "prob"), _metrics(d, "prob_after")),
    f"select a.grp, round(b.f1 - a.f1, 6) as d_f1, round(b.recall - a.recall, 6) as d_recall, round(b.fn_rate - a.fn_rate, 6) as d_fn_rate from ({EPS.format(c=CONF, p=PRED)}) a join ({EPS.format(c=CONF, p=PRED2)}) b on a.grp = b.grp",
)
_add(
    "m21_latency_stats", "scores", lambda d: L.latency_stats(M.threshold_predict(d, 0.5, "prob_after").withColumn("latency_ms", F.col("sample_id") % 97 / 10)),
    "select round(avg(sample_id % 97 / 10), 6) as mean_ms, count(*) as n from scores where prob_after is not null",
)
ORACLES["a4_importance"] = with_views("select r.graph_id, r.node, round(0.4", "small_graphs").replace(
    " select r.graph_id, r.node, round(0.4",
    f", {RANKS} select r.graph_id, r.node, round(0.4 * rank * n + 0.3 * round(case when n > 1 then d / (n - 1) else 1.0 end, 6) + 0.3 + 1e-9, 6) as importance from r20 r join (select *, count(*) over (partition by graph_id) as n from (select graph_id, node, count(*) as d from {SM} group by all)) c on c.graph_id = r.graph_id and c.node = r.node",
    1,
)
SHARE = "round(count(*) filter ({c}) / count(*), 6) as share_{v}"
ORACLES["g6_surface_features"] = with_views(
    f"select a.*, b.* exclude (graph_id) from (select graph_id, count(*) as n_nodes, {', '.join(SHARE.format(c=f'type = {v!r}', v=v) for v in ('process', 'file', 'socket'))} from (select graph_id, node, arg_min(type, edge_id * 2 + 1 - o) as type from {SM} group by all) group by graph_id) a "
    f"join (select graph_id, count(*) as n_edges, {', '.join(SHARE.format(c=f'action = {v!r}', v=v) for v in ('read', 'write', 'execute', 'clone', 'send', 'mmap'))} from small_graphs group by graph_id) b on a.graph_id = b.graph_id",
    "small_graphs",
)

# Chains.
_text = lambda lead, n: F.concat(F.lit(lead), (F.col("id") % n).cast("string"))


def _contexts(d: DataFrame) -> DataFrame:
    sets = F.array(F.array(_text("a", 3), _text("b", 5)), F.array(_text("c", 2)), F.array().cast("array<string>"))
    return d.select("id", sets.alias("sets"), (F.col("id") % 4 / 4).alias("privilege"), (F.col("id") % 3 == 0).alias("impact"))


SETS = "['a' || {x}.id % 3, 'b' || {x}.id % 5]"
OVERLAP = f"len(list_intersect({SETS.format(x='a')}, {SETS.format(x='b')})) / len(list_distinct(list_concat({SETS.format(x='a')}, {SETS.format(x='b')})))"
CONTEXT = f"({OVERLAP} + case when a.id % 2 = b.id % 2 then 1.0::double else 0.0 end + 1 - abs(a.id % 4 / 4 - b.id % 4 / 4) + case when (a.id % 3 = 0) = (b.id % 3 = 0) then 1 else 0 end) / 4"
HYBRID = f"round(0.65 * {DOT.format(a='a.vec', b='b.vec')} / (sqrt({DOT.format(a='a.vec', b='a.vec')}) * sqrt({DOT.format(a='b.vec', b='b.vec')})) + 0.35 * {CONTEXT}, 6)"
_add("t4_hybrid_similarity", "vectors", lambda d: T.hybrid_similarity(_next(d), d, _contexts(d)).where("similarity is not null"), f"select a.id as src, b.id as dst, {HYBRID} as similarity from vectors a join vectors b on b.id = a.id + 1")
_chain = lambda d: d.select(F.col("grp").alias("chain_id"), F.col("id").alias("pos"), F.col("id").alias("item"))
_outside = lambda d: T.consecutive(_chain(d)).where("src % 3 = 0").select("src", "dst", (F.col("src") % 10 / 10).alias("external"))
_add(
    "t6_score_transitions", "vectors", lambda d: T.score_transitions(_chain(d), d, _contexts(d), _outside(d), threshold=0.4),
    f"""select chain_id, pos, src, dst, score, score >= 0.4 as kept from (select c.grp as chain_id, c.id as pos, c.id as src, c.n as dst, case when c.id % 3 = 0 then round(0.55 * (c.id % 10 / 10) + 0.45 * {HYBRID} + 1e-9, 6) else {HYBRID} end as score
    from (select grp, id, lead(id) over (partition by grp order by id) as n from vectors) c join vectors a on a.id = c.id join vectors b on b.id = c.n)""",
)
_add(
    "t7_order_chain", "ev_edges",
    lambda d: T.order_chain(d.select(F.col("actorID").alias("actor"), F.col("edge_id").alias("item"), F.array(F.element_at(F.array(*map(F.lit, TACTICS)), (F.col("edge_id") % len(TACTICS) + 1).cast("int"))).alias("tactics"), F.col("edge_id").alias("kb_pos"))).withColumn("pos", F.col("pos").cast("bigint")),
    f"select actor, pos, item from (select actorID as actor, edge_id as item, row_number() over (partition by actorID order by edge_id % {len(TACTICS)}, edge_id) as pos from ev_edges) where pos <= 8",
)
_add(
    "t8_one_per_tactic", "ev_edges", lambda d: T.one_per_tactic(d.select(F.col("actorID").alias("chain_id"), F.col("edge_id").alias("pos"), F.col("edge_id").alias("item"), F.col("action").alias("tactic"))).select("chain_id", "tactic", "item"),
    "select actorID as chain_id, action as tactic, min(edge_id) as item from ev_edges group by all",
)
_items = lambda d: d.select(F.col("id").alias("item"), F.col("grp").alias("actor"), F.col("id").alias("pos"), F.concat(F.lit("t"), (F.col("id") % 5).cast("string")).alias("tactic"), "vec")
_add("t11_similar_subsequences", "vectors", lambda d: T.similar_subsequences(_items(d), _items(d)))

# Ordered patterns: a read followed by an execute, per daily graph.
_triples = lambda d: d.select("graph_id", F.lit(1).alias("stage"), "edge_id", F.col("action").alias("triple"), F.col("actorID").alias("src"), F.col("objectID").alias("dst"))
_rules = lambda d: d.sparkSession.createDataFrame([("read-execute", 1, "read"), ("read-execute", 2, "execute")], "rule string, step int, triple string")
MATCHES = """(select graph_id, a, b, row_number() over (partition by graph_id order by a) as match_no from (select graph_id, action, edge_id as a, lead(edge_id) over (partition by graph_id order by edge_id) as b
from (select *, lag(action) over (partition by graph_id order by edge_id) as before from ev_edges where action in ('read', 'execute')) where action is distinct from before) where action = 'read' and b is not null)"""
_add(
    "q1_match_sequences", "ev_edges",
    lambda d: T.match_sequences(_triples(d), _rules(d)).select("graph_id", "stage", "rule", F.col("match_no").cast("bigint").alias("match_no"), F.array_join(F.col("edge_ids").cast("array<string>"), ",").alias("edges")),
    f"select graph_id, 1 as stage, 'read-execute' as rule, match_no, a || ',' || b as edges from {MATCHES}",
)
_add("q2_check_precedence", "ev_edges", lambda d: T.check_precedence(d.select("graph_id", F.col("edge_id").alias("pos"), F.col("action").alias("tactic")), "clone", "write"), "select graph_id, coalesce(min(edge_id) filter (action = 'clone') <= min(edge_id) filter (action = 'write'), true) as ok from ev_edges group by graph_id")
_add(
    "q3_rule_coverage", "ev_edges", lambda d: T.rule_coverage(T.match_sequences(_triples(d), _rules(d)), _triples(d)),
    f"""select graph_id, 1 as stage, round(avg(hit), 6) as coverage from (select graph_id, node, max(hit) as hit from (select e.graph_id, unnest([e.actorID, e.objectID]) as node, case when m.edge_id is null then 0 else 1 end as hit
    from ev_edges e left join (select graph_id, unnest([a, b]) as edge_id from {MATCHES}) m on m.graph_id = e.graph_id and m.edge_id = e.edge_id) group by all) group by graph_id""",
)
