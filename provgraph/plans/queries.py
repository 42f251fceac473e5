"""The registered queries of the event-graph operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provgraph.functions import names as N
from provgraph.operators import evaluate as M
from provgraph.operators import features as G
from provgraph.operators import graph as A
from provgraph.operators import joins as J
from provgraph.operators import monitor as W
from provgraph.operators import results as R
from provgraph.operators import sampling as C
from provgraph.operators import validate as V
from provgraph.plans.views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, views: str, build: Callable[..., DataFrame], sql: str | None = None) -> None:
    """Register ``build(*views)`` under ``name``, with SQL over the same views."""
    wanted = views.split()
    QUERIES[name] = lambda spark, sf_dir: build(*(view(spark, sf_dir, v) for v in wanted))
    if sql:
        ORACLES[name] = with_views(sql, *wanted)


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select("graph_id", F.col("actorID").alias("src"), F.col("objectID").alias("dst"))


def _nodes(ends: DataFrame) -> DataFrame:
    return A.endpoints(ends).distinct()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day: the hub, and the graph's size, density and risk. One reading of the edges: a row a node, then a row a graph."""
    risk = F.when(F.col("out") == 1, N.action_risk(F.col("action")))
    nodes = G.sides(view(spark, sf_dir, "ev_edges")).groupBy("graph_id", "node").agg(F.count("*").alias("_d"), F.sum("out").alias("_o"), F.sum(risk).alias("_r"))
    n, e = F.count("*"), F.sum("_o")
    return nodes.groupBy("graph_id").agg(
        n.alias("n_nodes"), e.alias("n_edges"), F.round(e / (n + 1e-9), 6).alias("density"), F.round(F.least(F.sum("_r") / e, F.lit(1.0)), 6).alias("impact"),
        F.min_by("node", F.struct(-F.col("_d"), "node")).alias("hub"), F.max("_d").alias("hub_degree"),
    )


SIDES = "(select graph_id, actorID as node, actor_type as type, 1 as o, edge_id, action from {v} union all select graph_id, objectID, object, 0, edge_id, action from {v})"
EV, SM = SIDES.format(v="ev_edges"), SIDES.format(v="small_graphs")


def _case(col: str, table: dict, default: str) -> str:
    return f"case {col} " + " ".join(f"when '{k}' then {v!r}" for k, v in table.items()) + f" else {default} end"


def _in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


# Scalar functions.
EVENTS = ["EVENT_WRITE", "EVENT_READ", "EVENT_CLONE", "EVENT_OTHER", "EVENT_CONNECT", "EVENT_MMAP", "EVENT_LOADLIBRARY"]
_event = lambda d: F.element_at(F.array(*map(F.lit, EVENTS)), (d.edge_id % len(EVENTS) + 1).cast("int"))
_add(
    "p1_map_event_action", "ev_edges", lambda d: d.select("edge_id", N.map_event_action(_event(d)).alias("action")).where("action is not null"),
    f"select * from (select edge_id, {_case('[' + ', '.join(repr(e) for e in EVENTS) + '][edge_id % 7 + 1]', N.EVENT_ACTION, 'null')} as action from ev_edges) where action is not null",
)
CLEAN = "trim(replace(split_part(regexp_replace(trim({c}), '^\\d+_(.)', '\\1'), '-', 1), '*', ''))"
_add("p4_clean_entity_type", "mix_edges", lambda d: d.select("edge_id", N.clean_entity_type(F.col("src_type")).alias("t")), f"select edge_id, {CLEAN.format(c='src_type')} as t from mix_edges")
CUT = "regexp_replace(regexp_replace(regexp_replace({c}, '\\.exe$', '', 'i'), '\\.bin$', '', 'i'), '\\.sh$', '', 'i')"
LAST = "trim(lower(split_part(trim(tool), '-', -1)))"
TOOL = (
    f"case when contains(trim(tool), '-') and {LAST} <> '' and not regexp_full_match(replace({LAST}, '.', ''), '\\d+') then {CUT.format(c=LAST)} "
    f"else trim(lower({CUT.format(c='''regexp_replace(split_part(replace(trim(tool), chr(92), '/'), '/', -1), '[*]+$', '')''')})) end"
)
EXT = "case when contains(trim(target), '.') and regexp_matches(trim(lower(split_part(trim(target), '.', -1))), '[a-z]') and not contains(target, '://') and not regexp_full_match(split_part(trim(target), '-', -1), '[\\d.]+') then '.' || trim(lower(split_part(trim(target), '.', -1))) else '' end"
LABEL = "case when contains(target, '.') then '.' || lower(split_part(target, '.', -1)) else '' end"
_add("p5_normalize_tool", "mix_edges", lambda d: d.select("edge_id", N.normalize_tool(F.col("tool")).alias("t")), f"select edge_id, {TOOL} as t from mix_edges")
_add("p6_name_extension", "mix_edges", lambda d: d.select("edge_id", N.name_extension(F.col("target")).alias("x")), f"select edge_id, {EXT} as x from mix_edges")
EXECUTABLE = f"({LABEL}) in {_in(N.EXECUTABLE_LABELS)}"
_add("p7_label_extension", "mix_edges", lambda d: d.select("edge_id", N.label_extension(F.col("target")).alias("x"), N.is_executable(F.col("target")).alias("e")), f"select edge_id, {LABEL} as x, {EXECUTABLE} as e from mix_edges")
_add(
    "p11_to_env_codes", "mix_edges",
    lambda d: d.select("edge_id", N.lookup(F.col("src_kind"), N.NODE_CODE, "SO").alias("s"), N.lookup(F.col("dst_kind"), N.NODE_CODE, "SO").alias("d"), F.coalesce(N.lookup(F.col("code"), N.EDGE_CODE), "code").alias("verb")),
    f"select edge_id, {_case('src_kind', N.NODE_CODE, chr(39) + 'SO' + chr(39))} as s, {_case('dst_kind', N.NODE_CODE, chr(39) + 'SO' + chr(39))} as d, {_case('code', N.EDGE_CODE, 'code')} as verb from mix_edges",
)
RISK = "case action when 'execute' then 1.0 when 'mmap' then 0.8 when 'write' then 0.6 when 'read' then 0.2 when 'clone' then 0.9 else 0.1 end"
_add("p15_action_risk", "ev_edges", lambda d: d.select("edge_id", N.action_risk(F.col("action")).alias("risk")), f"select edge_id, cast({RISK} as double) as risk from ev_edges")

# Validation.
S, D = CLEAN.format(c="src_type"), CLEAN.format(c="dst_type")
BROKEN = " or ".join(f"(s in {_in(a)} and verb = '{v}' and d in {_in(b)})" for a, v, b in V.FORBIDDEN)
TYPED = f"(select *, {S} as s, {D} as d from mix_edges)"
_add("v1_filter_type_rules", "mix_edges", lambda d: V.filter_type_rules(d).select("edge_id", "src_type", "verb", "dst_type"), f"select edge_id, src_type, verb, dst_type from {TYPED} where not ({BROKEN})")
TOOLBAD = (
    f"(verb in ('FR', 'IJ', 'EX') and t <> '' and t not in {_in(V.EXECUTORS)}) or (verb = 'EX' and target not in ('', 'unknown') and x not in {_in(V.PROGRAM_EXTENSIONS)}) or (verb in ('ST', 'RF') and t <> '' and t not in {_in(V.NETWORK)})"
)
_add("v2_filter_tool_rules", "mix_edges", lambda d: V.filter_tool_rules(d).select("edge_id", "tool", "verb", "target"), f"select edge_id, tool, verb, target from (select *, {TOOL} as t, {EXT} as x from mix_edges) where not ({TOOLBAD})")
_add(
    "v3_graph_validity", "mix_edges", V.graph_validity,
    f"select graph_id, count(*) as total, count(*) filter ({BROKEN}) as removed, count(*) filter (not ({BROKEN})) as remaining, round(count(*) filter ({BROKEN}) / count(*), 6) as rate, count(*) filter ({BROKEN}) / count(*) <= 0.30 as graph_valid from {TYPED} group by graph_id",
)
_add("v3_violation_counts", "mix_edges", V.violation_counts, f"select graph_id, s as src_type, verb, d as dst_type, count(*) as n from {TYPED} where {BROKEN} group by all")


def _reindexed(edges: DataFrame) -> DataFrame:
    nodes, indexed = G.index_graph(edges)
    listed = nodes.select("graph_id", F.col("idx").alias("node_idx"), "node")
    kept = indexed.where("edge_id % 3 = 0").select("graph_id", "edge_id", F.col("src_idx").alias("src"), F.col("dst_idx").alias("dst"))
    return V.drop_dangling_nodes(listed, kept)[1]


INDEXED = f"firsts as (select graph_id, node, min(edge_id * 2 + 1 - o) as f from {SM} group by all), idx as (select graph_id, node, row_number() over (partition by graph_id order by f) - 1 as i from firsts), pairs as (select e.graph_id, e.edge_id, a.i as src, b.i as dst from small_graphs e join idx a on a.graph_id = e.graph_id and a.node = e.actorID join idx b on b.graph_id = e.graph_id and b.node = e.objectID)"
ORACLES["v4_drop_dangling"] = with_views(
    "select p.graph_id, p.edge_id, a.n as src, b.n as dst from kept p join num a on a.graph_id = p.graph_id and a.i = p.src join num b on b.graph_id = p.graph_id and b.i = p.dst", "small_graphs"
).replace(" select p.graph_id, p.edge_id", f", {INDEXED}, kept as (select * from pairs where edge_id % 3 = 0), used as (select graph_id, src as i from kept union select graph_id, dst from kept), num as (select graph_id, i, cast(row_number() over (partition by graph_id order by i) - 1 as int) as n from used) select p.graph_id, p.edge_id", 1)
_add("v4_drop_dangling", "small_graphs", _reindexed)
_coded = lambda d: d.select("graph_id", "edge_id", F.col("src_kind").alias("src_type"), F.col("dst_kind").alias("dst_type"), F.col("target").alias("dst_label"), "code", "is_bridge")
LEGAL = " or ".join(f"(src_kind || '>' || dst_kind = '{k}' and code in {_in(v)})" for k, v in V.LEGAL.items()) + f" or (src_kind = 'process' and dst_kind = 'file' and code = 'EX' and {EXECUTABLE})"
_add("v5_check_action_mask", "mix_edges", lambda d: V.check_action_mask(_coded(d)).select("edge_id", "legal"), f"select edge_id, {LEGAL} as legal from mix_edges")
_add(
    "v6_repair_edges", "mix_edges", lambda d: V.repair_edges(_coded(d)).select("edge_id", "old_code", "code", "reason"),
    f"""select edge_id, code as old_code, case when {LEGAL} then code else arg_min(c, md5(concat_ws('|', '0', cast(edge_id as varchar), c))) filter (c is not null) end as code,
    case when {LEGAL} then 'kept' when count(c) > 0 then 'replaced' else 'removed' end as reason
    from (select *, unnest(case src_kind || '>' || dst_kind when 'process>process' then ['FR'] when 'process>file' then case when {EXECUTABLE} then ['RF', 'WF', 'EX'] else ['RF', 'WF'] end when 'process>socket' then ['ST'] when 'file>process' then ['RF', 'LOAD'] when 'socket>process' then ['RCV'] else [null] end) as c from mix_edges)
    group by edge_id, code, src_kind, dst_kind, target""",
)
_add(
    "v7_semantic_violations", "mix_edges", lambda d: V.semantic_violations(_coded(d)),
    f"""select graph_id, edge_id, kind from (select graph_id, edge_id, unnest([case when not ({LEGAL}) then 'mask' end, case when code = 'FR' and src_kind = 'process' and dst_kind = 'file' then 'fork_to_file' end,
    case when code = 'EX' and not ({EXECUTABLE}) then 'execute_non_executable' end, case when src_kind = 'process' and dst_kind = 'process' and code <> 'FR' and not is_bridge then 'process_to_process' end,
    case when code = 'LATERAL_MOVE' and src_kind = 'process' and dst_kind = 'process' then 'lateral_move' end, case when is_bridge and src_kind = 'process' and dst_kind = 'process' then 'bridge_joins_processes' end]) as kind from mix_edges) where kind is not null""",
)
_add("v10_allowed_triples", "mix_edges", lambda d: V.filter_allowed_triples(d, d.where("edge_id % 50 = 0").select("src_type", "verb", "dst_type").distinct()).select("edge_id"), "select edge_id from mix_edges where (src_type, verb, dst_type) in (select (src_type, verb, dst_type) from mix_edges where edge_id % 50 = 0)")

# Joins.
_bad = lambda d: d.select(F.explode(F.array("actorID", "objectID")).alias("uuid")).where(F.substring(F.md5("uuid"), 1, 1) < "4").distinct()
_add("j2_mark_malicious", "ev_edges", lambda d: J.mark_malicious_nodes(d, _bad(d)).select("edge_id", "src_bad", "dst_bad"), "select edge_id, substring(md5(actorID), 1, 1) < '4' as src_bad, substring(md5(objectID), 1, 1) < '4' as dst_bad from ev_edges")
_add(
    "j1_attach_node_types", "mix_edges ev_edges",
    lambda m, e: J.attach_node_types(e.select("edge_id", F.col("actorID").alias("src"), F.col("objectID").alias("dst")), e.join(m.select("edge_id", "src_kind"), "edge_id").where("edge_id % 7 = 0").select(F.col("actorID").alias("uuid"), F.col("src_kind").alias("type"), F.col("edge_id").alias("pos"))).select("edge_id", "actor_type", "object"),
    "select e.edge_id, coalesce(t.type, 'process') as actor_type, 'file' as object from ev_edges e left join (select actorID, arg_max(src_kind, edge_id) as type from ev_edges join mix_edges using (edge_id) where edge_id % 7 = 0 group by actorID) t on t.actorID = e.actorID",
)
_add("j7_hold_out", "scores", lambda d: J.hold_out(d, "grp", ["fr", "es"]).select("sample_id", "grp"), "select sample_id, grp from scores where grp not in ('fr', 'es')")
_add("j7_restrict", "scores", lambda d: J.restrict(d, "grp", ["fr", "es"]).select("sample_id", "grp"), "select sample_id, grp from scores where grp in ('fr', 'es')")
_runs = lambda d: J.compare_runs(M.threshold_predict(d), M.threshold_predict(d.where("sample_id % 5 != 0"), prob="prob_after"))
RUNS = "(select sample_id, label, cast(prob >= 0.5 as int) as pred_base, case when sample_id % 5 <> 0 then cast(prob_after >= 0.5 as int) end as pred_after from scores)"
_add("j8_compare_runs", "scores", _runs, f"select * from {RUNS}")

# Features.
_add("g1_node_degrees", "ev_edges", G.node_degrees, f"select *, max(degree) over (partition by graph_id) as max_degree from (select graph_id, node, cast(sum(1 - o) as bigint) as in_deg, cast(sum(o) as bigint) as out_deg, count(*) as degree from {EV} group by all)")
BUCKET = _case("action", G.ACTION_BUCKET, "-1")
FREQ = "[" + ", ".join(f"case when count(*) filter (b >= 0) > 0 then count(*) filter (b = {i}) / count(*) filter (b >= 0) else 0.0 end" for i in range(5)) + "]"
_flat = lambda d, c: d.select("graph_id", "node", F.array_join(F.transform(c, lambda x: F.round(x * 1e6).cast("bigint").cast("string")), ",").alias(c))
FLAT = "array_to_string(list_transform({c}, lambda x: cast(cast(round(x * 1e6) as bigint) as varchar)), ',')"
_add("g2_action_freq", "ev_edges", lambda d: _flat(G.node_action_freq(d), "freq"), f"select graph_id, node, {FLAT.format(c='f')} as freq from (select graph_id, node, {FREQ} as f from (select *, {BUCKET} as b from {EV}) group by all)")
HOT = "[" + ", ".join(f"case when {_case('type', G.NODE_BUCKET, '5')} = {i} then 1.0 else 0.0 end" for i in range(6)) + "]"
_add(
    "g3_node_features", "small_graphs", lambda d: _flat(G.node_features(d), "features"),
    f"select graph_id, node, {FLAT.format(c='x')} as features from (select graph_id, node, list_concat({HOT}, list_concat(f, list_concat([degree / m, i / m, o / m], list_transform(range(16), lambda z: 0.0)))) as x from (select *, max(degree) over (partition by graph_id) as m from (select graph_id, node, arg_min(type, edge_id * 2 + 1 - o) as type, {FREQ} as f, count(*) as degree, sum(1 - o) as i, sum(o) as o from (select *, {BUCKET} as b from {SM}) group by all)))",
)
_add("g4_index_graph", "small_graphs", lambda d: G.index_graph(d)[1])
ORACLES["g4_index_graph"] = with_views("select graph_id, edge_id, cast(src as int) as src_idx, cast(dst as int) as dst_idx from pairs", "small_graphs").replace(" select graph_id, edge_id, cast(src", f", {INDEXED} select graph_id, edge_id, cast(src", 1)
_add("g5_graph_state", "ev_edges", G.graph_state, f"select graph_id, count(distinct node) as n_nodes, cast(sum(o) as bigint) as n_edges, round(sum(o) / (count(distinct node) + 1e-9), 6) as density from {EV} group by graph_id")
_add("g6_surface_features", "small_graphs", G.surface_features)
_add(
    "g7_density", "small_graphs", G.density_mean_degree,
    f"select graph_id, round(e / (n * (n - 1)), 6) as density, round(2 * e / n, 6) as mean_degree from (select graph_id, count(distinct node) as n from {SM} group by all) join (select graph_id, count(*) as e from (select distinct graph_id, actorID, objectID from small_graphs) group by all) using (graph_id)",
)
_add(
    "g8_weak_components", "small_graphs", lambda d: A.weak_components(_ends(d)),
    "select graph_id, node, min(other) as component from reach group by all",
)
ORACLES["g8_weak_components"] = with_views("select graph_id, node, min(other) as component from reach group by all", "small_graphs").replace(
    " select graph_id, node, min(other)", ", und as (select graph_id, actorID as a, objectID as b from small_graphs union select graph_id, objectID, actorID from small_graphs), reach as (select graph_id, a as node, a as other from und union select r.graph_id, r.node, u.b from reach r join und u on u.graph_id = r.graph_id and u.a = r.other) select graph_id, node, min(other)", 1
)
_add(
    "g9_clustering", "small_graphs", G.clustering_coefficient,
    f"""select graph_id, round(case when count(*) > 2 then avg(coalesce(c, 0)) else 0 end, 6) as clustering from (select distinct graph_id, node from {SM}) n left join (
    select graph_id, a as node, case when d > 1 then t * 1.0 / (d * (d - 1)) else 0 end as c from (select x.graph_id, x.a, count(distinct x.b) as d, (select count(*) from und y join und z on y.graph_id = z.graph_id and y.b = z.a join und w on w.graph_id = z.graph_id and w.a = z.b and w.b = y.a where y.graph_id = x.graph_id and y.a = x.a) as t from und x group by x.graph_id, x.a)) using (graph_id, node) group by graph_id""",
)
ORACLES["g9_clustering"] = ORACLES["g9_clustering"].replace(" select graph_id, round(case", ", und as (select graph_id, actorID as a, objectID as b from small_graphs where actorID <> objectID union select graph_id, objectID, actorID from small_graphs where actorID <> objectID) select graph_id, round(case", 1)
_add("g12_connected_ratio", "small_graphs", lambda d: G.connected_ratio(_nodes(_ends(d)), d.where("edge_id % 2 = 0")), "select graph_id, round(avg(case when node in (select x from (select graph_id as g, unnest([actorID, objectID]) as x from small_graphs where edge_id % 2 = 0) where g = graph_id) then 1.0 else 0.0 end), 6) as connectivity from (select distinct graph_id, unnest([actorID, objectID]) as node from small_graphs) group by graph_id")
_add("g13_mask_validity", "mix_edges", lambda d: V.check_action_mask(_coded(d)).groupBy("graph_id").agg(F.round(F.avg(F.col("legal").cast("int")), 6).alias("validity")), f"select graph_id, round(avg(case when {LEGAL} then 1 else 0 end), 6) as validity from mix_edges group by graph_id")
_add("g16_hub_nodes", "ev_edges", lambda d: G.hub_nodes(d, 3).withColumn("rank", F.col("rank").cast("bigint")), f"select graph_id, node, rank, score from (select *, row_number() over (partition by graph_id order by score desc, node) as rank from (select graph_id, node, count(*) as score from {EV} group by all)) where rank <= 3")
_add("g17_sink_ratio", "small_graphs", G.sink_ratio, f"select graph_id, count(*) filter (o = 0) as sinks, round(count(*) filter (o = 0) / count(*), 6) as sink_ratio, round(avg(d), 6) as avg_degree from (select graph_id, node, sum(o) as o, count(*) as d from {SM} group by all) group by graph_id")
_add("g18_edge_types", "ev_edges", G.edge_type_distribution, "select graph_id, action, n, round(n / sum(n) over (partition by graph_id), 6) as share from (select graph_id, action, count(*) as n from ev_edges group by all)")
_add("g19_risk_impact", "ev_edges", G.risk_impact, f"select graph_id, round(least(avg(cast({RISK} as double)), 1.0), 6) as impact from ev_edges group by graph_id")

# Graph algorithms.
_add("a1_degree_centrality", "small_graphs", lambda d: A.degree_centrality(_nodes(_ends(d)), _ends(d)), f"select graph_id, node, round(case when n > 1 then d / (n - 1) else 1.0 end, 6) as centrality from (select *, count(*) over (partition by graph_id) as n from (select graph_id, node, count(*) as d from {SM} group by all))")
_add("a2_pagerank", "small_graphs", lambda d: A.pagerank(_nodes(_ends(d)), _ends(d)).withColumn("rank", F.round(F.col("rank") + 1e-9, 6)))
RANKS = "r0 as (select graph_id, node, 1.0::double / count(*) over (partition by graph_id) as rank, 1.0::double / count(*) over (partition by graph_id) as one from (select distinct graph_id, node from " + SM + ")), outd as (select graph_id, actorID, count(*) as o from small_graphs group by all), wts as (select e.graph_id, e.actorID as s, e.objectID as d, count(*) / any_value(o) as w from small_graphs e join outd u on u.graph_id = e.graph_id and u.actorID = e.actorID group by e.graph_id, e.actorID, e.objectID)"
for _i in range(20):
    RANKS += f", r{_i + 1} as (select b.graph_id, b.node, 0.15 * b.one + 0.85 * coalesce(g, 0) as rank, b.one from r{_i} b left join (select w.graph_id, w.d, sum(w.w * r.rank) as g from wts w join r{_i} r on r.graph_id = w.graph_id and r.node = w.s group by w.graph_id, w.d) x on x.graph_id = b.graph_id and x.d = b.node)"
ORACLES["a2_pagerank"] = with_views("select graph_id, node, round(rank + 1e-9, 6) as rank from r20", "small_graphs").replace(" select graph_id, node, round(rank", f", {RANKS} select graph_id, node, round(rank", 1)
_add("a3_stage_coverage", "trade_edges", A.stage_coverage, "select graph_id, node, count(distinct stage) as n_stages from (select graph_id, stage, src as node from trade_edges union all select graph_id, stage, dst from trade_edges) group by all")
_add("a4_importance", "small_graphs", lambda d: A.importance(_nodes(_ends(d)), _ends(d).withColumn("stage", F.lit(1))))
_add(
    "a5_k_hop", "small_graphs", lambda d: A.k_hop(_ends(d), d.groupBy("graph_id").agg(F.min("actorID").alias("node"))),
    "select graph_id, node, min(hop) as hop from hops group by all",
)
ORACLES["a5_k_hop"] = ORACLES["a5_k_hop"].replace(" select graph_id, node, min(hop)", ", und as (select graph_id, actorID as a, objectID as b from small_graphs union select graph_id, objectID, actorID from small_graphs), hops as (select graph_id, min(actorID) as node, 0 as hop from small_graphs group by graph_id union select h.graph_id, u.b, h.hop + 1 from hops h join und u on u.graph_id = h.graph_id and u.a = h.node where h.hop < 3) select graph_id, node, min(hop)", 1)
_add("a7_compress_recent", "ev_edges", lambda d: A.compress_recent(d, 0.3).select("graph_id", "edge_id"), "select graph_id, edge_id from (select *, row_number() over (partition by graph_id order by edge_id desc) as r, count(*) over (partition by graph_id) as n from ev_edges) where r <= greatest(50, floor(n * 0.3))")
_add("a8_compression_report", "ev_edges", lambda d: A.compression_report(d, A.compress_recent(d, 0.3)), "select graph_id, n as before, k as after, round(1 - k / n, 6) as ratio, round(greatest(0, 1 - k / n - 0.5), 6) as loss from (select graph_id, count(*) as n, cast(least(count(*), greatest(50, floor(count(*) * 0.3))) as bigint) as k from ev_edges group by graph_id)")

# Sampling.
DRAW = "md5(concat_ws('|', '0', cast({k} as varchar)))"
_add("c8_oversample", "scores", lambda d: C.oversample(d).select("sample_id", "label", "copy"), "select sample_id, label, cast(c as int) as copy from (select *, row_number() over (partition by label order by sample_id) - 1 as p, count(*) over (partition by label) as n, (select max(k) from (select count(*) as k from scores group by label)) as m from scores), unnest(range(1000)) t(c) where c * n + p < m")
_add("c9_class_weights", "scores", C.class_weights, "select 0 as label, 1.0::double as weight union all select 1, round(least(count(*) filter (label = 0) / count(*) filter (label = 1), 3.0), 6) from scores")
_add("c10_pair_negatives", "scores", lambda d: C.pair_negatives(d.where("label = 1"), d.where("label = 0")), f"select p.sample_id as pos_id, q.sample_id as neg_id from scores p join (select sample_id, row_number() over (order by sample_id) - 1 as i from scores where label = 0) q on q.i = cast('0x' || substring({DRAW.format(k='p.sample_id')}, 1, 8) as bigint) % (select count(*) from scores where label = 0) where p.label = 1")
_add("c11_split_groups", "mix_edges", lambda d: C.split_groups(d.select("graph_id", "edge_id"), "graph_id").select("edge_id", "split"), f"select edge_id, case when r <= floor(n * (2 / 3)) then 'train' else 'test' end as split from mix_edges join (select graph_id, row_number() over (order by {DRAW.format(k='graph_id')}, graph_id) as r, count(*) over () as n from (select distinct graph_id from mix_edges)) using (graph_id)")
_add("c12_sample_edges", "ev_edges", lambda d: C.sample_edges(d, 0.6).select("graph_id", "edge_id"), f"select graph_id, edge_id from (select *, row_number() over (partition by graph_id order by {DRAW.format(k='edge_id')}, edge_id) as r, count(*) over (partition by graph_id) as n from ev_edges) where r <= greatest(1, floor(n * 0.6))")
_add("c13_sample_weighted", "ev_edges", lambda d: C.sample_weighted(d.withColumn("w", N.action_risk(F.col("action"))), "graph_id", "edge_id", "w", 20).select("graph_id", "edge_id"), f"select graph_id, edge_id from (select graph_id, edge_id, row_number() over (partition by graph_id order by round(ln((cast('0x' || substring({DRAW.format(k='edge_id')}, 1, 8) as bigint) + 0.5) / 4294967296.0) / cast({RISK} as double), 9) desc, edge_id) as r from ev_edges) where r <= 20")
EVEN = "(select graph_id, count(*) as e, unnest([0.0::double, 0.5, 1.0]) as camo_ratio, graph_id || '__camo' || cast(camo_ratio as varchar) as sample_id from small_graphs where cast(graph_id as int) % 2 = 0 group by graph_id)"
_add(
    "c7_mix_in_noise", "small_graphs", lambda d: C.mix_in_noise(d.where("cast(graph_id as int) % 2 = 0"), d.where("cast(graph_id as int) % 2 = 1"), [0.0, 0.5, 1.0]),
    f"""select sample_id, camo_ratio, edge_id, 'own' as origin from (select graph_id, edge_id from small_graphs) join {EVEN} using (graph_id)
    union all select sample_id, camo_ratio, p.edge_id, 'noise' from (select *, unnest(range(0, cast(round_even(e * camo_ratio, 0) as int))) as slot from {EVEN}) s
    join (select edge_id, row_number() over (order by {DRAW.format(k='edge_id')}, edge_id) - 1 as i, count(*) over () as n from small_graphs where cast(graph_id as int) % 2 = 1) p
    on p.i = (cast('0x' || substring({DRAW.format(k='sample_id')}, 1, 8) as bigint) + slot) % p.n""",
)

# Evaluation.
PRED = "(select *, cast(prob >= 0.5 as int) as pred from scores)"
CONF = "count(*) filter (label = 1 and pred = 1) as tp, count(*) filter (label = 0 and pred = 1) as fp, count(*) filter (label = 1 and pred = 0) as fn, count(*) filter (label = 0 and pred = 0) as tn, count(pred) as n, count(*) filter (pred is null) as n_skipped"
PRED2 = "(select *, cast(prob_after >= 0.5 as int) as pred from scores)"
_add("m1_threshold_predict", "scores", lambda d: M.threshold_predict(d, 0.5, "prob_after").select("sample_id", "pred"), f"select sample_id, pred from {PRED2}")
_add("m2_confusion", "scores", lambda d: M.confusion(M.threshold_predict(d, 0.5, "prob_after"), ["grp"]), f"select grp, {CONF} from {PRED2} group by grp")
_add(
    "m3_binary_metrics", "scores", lambda d: M.binary_metrics(M.confusion(M.threshold_predict(d), ["grp"])),
    f"select *, round(tp / (tp + fp + 1e-9), 6) as precision, round(tp / (tp + fn + 1e-9), 6) as recall, round(2 * (tp / (tp + fp + 1e-9)) * (tp / (tp + fn + 1e-9)) / (tp / (tp + fp + 1e-9) + tp / (tp + fn + 1e-9) + 1e-9), 6) as f1, round((tp + tn) / (tp + fp + fn + tn + 1e-9), 6) as accuracy, round(fn / (tp + fn + 1e-9), 6) as fn_rate from (select grp, {CONF} from {PRED} group by grp)",
)
_add("m4_roc_auc", "scores", lambda d: M.roc_auc(d, ["grp"]), "select g.grp, round(avg(case when p.prob > q.prob then 1.0 when p.prob = q.prob then 0.5 when p.prob < q.prob then 0.0 end), 6) as auc from (select distinct grp from scores) g left join scores p on p.grp = g.grp and p.label = 1 left join scores q on q.grp = g.grp and q.label = 0 group by g.grp")
_add("m5_recovery", "scores", lambda d: M.recovery_rate(_runs(d)), f"select round(1 - count(*) filter (pred_after = 0) / count(*), 6) as value, count(*) as n, count(*) filter (pred_after is null) as n_unscored from {RUNS} where label = 1 and pred_base = 0")
_add("m5_retention", "scores", lambda d: M.retention(_runs(d)), f"select round(count(*) filter (pred_after = label) / count(*), 6) as value, count(*) as n, count(*) filter (pred_after is null) as n_unscored from {RUNS} where pred_base = label")
_add(
    "m7_class_report", "scores", lambda d: M.class_report(M.threshold_predict(d)),
    f"select c as class, round(case when p > 0 then t / p else 0 end, 6) as precision, round(case when s > 0 then t / s else 0 end, 6) as recall, round(case when t > 0 then 2 * (t / p) * (t / s) / (t / p + t / s) else 0 end, 6) as f1, s as support from (select c, count(*) filter (label = c and pred = c) as t, count(*) filter (pred = c) as p, count(*) filter (label = c) as s from {PRED}, unnest([0, 1]) x(c) group by c)",
)
_add("m8_class_confidence", "scores", M.class_confidence, "select label, round(avg(prob), 6) as mean, round(stddev_pop(prob), 6) as std, round(min(prob), 6) as min, round(max(prob), 6) as max from scores group by label")
_add("m9_robustness", "scores", M.robustness_curve, "select camo_ratio, round(avg(prob), 6) as mean_prob, count(*) filter (prob < 0.5) as missed, count(*) as n from scores where label = 1 group by camo_ratio")
_add("m11_mean_pool", "vectors", lambda d: M.mean_pool(d.withColumnRenamed("grp", "graph_id")), "select grp as graph_id, cast(dim as int) as dim, round(avg(cast(vec[dim + 1] as double)), 6) as value from vectors, unnest(range(64)) t(dim) group by all")
_add("m15_top_critical", "scores", lambda d: M.top_critical(d, 5, "grp", "sample_id", "prob").withColumn("rank", F.col("rank").cast("bigint")), "select grp, sample_id, rank from (select grp, sample_id, row_number() over (partition by grp order by prob desc, sample_id) as rank from scores) where rank <= 5")
_add(
    "m17_sliced_wasserstein", "vectors", lambda d: M.sliced_wasserstein(d.where("grp < 5"), d.where("grp >= 5")),
    """select dim, round(sum(abs(f - g) * coalesce(nx - x, 0)), 6) as distance from (select dim, x, sum(sum(a)) over (partition by dim order by x) / sum(sum(a)) over (partition by dim) as f, sum(sum(b)) over (partition by dim order by x) / sum(sum(b)) over (partition by dim) as g, lead(x) over (partition by dim order by x) as nx
    from (select cast(dim as int) as dim, cast(vec[dim + 1] as double) as x, cast(grp < 5 as int) as a, cast(grp >= 5 as int) as b from vectors, unnest(range(64)) t(dim)) group by dim, x) group by dim""",
)
_add("m20_class_means", "scores", lambda d: M.class_means(d, ["prob", "prob_after"]), "select 'prob' as feature, round(avg(prob) filter (label = 0), 6) as mean_0, round(avg(prob) filter (label = 1), 6) as mean_1 from scores union all select 'prob_after', round(avg(prob_after) filter (label = 0), 6), round(avg(prob_after) filter (label = 1), 6) from scores")
_add("t3_t5_nearest_in_group", "vectors", lambda d: M.nearest_in_group(d.where("id % 10 = 0"), d, 3).withColumn("rank", F.col("rank").cast("bigint")), "select id, candidate, sim, rank from (select *, row_number() over (partition by id order by sim desc, candidate) as rank from (select a.id, b.id as candidate, round(list_dot_product(cast(a.vec as double[]), cast(b.vec as double[])) / (sqrt(list_dot_product(cast(a.vec as double[]), cast(a.vec as double[]))) * sqrt(list_dot_product(cast(b.vec as double[]), cast(b.vec as double[])))), 6) as sim from vectors a join vectors b on a.grp = b.grp and a.id <> b.id where a.id % 10 = 0)) where rank <= 3")

# Monitors.
ROLL = "window w as (partition by run_id order by step rows between 19 preceding and current row)"
_add(
    "w1_rolling_confusion", "steps", W.rolling_confusion,
    f"select *, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) as recall, round(case when tp > 0 then 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) else 0 end, 6) as f1, round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy from (select *, n - tp - fp - fn as tn from (select run_id, step, cast(sum(tp) over w as bigint) as tp, cast(sum(fp) over w as bigint) as fp, cast(sum(fn) over w as bigint) as fn, count(*) over w as n from steps {ROLL}))",
)
ORACLES["w1_rolling_confusion"] = ORACLES["w1_rolling_confusion"].replace("select *, round(case when tp + fp", "select * exclude (n), round(case when tp + fp")
QUERIES["w1_rolling_confusion"] = lambda spark, sf_dir: W.rolling_confusion(view(spark, sf_dir, "steps"))
_add("w2_rolling_miss_rate", "steps", W.rolling_miss_rate, f"select run_id, step, round(sum(fn) over w / (sum(fn) over w + sum(tp) over w + 1e-9), 6) as miss_rate from steps {ROLL}")
CONV = "coalesce(count(*) over w12 = 12 and avg(f1) over w12 >= 0.75 and round(stddev_samp(miss_rate) over w12, 9) < 0.04 and avg(miss_rate) over w12 < 0.20, false)"
W12 = "w12 as (partition by run_id order by step rows between 11 preceding and current row)"
_add("w3_converged", "steps", W.converged, f"select run_id, step, {CONV} as flag from steps window {W12}")
BEST = "(select *, coalesce(combined > max(combined) over (partition by run_id order by step rows between unbounded preceding and 1 preceding), true) as is_new from steps)"
FLAT15 = f"(select run_id, step, coalesce(count(*) over w15 = 15 and round(stddev_samp(reward) over w15, 9) < 0.10 and step - max(case when is_new then step end) over up >= 15, false) as flag from {BEST} window w15 as (partition by run_id order by step rows between 14 preceding and current row), up as (partition by run_id order by step))"
_add("w4_plateau", "steps", W.plateau, f"select * from {FLAT15}")
BAD = "(select run_id, step, step - coalesce(max(case when not miss_rate > 0.80 then step end) over up, 0) >= 15 or step - coalesce(max(case when not (f1 < 0.05 and step > 20) then step end) over up, 0) >= 20 as flag from steps window up as (partition by run_id order by step))"
_add("w5_degraded", "steps", W.degraded, f"select * from {BAD}")
_add("w6_stop_status", "steps", W.stop_status, f"select run_id, arg_min(reason, step) as reason, min(step) as step from (select run_id, step, case when d.flag then 'FAILURE' when c.flag then 'CONVERGED' when p.flag then 'PLATEAU' end as reason from {BAD} d join (select run_id, step, {CONV} as flag from steps window {W12}) c using (run_id, step) join {FLAT15} p using (run_id, step)) where reason is not null group by run_id")
_add("w7_running_best", "steps", lambda d: W.running_best(d).drop("best_miss_rate"), f"select run_id, step, max(f1) over up as best_f1, max(combined) over up as best_combined, is_new as is_new_best from {BEST} window up as (partition by run_id order by step)")
_add("w8_episode_summary", "steps", lambda d: W.episode_summary(d).select("run_id", "episode", "calls", "misses", "miss_rate", "mean_f1"), "select run_id, episode, count(*) as calls, cast(sum(fn) as bigint) as misses, round(sum(fn) / (sum(fn) + sum(tp) + 1e-9), 6) as miss_rate, round(avg(f1), 6) as mean_f1 from steps group by run_id, episode")
_add("w9_arm_posteriors", "steps", lambda d: W.arm_posteriors(d.select((F.col("step") % 3).alias("arm"), F.col("tp").alias("success"))), "select step % 3 as arm, 1 + count(*) filter (tp = 1) as alpha, 1 + count(*) filter (tp = 0) as beta, round((1 + count(*) filter (tp = 1)) / (2 + count(*)), 6) as mean from steps group by 1")
_add("w10_hard_samples", "scores", lambda d: W.hard_samples(d, 50).withColumn("rank", F.col("rank").cast("bigint")), "select * from (select sample_id, round(1 - 2 * abs(prob - 0.5), 6) as priority, row_number() over (order by round(1 - 2 * abs(prob - 0.5), 6) desc, sample_id) as rank from scores where label = 1 and prob < 0.5) where rank <= 50")

# Results.
_mapped = lambda d: d.groupBy("rq", "condition", "seed").agg(F.round(F.avg("qty"), 6).alias("q"), F.round(F.avg("disc"), 6).alias("d")).select("rq", "condition", "seed", F.create_map(F.lit("qty"), F.col("q"), F.lit("disc"), F.col("d")).alias("metrics"))
LONG = "(select rq, condition, seed, 'qty' as metric, round(avg(qty), 6) as value from results group by all union all select rq, condition, seed, 'disc', round(avg(disc), 6) from results group by all)"
_add("r1_melt_metrics", "results", lambda d: R.melt_metrics(_mapped(d)), f"select * from {LONG}")
SUMMARY = f"(select rq, condition, metric, round(avg(value), 6) as mean, round(stddev_pop(value), 6) as std, count(*) as n_seeds from {LONG} group by rq, condition, metric)"
_add("r2_seed_summary", "results", lambda d: R.seed_summary(R.melt_metrics(_mapped(d))), f"select * from {SUMMARY}")
_add("r3_pivot_summary", "results", lambda d: R.pivot_summary(R.seed_summary(R.melt_metrics(_mapped(d))), ["qty", "disc"], ["NO", "RF"]), f"select rq, condition, max(mean) filter (metric = 'qty') as qty, max(mean) filter (metric = 'disc') as disc, case condition when 'NO' then 1 when 'RF' then 2 else 999 end as place from {SUMMARY} group by rq, condition")
_add("r4_corpus_counts", "scores", lambda d: R.corpus_counts(d, ["grp", "label"]), "select grp, label, count(*) as n from scores group by rollup (grp, label)")

QUERIES["flagship"] = flagship
ORACLES["flagship"] = with_views(
    f"select s.*, i.impact, h.node as hub, h.score as hub_degree from (select graph_id, count(distinct node) as n_nodes, cast(sum(o) as bigint) as n_edges, round(sum(o) / (count(distinct node) + 1e-9), 6) as density from {EV} group by graph_id) s join (select graph_id, round(least(avg(cast({RISK} as double)), 1.0), 6) as impact from ev_edges group by graph_id) i using (graph_id) join (select graph_id, node, score from (select *, row_number() over (partition by graph_id order by score desc, node) as r from (select graph_id, node, count(*) as score from {EV} group by all)) where r = 1) h using (graph_id)",
    "ev_edges",
)
