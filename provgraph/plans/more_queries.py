"""Registered queries of names, validation, graph measures, reduction, sampling and corpora, with their SQL; they join those of ``queries``.

Expected values of scalar functions are written out in the SQL, so a wrong constant in the library shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provgraph.functions import names as N
from provgraph.operators import corpora as K
from provgraph.operators import evaluate as M
from provgraph.operators import features as G
from provgraph.operators import graph as A
from provgraph.operators import joins as J
from provgraph.operators import monitor as W
from provgraph.operators import pooling as L
from provgraph.operators import reduce as B
from provgraph.operators import results as R
from provgraph.operators import sampling as C
from provgraph.operators import validate as V
from provgraph.plans.chain_queries import DOT
from provgraph.plans.queries import BROKEN, CLEAN, CONF, DRAW, EXT, LEGAL, ORACLES, PRED, RANKS, SM, TOOL, _add, _in
from provgraph.plans.views import with_views


def _pick(column: str, *values) -> Column:
    """One of the values by a row's number."""
    listed = F.array(*(F.lit(v) if not isinstance(v, list) else F.array(*map(F.lit, v)) for v in values))
    return F.element_at(listed, (F.col(column) % len(values) + 1).cast("int"))


def _cases(column: str, *values) -> str:
    return f"case {column} % {len(values)} " + " ".join(f"when {i} then {v}" for i, v in enumerate(values)) + " end"


def _put(name: str, lead: str, select: str, *views: str) -> None:
    """SQL with further tables before its select."""
    ORACLES[name] = with_views("select 0 as _mark", *views).replace(" select 0 as _mark", f", {lead} {select}")


# Scalar functions.
_add("p2_object_type", "mix_edges", lambda d: d.select("edge_id", N.object_type(F.concat("code", F.when(F.col("dst_kind") == "socket", "NetFlowObject").otherwise("FileObject"))).alias("t")), "select edge_id, case when dst_kind = 'socket' then 'socket' else 'file' end as t from mix_edges")
_reference = lambda: F.when(F.col("edge_id") % 4 == 0, F.concat(F.lit('{"n":1,"com.x.UUID":"'), "actorID", F.lit('"}'))).when(F.col("edge_id") % 4 == 1, F.col("actorID")).when(F.col("edge_id") % 4 == 2, F.lit('{"n":2}'))
_add("p3_ref_uuid", "ev_edges", lambda d: d.select("edge_id", N.ref_uuid(_reference()).alias("u")), "select edge_id, case when edge_id % 4 < 2 then actorID end as u from ev_edges")
_add(
    "p8_normalize_platform", "ev_edges", lambda d: d.select("edge_id", N.normalize_platform(_pick("edge_id", "Windows 10", "linux", "Mac OS", "macOS", "Network", "Office 365", None)).alias("x")),
    f"select edge_id, {_cases('edge_id', *map(repr, ('windows', 'linux', 'macos', 'macos', 'network', 'office-365', '')))} as x from ev_edges",
)
_add(
    "p9_privilege_score", "ev_edges", lambda d: d.select("edge_id", N.privilege_score(_pick("edge_id", ["User", "SYSTEM"], ["root"], ["user"], ["guest"], ["Administrator", "User"])).alias("x")),
    f"select edge_id, cast({_cases('edge_id', 1.0, 0.5, 0.2, 0.0, 0.5)} as double) as x from ev_edges",
)
_add(
    "p11_edge_codes", "mix_edges", lambda d: N.to_env_codes(d, "src_kind", "dst_kind").select("edge_id", "src_kind", "dst_kind", "code"),
    """select edge_id, case src_kind when 'process' then 'MP' when 'file' then 'MF' else 'SO' end as src_kind, case dst_kind when 'process' then 'MP' when 'file' then 'MF' else 'SO' end as dst_kind,
    case code when 'FR' then 'EX' when 'WF' then 'WR' when 'RF' then 'RD' when 'RCV' then 'RF' when 'LOAD' then 'RD' else code end as code from mix_edges""",
)
_add(
    "p12_edges_by_label", "small_graphs",
    lambda d: N.edges_by_label(d.select("graph_id", F.col("actorID").alias("src"), F.col("objectID").alias("dst"), F.lit("RF").alias("type"), F.when(F.col("edge_id") % 2 == 0, F.col("edge_id")).alias("event_order"), F.col("edge_id").alias("timestamp"), "edge_id"), _labelled(d).where("node != 'n0'")),
    """select e.graph_id, coalesce('l' || cast(substr(e.actorID, 2) as int) % 5, e.actorID) as actorID, case when e.actorID = 'n0' then 'MP' else case cast(substr(e.actorID, 2) as int) % 3 when 0 then 'MP' when 1 then 'MF' else 'SO' end end as actor_type,
    'l' || cast(substr(e.objectID, 2) as int) % 5 as objectID, case cast(substr(e.objectID, 2) as int) % 3 when 0 then 'MP' when 1 then 'MF' else 'SO' end as object, 'RD' as action, cast(e.edge_id as varchar) as timestamp from small_graphs e""",
)
ORACLES["p12_edges_by_label"] = ORACLES["p12_edges_by_label"].replace("coalesce('l' || cast(substr(e.actorID, 2) as int) % 5, e.actorID) as actorID", "case when e.actorID = 'n0' then 'n0' else 'l' || cast(substr(e.actorID, 2) as int) % 5 end as actorID").replace("'l' || cast(substr(e.objectID, 2) as int) % 5 as objectID, case cast", "case when e.objectID = 'n0' then 'n0' else 'l' || cast(substr(e.objectID, 2) as int) % 5 end as objectID, case when e.objectID = 'n0' then 'MF' else case cast").replace("else 'SO' end as object,", "else 'SO' end end as object,")
_add(
    "p13_fallback_name", "mix_edges", lambda d: d.select("edge_id", N.fallback_name(F.col("src_type")).alias("x")),
    f"select edge_id, case {CLEAN.format(c='src_type')} when 'MP' then 'unknown_process' when 'TP' then 'unknown_tool' when 'MF' then 'unknown_malware.bin' when 'SF' then 'unknown_sysfile' when 'TF' then 'unknown_tempfile.tmp' when 'SO' then '0.0.0.0:0' else 'unknown_entity' end as x from mix_edges",
)
_caps = lambda c: F.array(_pick(c, "file", "c2", "stealth"))
_add(
    "p16_bridge_hint", "ev_edges", lambda d: d.select("edge_id", N.bridge_hint(_pick("edge_id", "initial-access", "collection", "impact", "execution"), _pick("edge_id", "execution", "exfiltration", "impact", "discovery"), _caps("edge_id"), F.array(F.lit("file"))).alias("x")),
    "select edge_id, case edge_id % 4 when 0 then 'file' when 1 then 'socket' else case edge_id % 3 when 1 then 'socket' else 'file' end end as x from ev_edges",
)
_add(
    "p17_stage_order", "ev_edges", lambda d: d.select("edge_id", N.stage_order(_pick("edge_id", "stage3_T1", "bridge_1_2", "other", "stage12")).alias("x")),
    f"select edge_id, cast({_cases('edge_id', 3, 1.5, 999, 12)} as double) as x from ev_edges",
)
_add(
    "p18_tactic_rank", "ev_edges", lambda d: d.select("edge_id", N.tactic_rank(_pick("edge_id", ["impact", "execution"], ["reconnaissance"], ["none"], ["exfiltration"])).cast("int").alias("x")),
    f"select edge_id, {_cases('edge_id', 3, 0, 99, 12)} as x from ev_edges",
)


# Validation.
def _labelled(d: DataFrame) -> DataFrame:
    """Nodes of the small graphs: n7 has label l2 and, as 7 % 3 is 1, type file."""
    number = F.substring("node", 2, 9).cast("int")
    return A.endpoints(d.select("graph_id", F.col("actorID").alias("src"), F.col("objectID").alias("dst"))).distinct().select("graph_id", "node", F.concat(F.lit("l"), (number % 5).cast("string")).alias("label"), F.element_at(F.array(*map(F.lit, ("process", "file", "socket"))), number % 3 + 1).alias("type"))


NODES = f"(select distinct graph_id, node, cast(substr(node, 2) as int) as k from {SM})"
_typed = lambda d: d.select("graph_id", "edge_id", F.col("src_type").alias("src"), "verb", F.col("dst_type").alias("dst"))


def _by_type(d: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The mixed edges with their types' places in a list as node indices; index 7 isn't listed."""
    from provgraph.plans.views import TYPES

    place = lambda c: (F.array_position(F.array(*map(F.lit, TYPES)), F.col(c)) - 1).cast("int")
    listed = F.posexplode(F.array(*map(F.lit, TYPES[:-1]))).alias("node_idx", "type")
    return d.select("graph_id").distinct().select("graph_id", listed), d.select("graph_id", "edge_id", place("src_type").alias("src"), "verb", place("dst_type").alias("dst"))


S, D = CLEAN.format(c="src_type"), CLEAN.format(c="dst_type")
KINDED = f"(select *, case when src_type = 'ZZ' or dst_type = 'ZZ' then 'out_of_bounds' when {BROKEN} then s || '-' || verb || '->' || d end as kind from (select *, {S} as s, {D} as d from mix_edges))"
_add("v3_validate_graphs", "mix_edges", lambda d: V.validate_graphs(*_by_type(d))[1], f"select graph_id, count(*) as total, count(kind) as removed, count(*) - count(kind) as remaining, round(count(kind) / count(*), 6) as rate, count(kind) / count(*) <= 0.3 as graph_valid from {KINDED} group by graph_id")
_add("v3_kept_edges", "mix_edges", lambda d: V.validate_graphs(*_by_type(d))[0].select("graph_id", "edge_id"), f"select graph_id, edge_id from {KINDED} where kind is null")
_add("v3_violation_kinds", "mix_edges", lambda d: V.validate_graphs(*_by_type(d))[2], f"select graph_id, kind, count(*) as n from {KINDED} where kind is not null group by all")
_stage = lambda d: d.select("graph_id", F.col("edge_id").alias("stage"), _pick("edge_id", "persistence", "command-and-control", "impact", "credential-access").alias("tactic"), F.array("code").alias("edge_types"), F.array("src_kind", "dst_kind").alias("node_types"))
_add(
    "v9_stage_semantics", "mix_edges", lambda d: V.check_stage_semantics(_stage(d)).select("stage", F.array_join("issues", ",").alias("issues"), "valid"),
    """select edge_id as stage, i as issues, i = '' as valid from (select edge_id, concat_ws(',',
      case when (edge_id % 4 = 0 and code not in ('WF', 'RF', 'FR')) or (edge_id % 4 = 1 and code not in ('ST', 'RCV', 'RF')) or (edge_id % 4 = 3 and code not in ('RF', 'WF')) then 'no_edge' end,
      case when edge_id % 4 = 1 and src_kind <> 'socket' and dst_kind <> 'socket' and code not in ('ST', 'RCV') then 'no_network' end,
      case when edge_id % 4 in (0, 3) and src_kind <> 'file' and dst_kind <> 'file' then 'no_file' end) as i from mix_edges)""",
)
_gated = lambda d: (
    _labelled(d), d.select("graph_id", "edge_id", F.col("actorID").alias("src"), F.col("objectID").alias("dst"), F.when(F.col("edge_id") % 5 < 3, "WF").otherwise("RF").alias("code"), (F.col("edge_id") % 7 == 0).alias("is_bridge")),
    d.select("graph_id", _pick("edge_id", "execution", "impact", "discovery").alias("tactic")).where(F.col("graph_id").cast("int") % 2 == 0),
)
_add(
    "v8_quality_gate", "small_graphs", lambda d: V.quality_gate(*_gated(d)).select("graph_id", F.array_join("issues", ",").alias("issues"), "ok"),
    f"""select n.graph_id, i.issues, i.issues = '' as ok from (select distinct graph_id from small_graphs) n join (select a.graph_id, concat_ws(',', case when t < 3 then 'few_tactics' end, case when u < 0.5 * k then 'repeated_labels' end, case when w > 0.5 * e then 'writes_dominate' end, case when v > 0 then 'semantic' end) as issues from
      (select graph_id, count(*) as k, count(distinct k % 5) as u from {NODES} group by graph_id) a join (select graph_id, count(*) as e, count(*) filter (edge_id % 5 < 3) as w, case when cast(graph_id as int) % 2 = 0 then count(distinct edge_id % 3) else 0 end as t,
      count(*) filter (not ((s = 0 and o = 1) or (s = 1 and o = 0 and edge_id % 5 >= 3)) or (s = 0 and o = 0)) as v from (select *, cast(substr(actorID, 2) as int) % 3 as s, cast(substr(objectID, 2) as int) % 3 as o from small_graphs) group by graph_id) b on a.graph_id = b.graph_id) i on i.graph_id = n.graph_id""",
)
_named = lambda d: (
    d.select("graph_id", F.col("edge_id").alias("node"), F.col("src_type").alias("type"), F.when(F.col("edge_id") % 9 > 0, F.col("tool")).alias("name")),
    d.select("graph_id", F.col("edge_id").alias("src"), (F.col("edge_id") + 1).alias("dst"), "verb"),
)
BAD_TOOL = f"((verb in ('FR', 'IJ', 'EX') and {{t}} <> '' and {{t}} not in {_in(V.EXECUTORS)}) or (verb in ('ST', 'RF') and {{t}} <> '' and {{t}} not in {_in(V.NETWORK)}))"
_add(
    "v11_node_names", "mix_edges", lambda d: V.node_name_consistent(*_named(d)),
    f"""select n.graph_id, n.edge_id as node, src_type as type, case when coalesce(bad, 0) = 0 then name else {ORACLES['p13_fallback_name'].split('select edge_id, ')[-1].split(' as x')[0]} end as name, coalesce(bad, 0) = 0 as ok from (select *, case when edge_id % 9 > 0 then tool end as name from mix_edges) n left join
      (select graph_id, node, max(b) as bad from (select graph_id, edge_id as node, case when edge_id % 9 > 0 and {BAD_TOOL.format(t='t')} then 1 else 0 end as b from (select *, {TOOL} as t from mix_edges)
      union all select a.graph_id, b.edge_id, case when b.edge_id % 9 > 0 and (a.verb in ('FR', 'IJ', 'EX', 'ST', 'RF')) then 1 else 0 end from mix_edges a join mix_edges b on b.graph_id = a.graph_id and b.edge_id = a.edge_id + 1) group by all) x on x.graph_id = n.graph_id and x.node = n.edge_id""",
)
_add(
    "v12_prune_named", "mix_edges", lambda d: V.prune_named_edges(d.select("graph_id", F.col("edge_id").alias("node_idx"), F.when(F.col("edge_id") % 9 > 0, F.col("tool")).alias("name")), _named(d)[1])[1].select("graph_id", F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), "verb"),
    f"""select a.graph_id, a.i as src, b.i as dst, a.verb from kept a join kept b on b.graph_id = a.graph_id and b.edge_id = a.edge_id + 1 where not ({BAD_TOOL.format(t='a.t').replace('verb', 'a.verb')} or (a.verb = 'EX' and b.tool <> 'unknown' and b.x not in {_in(V.PROGRAM_EXTENSIONS)}))""",
)
_put("v12_prune_named", f"kept as (select *, {TOOL} as t, {EXT.replace('target', 'tool')} as x, row_number() over (partition by graph_id order by edge_id) - 1 as i from mix_edges where edge_id % 9 > 0 and tool <> '')", ORACLES["v12_prune_named"].split(") select a.graph_id", 1)[1].join(["select a.graph_id", ""]), "mix_edges")
_add(
    "j3_lookup_with_parent", "ev_edges", lambda d: J.lookup_with_parent(d.select("edge_id", F.concat("actorID", F.when(F.col("edge_id") % 2 == 0, ".x").otherwise("")).alias("key")), "key", d.groupBy(F.col("actorID").alias("key")).agg(F.count("*").alias("value")).where("value % 2 = 0 or key = 'u1'"), "u1"),
    "select e.edge_id, e.actorID || case when e.edge_id % 2 = 0 then '.x' else '' end as key, coalesce(d.value, g.value) as value from ev_edges e left join dims d on d.key = e.actorID cross join (select value from dims where key = 'u1') g",
)
_put("j3_lookup_with_parent", "dims as (select * from (select actorID as key, count(*) as value from ev_edges group by actorID) where value % 2 = 0 or key = 'u1')", "select e.edge_id, e.actorID || case when e.edge_id % 2 = 0 then '.x' else '' end as key, coalesce(d.value, g.value) as value from ev_edges e left join dims d on d.key = e.actorID left join (select value from dims where key = 'u1') g on true", "ev_edges")

# Graph measures.
_ends = lambda d: d.select("graph_id", F.col("actorID").alias("src"), F.col("objectID").alias("dst"))
_staged = lambda d: d.select("graph_id", (F.col("edge_id") % 4 + 1).cast("int").alias("stage"), "edge_id", F.col("actorID").alias("src"), F.col("objectID").alias("dst"))
_add(
    "g14_chain_depth", "small_graphs", lambda d: B.chain_depth(_ends(d), None),
    """select a.graph_id, round(least(coalesce(m, 0) / 6, 1), 6) as chain_depth from (select distinct graph_id from small_graphs) a left join (select graph_id, avg(far) as m from (select graph_id, source, max(hop) as far from (select graph_id, source, node, min(hop) as hop from reach group by all) group by all) group by graph_id) x on x.graph_id = a.graph_id""",
)
_put("g14_chain_depth", "reach as (select distinct graph_id, actorID as source, actorID as node, 0 as hop from small_graphs s where not exists (select 1 from small_graphs t where t.graph_id = s.graph_id and t.objectID = s.actorID) union select r.graph_id, r.source, e.objectID, r.hop + 1 from reach r join small_graphs e on e.graph_id = r.graph_id and e.actorID = r.node where r.hop < 24)", ORACLES["g14_chain_depth"].split(") select a.graph_id", 1)[1].join(["select a.graph_id", ""]), "small_graphs")
_add(
    "g15_label_novelty", "small_graphs", lambda d: G.label_novelty(A.endpoints(_ends(d)).withColumnRenamed("node", "label"), A.endpoints(_ends(d.where("cast(graph_id as int) % 3 = 0"))).withColumnRenamed("node", "label")),
    f"""select graph_id, round(1 - avg(c / (a + b - c)), 6) as novelty from (select x.graph_id, y.graph_id as ref, x.a, y.a as b, (select count(*) from {NODES} p join {NODES} q on p.node = q.node where p.graph_id = x.graph_id and q.graph_id = y.graph_id) as c
      from (select graph_id, count(*) as a from {NODES} group by graph_id) x cross join (select graph_id, count(*) as a from {NODES} where cast(graph_id as int) % 3 = 0 group by graph_id order by graph_id limit 10) y) group by graph_id""",
)
_add(
    "g16_stage_hubs", "small_graphs", lambda d: G.stage_hubs(_staged(d), 2).withColumn("rank", F.col("rank").cast("bigint")),
    f"select graph_id, cast(stage as int) as stage, node, rank, score from (select *, row_number() over (partition by graph_id, stage order by score desc, node) as rank from (select graph_id, edge_id % 4 + 1 as stage, node, count(*) as score from {SM} group by all)) where rank <= 2",
)
_add(
    "g18_graph_structure", "small_graphs", lambda d: G.graph_structure(_labelled(d), _gated(d)[1].where("edge_id % 3 > 0")),
    f"""select a.graph_id, a.n_nodes, a.unique_labels, a.n_nodes - coalesce(u, 0) as isolated, coalesce(bridges, 0) as bridge_edges from (select graph_id, count(*) as n_nodes, count(distinct k % 5) as unique_labels from {NODES} group by graph_id) a
      left join (select graph_id, count(distinct node) as u from {SM} where edge_id % 3 > 0 group by graph_id) b on b.graph_id = a.graph_id left join (select graph_id, count(*) filter (edge_id % 7 = 0) as bridges from small_graphs where edge_id % 3 > 0 group by graph_id) c on c.graph_id = a.graph_id""",
)
_add("g20_tactic_coverage", "mix_edges", lambda d: G.tactic_coverage(d.where("code = 'EX'").select("graph_id", _pick("edge_id", *N.TACTICS).alias("tactic"))), "select graph_id, round(count(distinct case when edge_id % 14 in (2, 3, 4, 6, 11, 12) then edge_id % 14 end) / 6, 6) as coverage from mix_edges where code = 'EX' group by graph_id")
_add("g21_transition_quality", "scores", lambda d: G.mean_transition_quality(d.select((F.col("sample_id") % 40).alias("graph_id"), F.when(F.col("sample_id") % 3 > 0, F.col("prob_after")).alias("score"))), "select sample_id % 40 as graph_id, round(coalesce(avg(case when sample_id % 3 > 0 then prob_after end), 0.5), 6) as value from scores group by 1")
_add("g21_stage_validity", "scores", lambda d: G.stage_validity_ratio(d.select((F.col("sample_id") % 40).alias("graph_id"), (F.col("prob_after") > 0.3).alias("valid"))), "select sample_id % 40 as graph_id, round(coalesce(avg(cast(prob_after > 0.3 as int)), 0.5), 6) as value from scores group by 1")
_parts = lambda d: d.select("sample_id", *((F.col("sample_id") * k % 101 / 100).alias(c) for k, c in ((3, "coverage"), (5, "connectivity"), (7, "validity"), (11, "novelty"), (13, "depth"), (17, "transition"), (19, "stage_validity"))))
PART = "(sample_id * {} % 101 / 100)"
_add(
    "g22_quality_score", "scores", lambda d: G.graph_quality_score(_parts(d)).select("sample_id", *(F.round(F.col(c) + 1e-9, 4).alias(c) for c in ("total", "macro", "micro"))),
    f"""select sample_id, round(round(.25 * {PART.format(3)} + .2 * {PART.format(5)} + .25 * {PART.format(7)} + .05 * {PART.format(11)} + .1 * {PART.format(13)} + .1 * {PART.format(17)} + .05 * {PART.format(19)}, 6) + 1e-9, 4) as total,
      round(round(.45 * {PART.format(3)} + .35 * {PART.format(17)} + .15 * {PART.format(11)} + .05 * {PART.format(19)}, 6) + 1e-9, 4) as macro, round(round(.35 * {PART.format(7)} + .25 * {PART.format(5)} + .2 * {PART.format(13)} + .2 * {PART.format(19)}, 6) + 1e-9, 4) as micro from scores""",
)
_add("g13_validity_share", "mix_edges", lambda d: G.mask_validity(V.check_action_mask(d.select("graph_id", "edge_id", F.col("src_kind").alias("src_type"), F.col("dst_kind").alias("dst_type"), F.col("target").alias("dst_label"), "code"))), f"select graph_id, round(avg(case when {LEGAL} then 1 else 0 end), 6) as validity from mix_edges group by graph_id")
_roles = lambda: F.concat(F.col("objectID"), _pick("edge_id", "", "__p0_x", "__fin1", "__fh2", "__exec", "__p1_"))
_add(
    "p14_node_role", "ev_edges", lambda d: G.node_role(d.select("edge_id", _roles().alias("node"), (F.col("edge_id") % 11 == 0).alias("is_bridge"), (F.col("edge_id") % 13 == 0).alias("is_hub"))).select("edge_id", "role"),
    f"select edge_id, case when edge_id % 11 = 0 then 'bridge' when edge_id % 13 = 0 then 'hub' else {_cases('edge_id', *map(repr, ('internal', 'hub', 'input_artifact', 'output_artifact', 'executable_artifact', 'internal')))} end as role from ev_edges",
)
_add(
    "p14_sampled_role", "small_graphs", lambda d: G.node_role(_labelled(d).select("graph_id", "node", "type"), _ends(d)),
    f"""select graph_id, node, type, case when r = 1 then 'hub' when type = 'process' then 'internal' when outs = 0 then 'input' else 'output' end as role from (select *, row_number() over (partition by graph_id order by outs desc, node) as r from
      (select n.graph_id, n.node, case n.k % 3 when 0 then 'process' when 1 then 'file' else 'socket' end as type, count(e.edge_id) as outs from {NODES} n left join small_graphs e on e.graph_id = n.graph_id and e.actorID = n.node group by all))""",
)

# Reduction.
_numbered = lambda d: d.select("graph_id", (F.col("edge_id") % 4 + 1).cast("int").alias("stage"), "edge_id", F.substring("actorID", 2, 9).cast("int").alias("src"), F.substring("objectID", 2, 9).cast("int").alias("dst"))


def _pruned(d: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    edges = _numbered(d)
    nodes = A.endpoints(edges).distinct().withColumnRenamed("node", "node_idx")
    return nodes, edges, *B.prune_graph(nodes, edges, target=20, hops=1)


_add("a6_prune_graph", "small_graphs", lambda d: _pruned(d)[4])
_add("a6_pruned_edges", "small_graphs", lambda d: _pruned(d)[3])
_add("a8_retention", "small_graphs", lambda d: (lambda n, e, kn, ke, _: B.retention_report(n, e, kn, ke))(*_pruned(d)))
PRUNED = f"""{RANKS}, sg as (select graph_id, cast(edge_id % 4 + 1 as int) as stage, edge_id, cast(substr(actorID, 2) as int) as src, cast(substr(objectID, 2) as int) as dst from small_graphs),
  se as (select graph_id, stage, edge_id, src as node from sg union all select graph_id, stage, edge_id, dst from sg), dg as (select *, count(*) over (partition by graph_id) as n from (select graph_id, node, count(*) as d, count(distinct stage) as s from se group by all)),
  imp as (select g.graph_id, g.node, g.d, g.n, round(0.4 * r.rank * g.n + 0.3 * round(case when g.n > 1 then g.d / (g.n - 1) else 1.0 end, 6) + 0.3 * (g.s / greatest(max(g.s) over (partition by g.graph_id), 1)) + 1e-9, 6) as imp from dg g join r20 r on r.graph_id = g.graph_id and cast(substr(r.node, 2) as int) = g.node),
  big as (select * from imp where n > 20), st as (select b.*, row_number() over (partition by graph_id order by imp desc, node) as r, count(*) over (partition by graph_id) as k from big b where exists (select 1 from se where se.graph_id = b.graph_id and se.node = b.node and se.stage = 1)),
  chosen as (select graph_id, node, imp from (select *, row_number() over (partition by graph_id order by imp desc, node) as r from big) where r <= 20 union select graph_id, node, imp from st where r <= greatest(1, floor(k * 0.6))),
  hubs as (select graph_id, node from (select *, row_number() over (partition by graph_id order by d desc, node) as r from big) where r <= 2),
  near as (select graph_id, node from hubs union select h.graph_id, e.dst from hubs h join sg e on e.graph_id = h.graph_id and e.src = h.node union select h.graph_id, e.src from hubs h join sg e on e.graph_id = h.graph_id and e.dst = h.node),
  more as (select b.graph_id, b.node, b.imp, row_number() over (partition by b.graph_id order by imp desc, node) as r from big b where exists (select 1 from near where near.graph_id = b.graph_id and near.node = b.node) and not exists (select 1 from chosen c where c.graph_id = b.graph_id and c.node = b.node)),
  kept as (select graph_id, node from (select *, row_number() over (partition by graph_id order by imp desc, node) as r from (select * from chosen union all select m.graph_id, m.node, m.imp from more m join (select graph_id, count(*) as c from chosen group by graph_id) x on x.graph_id = m.graph_id where m.r <= least(10, 30 - x.c))) where r <= 30),
  map as (select graph_id, node as old_idx, cast(row_number() over (partition by graph_id order by node) - 1 as int) as new_idx from (select graph_id, node from imp where n <= 20 union all select * from kept)),
  cut as (select e.graph_id, e.stage, e.edge_id, a.new_idx as src, b.new_idx as dst from sg e join map a on a.graph_id = e.graph_id and a.old_idx = e.src join map b on b.graph_id = e.graph_id and b.old_idx = e.dst)"""
_put("a6_prune_graph", PRUNED, "select * from map", "small_graphs")
_put("a6_pruned_edges", PRUNED, "select * from cut", "small_graphs")
_put(
    "a8_retention", PRUNED,
    """select b.graph_id, b.stage, b.n as before, coalesce(a.n, 0) as after, round(coalesce(a.n, 0) / b.n, 6) as retention from
    (select graph_id, 'nodes' as stage, count(*) as n from imp group by all union all select graph_id, 'edges', count(*) from sg group by all union all select graph_id, cast(stage as varchar), count(*) from sg group by all) b left join
    (select graph_id, 'nodes' as stage, count(*) as n from map group by all union all select graph_id, 'edges', count(*) from cut group by all union all select graph_id, cast(stage as varchar), count(*) from cut group by all) a on a.graph_id = b.graph_id and a.stage = b.stage""",
    "small_graphs",
)
_first = lambda d: _ends(d).groupBy("graph_id").agg(F.min("src").alias("node"))
_add("a10_bfs_order", "small_graphs", lambda d: B.bfs_order(_ends(d), _first(d)))
_add("a9_remap_ids", "small_graphs", lambda d: V.remap_ids(_numbered(d), A.endpoints(_numbered(d)).distinct().where("node % 7 > 0").select("graph_id", F.col("node").alias("old_idx"), (F.col("node") * 10).alias("new_idx"))).select("graph_id", "edge_id", "src", "dst"), "select graph_id, edge_id, cast(substr(actorID, 2) as int) * 10 as src, cast(substr(objectID, 2) as int) * 10 as dst from small_graphs where cast(substr(actorID, 2) as int) % 7 > 0 and cast(substr(objectID, 2) as int) % 7 > 0")
# One large graph: customers, orders, parts, suppliers and nations.
_trade = lambda d: d.select("graph_id", "src", "dst")
_add(
    "a5_k_hop_trade", "trade_edges", lambda d: A.k_hop(_trade(d), d.where("stage = 4 and dst = 'n3'").select("graph_id", F.col("src").alias("node")), 2).groupBy("hop").agg(F.count("*").alias("n")),
    "select hop, count(*) as n from (select node, min(hop) as hop from (select node, 0 as hop from s0 union all select node, 1 from s1 union all select node, 2 from s2) group by node) group by hop",
)
_put("a5_k_hop_trade", "both_ways as (select distinct src as a, dst as b from trade_edges union select distinct dst, src from trade_edges), s0 as (select distinct src as node from trade_edges where stage = 4 and dst = 'n3'), s1 as (select distinct b as node from s0 join both_ways on a = node), s2 as (select distinct b as node from s1 join both_ways on a = node)", "select cast(hop as int) as hop, count(*) as n from (select node, min(hop) as hop from (select node, 0 as hop from s0 union all select node, 1 from s1 union all select node, 2 from s2) group by node) group by hop", "trade_edges")
_add("g8_components_trade", "trade_edges", lambda d: A.weak_components(_trade(d.where("stage <= 2"))).groupBy("component").agg(F.count("*").alias("n")))

# Sampling and corpora.
HEX8 = "cast('0x' || substring({}, 1, 8) as bigint)"
_add(
    "c4_types_by_quota", "small_graphs", lambda d: K.assign_types_by_quota(_ends(d)),
    f"""select graph_id, node, case when p then 'process' when row_number() over (partition by graph_id, p order by d, node) <= round_even(n * 0.07, 0) then 'socket' else 'file' end as type from (select *, row_number() over (partition by graph_id order by o desc, d desc, node) <= greatest(1, round_even(n * 0.29, 0)) as p
      from (select *, count(*) over (partition by graph_id) as n from (select graph_id, node, sum(o) as o, count(*) as d from {SM} group by all)))""",
)
_add(
    "c5_actions_by_quota", "small_graphs", lambda d: K.assign_actions_by_quota(d.select("graph_id", "edge_id", F.col("actorID").alias("src"), F.col("objectID").alias("dst")), _labelled(d)),
    f"""select graph_id, edge_id, case when r <= st then 'ST' when r <= st + st then 'RCV' when r <= 3 * st then 'EX' when r <= 3 * st + fr then 'FR' when r <= 3 * st + fr + wf then 'WF' else 'RF' end as code from (select graph_id, edge_id, round_even(e * 0.05, 0) as st, round_even(e * 0.15, 0) as fr, round_even(e * 0.32, 0) as wf,
      row_number() over (partition by graph_id order by net, {DRAW.format(k='edge_id')}, edge_id) as r from (select *, count(*) over (partition by graph_id) as e, case when cast(substr(actorID, 2) as int) % 3 = 2 or cast(substr(objectID, 2) as int) % 3 = 2 then 0 else 1 end as net from small_graphs))""",
)
_add(
    "c8_oversample_random", "scores", lambda d: C.oversample(d, how="random").select("sample_id", "label", F.col("copy").cast("bigint").alias("copy")),
    f"""select sample_id, label, 0::bigint as copy from scores union all select s.sample_id, s.label, x.slot from (select label, n, unnest(range(1, m - n + 1)) as slot from (select label, count(*) as n, max(count(*)) over () as m from scores group by label)) x
      join (select sample_id, label, row_number() over (partition by label order by sample_id) - 1 as i from scores) s on s.label = x.label and s.i = {HEX8.format("md5(concat_ws('|', '0', cast(x.label as varchar), cast(x.slot as varchar)))")} % x.n""",
)
_add("c9_boosted_weights", "scores", lambda d: C.class_weights(d, boost=1.5), "select 0 as label, 1.0::double as weight union all select 1, round(count(*) filter (label = 0) / count(*) filter (label = 1) * 1.5, 6) from scores")
_add(
    "c13_uniform_if_zero", "ev_edges", lambda d: C.sample_weighted(d.withColumn("w", F.lit(0.0)), "graph_id", "edge_id", "w", 7).select("graph_id", "edge_id"),
    f"select graph_id, edge_id from (select graph_id, edge_id, row_number() over (partition by graph_id order by round(ln(({HEX8.format(DRAW.format(k='edge_id'))} + 0.5) / 4294967296.0), 9) desc, edge_id) as r from ev_edges) where r <= 7",
)
_indexed = lambda d: A.endpoints(_ends(d)).distinct().select("graph_id", "node", F.lit(0).alias("idx"))
_add(
    "c14_negative_edges", "small_graphs", lambda d: C.sample_negative_edges(d, _indexed(d)),
    f"select e.graph_id, e.edge_id, {HEX8.format(DRAW.format(k='e.edge_id'))} % n as src_idx, cast('0x' || substring({DRAW.format(k='e.edge_id')}, 9, 8) as bigint) % n as dst_idx from small_graphs e join (select graph_id, count(*) as n from {NODES} group by graph_id) c on c.graph_id = e.graph_id",
)
_add(
    "c17_corpus_stats", "ev_edges", lambda d: C.corpus_dedup_stats(d.select(F.concat("actorID", "action").alias("canon"), (F.col("object") == "file").alias("valid")), d.where("edge_id % 5 = 0").select(F.concat("actorID", "action").alias("canon"))),
    """select round(count(distinct actorID || action) / count(*), 6) as unique_rate, round(count(*) filter (object = 'file') / count(*), 6) as valid_rate,
      round(1 - (select count(*) from (select actorID || action from ev_edges intersect select actorID || action from ev_edges where edge_id % 5 = 0)) / count(distinct actorID || action), 6) as novelty from ev_edges""",
)
_samples = lambda d: d.select("graph_id").distinct().select(F.col("graph_id").alias("sample_id"), (F.col("graph_id").cast("int") % 2).alias("label"), F.concat(F.lit("f"), (F.col("graph_id").cast("int") % 3).cast("string")).alias("apt"), F.lit("v").alias("variant_type"))


def _corpus(d: DataFrame) -> DataFrame:
    """The samples with sums over their edges; the corpus is built once for both."""
    samples, edges = K.corpus_builder(_samples(d), d.select(F.col("graph_id").alias("sample_id"), "edge_id"), "families", ["f0"])
    return samples.join(edges.groupBy("sample_id").agg(F.count("*").alias("n_edges"), F.sum(F.col("edge_id") % 1000).alias("fold")).hint("merge"), "sample_id")


_add("c16_corpus_builder", "small_graphs", _corpus)
_put(
    "c16_corpus_builder",
    f"""each as (select graph_id, count(*) as e, unnest([0.0::double, 3.0, 5.0, 7.0]) as camo_ratio, graph_id || '__camo' || cast(camo_ratio as varchar) as sample_id from small_graphs where cast(graph_id as int) % 2 = 1 and cast(graph_id as int) % 3 = 0 group by graph_id),
      pool as (select edge_id, row_number() over (order by {DRAW.format(k='edge_id')}, edge_id) - 1 as i, count(*) over () as n from small_graphs where cast(graph_id as int) % 2 = 0),
      mixed as (select sample_id, edge_id from each join small_graphs using (graph_id) union all select sample_id, p.edge_id from (select *, unnest(range(0, cast(round_even(e * camo_ratio, 0) as int))) as slot from each) s join pool p on p.i = ({HEX8.format("md5(concat_ws('|', '0', s.sample_id))")} + s.slot) % p.n)""",
    """select sample_id, graph_id as origin, 1 as label, camo_ratio, n_edges, fold from each join (select sample_id, count(*) as n_edges, cast(sum(edge_id % 1000) as bigint) as fold from mixed group by sample_id) using (sample_id)
      union all select graph_id, graph_id, 0, 0.0, count(*), cast(sum(edge_id % 1000) as bigint) from small_graphs where cast(graph_id as int) % 2 = 0 group by graph_id""",
    "small_graphs",
)
_mixable = lambda d: (d.where("label = 0").select("sample_id"), d.where("label = 1").select("sample_id"))
_add(
    "c6_mix_sources", "scores", lambda d: K.mix_sources(*_mixable(d), n=500).select("slot", "source", "sample_id"),
    f"""select s.slot, s.source, p.sample_id from (select *, row_number() over (partition by source order by slot) - 1 as k from (select slot, case when ({HEX8.format("md5(concat_ws('|', '0', cast(slot as varchar)))")} + 0.5) / 4294967296.0 < 0.3 then 'b' else 'a' end as source from (select unnest(range(1, 501)) as slot))) s
      join (select sample_id, case when label = 0 then 'a' else 'b' end as source, row_number() over (partition by label order by {DRAW.format(k='sample_id')}, sample_id) - 1 as i, count(*) over (partition by label) as n from scores) p on p.source = s.source and p.i = s.k % p.n""",
)
_add(
    "c15_reference_sample", "vectors", lambda d: K.reference_sample(d.select(F.col("grp").alias("graph_id"), F.col("id").alias("node"), "vec"), d.select(F.col("grp").alias("graph_id"), (F.col("grp") % 2).alias("label")), 3, 100).select("graph_id", "node"),
    "select grp as graph_id, id as node from vectors where grp in (select distinct grp from vectors where grp % 2 = 0 order by grp limit 3) order by md5(concat_ws('|', '0', cast(grp as varchar), cast(id as varchar))), grp, id limit 100",
)
_linked = lambda d: d.select("edge_id", F.col("actorID").alias("src"), F.col("objectID").alias("dst"))
_add("c1_sample_bfs", "ev_edges", lambda d: K.sample_bfs(_linked(d), d.select(F.col("actorID").alias("sample_id"), F.col("actorID").alias("node")).distinct(), 62, 30).select("sample_id", "edge_id", "hop"))
_add("c2_build_corpus", "ev_edges", lambda d: K.build_corpus(_linked(d), d.where("edge_id % 97 = 0").select(F.col("actorID").alias("uuid")).distinct(), 5, 2)[0].select("sample_id", "label", "seed_node"))
_add("c3_window_component", "small_graphs", lambda d: K.sample_window_component(_linked(d), d.groupBy((F.col("edge_id") % 20).alias("sample_id")).agg(F.min("edge_id").alias("_e")).select(F.concat(F.lit("w"), F.col("sample_id").cast("string")).alias("sample_id"), (F.col("_e") * 30).alias("start")), 40, 10).select("sample_id", "edge_id", "hop"))

# Evaluation and monitors.
DIV = "case when {b} > 0 then {a} / ({b}) else 0 end"
REPORT = f"(select *, {DIV.format(a='2 * p * r', b='p + r')} as f from (select class, s, round({DIV.format(a='t', b='k')}, 6) as p, round({DIV.format(a='t', b='s')}, 6) as r from (select class, sum(l) as s, sum(t) as t, sum(1 - l) as k from (select label as class, 1 as l, cast(label = pred as int) as t from {PRED} union all select pred, 0, 0 from {PRED}) group by class)))"
_add(
    "m7_class_averages", "scores", lambda d: M.class_averages(M.class_report(M.threshold_predict(d))).select("class", *(F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")), "support"),
    f"""select x.class, round(x.p, 4) as precision, round(x.r, 4) as recall, round(x.f, 4) as f1, x.s as support from (select 'accuracy' as class, a as p, a as r, a as f, s from (select sum(r * s) / sum(s) as a, cast(sum(s) as bigint) as s from {REPORT})
      union all select 'macro avg', avg(p), avg(r), avg(f), cast(sum(s) as bigint) from {REPORT} union all select 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f * s) / sum(s), cast(sum(s) as bigint) from {REPORT}) x""",
)
_add("m8_confidence_gap", "scores", M.confidence_gap, "select round(avg(prob) filter (label = 1) - avg(prob) filter (label = 0), 6) as gap from scores")
_add("m18_drift_flag", "vectors", lambda d: M.drift_flag(d.select(F.col("id").alias("dim"), (F.col("id") % 9 / 10).alias("distance")), 0.3), "select round(avg(id % 9 / 10), 6) as distance, round(avg(id % 9 / 10), 6) > 0.3 as drifted from vectors")
COS = f"round({DOT.format(a='a.vec', b='b.vec')} / (sqrt({DOT.format(a='a.vec', b='a.vec')}) * sqrt({DOT.format(a='b.vec', b='b.vec')})), 6)"
_add(
    "t5_nearest_not_excluded", "vectors", lambda d: M.nearest_in_group(d.where("id % 10 = 0"), d, 2, d.select(F.col("id"), (F.col("id") + 10).alias("candidate"))).withColumn("rank", F.col("rank").cast("bigint")),
    f"select id, candidate, sim, rank from (select *, row_number() over (partition by id order by sim desc, candidate) as rank from (select a.id, b.id as candidate, {COS} as sim from vectors a join vectors b on a.grp = b.grp and a.id <> b.id and b.id <> a.id + 10 where a.id % 10 = 0)) where rank <= 2",
)
_add("w7_best_miss_rate", "steps", lambda d: W.running_best(d).select("run_id", "step", "best_miss_rate"), "select run_id, step, min(miss_rate) over (partition by run_id order by step) as best_miss_rate from steps")
_add(
    "w8_episode_scores", "steps", lambda d: W.episode_summary(d).select("run_id", "episode", "mean_reward", F.round(F.col("detection") + 1e-9, 5).alias("detection"), "total_tp", "total_fp"),
    """select run_id, episode, round(avg(reward), 6) as mean_reward, round(round(case when sum(tp) + sum(fp) > 0 then sum(tp) / (sum(tp) + sum(fp)) else 0 end + case when sum(tp) + sum(fn) > 0 then sum(tp) / (sum(tp) + sum(fn)) else 0 end - 2 * sum(fn) + avg(reward), 6) + 1e-9, 5) as detection,
      cast(sum(tp) as bigint) as total_tp, cast(sum(fp) as bigint) as total_fp from steps group by run_id, episode""",
)
_add(
    "r5_checkpoint_record", "ev_edges", lambda d: R.pick_checkpoint_record(d.select(F.col("actorID").alias("run_id"), F.concat(F.lit("p"), F.col("edge_id").cast("string")).alias("path"), _pick("edge_id", "best", "final", "other", "other").alias("kind"))),
    "select run_id, path, kind from (select actorID as run_id, 'p' || edge_id as path, case edge_id % 4 when 0 then 'best' else 'final' end as kind, row_number() over (partition by actorID order by edge_id % 4, 'p' || edge_id) as r from ev_edges where edge_id % 4 < 2) where r = 1",
)
_centred = lambda d: L.centre_distances(d.select(F.col("grp").alias("graph_id"), F.col("id").alias("node"), "vec"))
_add(
    "m16_distance_anomaly", "vectors", lambda d: L.anomaly_ratio(_centred(d)),
    """select graph_id, round(avg(case when mad > 0 and 0.6745 * d / mad > 3.5 then 1 else 0 end), 6) as ratio from (select *, median(d) over (partition by graph_id) as mad from (select graph_id, abs(x - median(x) over (partition by graph_id)) as d from
      (select graph_id, id, round(sqrt(sum((x - m) * (x - m))), 9) as x from (select *, avg(x) over (partition by graph_id, dim) as m from (select grp as graph_id, id, unnest(range(1, len(vec) + 1)) as dim, cast(vec[dim] as double) as x from vectors)) group by graph_id, id))) group by graph_id""",
)

# Over whole tables: every name from n0 to n47 is listed for every graph, used or not.
_listed = lambda d: d.select("graph_id").distinct().select("graph_id", F.explode(F.sequence(F.lit(0), F.lit(47))).alias("node_idx"))
_add("g12_share_of_all_names", "small_graphs", lambda d: G.connected_ratio(_listed(d).select("graph_id", F.concat(F.lit("n"), F.col("node_idx").cast("string")).alias("node")), d), f"select graph_id, round(count(distinct node) / 48, 6) as connectivity from {SM} group by graph_id")
_add("v4_unused_names", "small_graphs", lambda d: V.drop_dangling_nodes(_listed(d), _numbered(d))[2], f"select graph_id, k as old_idx, cast(row_number() over (partition by graph_id order by k) - 1 as int) as new_idx from {NODES}")
_add(
    "j1_all_declarations", "small_graphs", lambda d: J.attach_node_types(_linked(d), d.select(F.col("actorID").alias("uuid"), F.concat("actor_type", F.lit("_"), "action").alias("type"), F.col("edge_id").alias("pos"))).select("edge_id", "actor_type", "object"),
    """select e.edge_id, a.t as actor_type, coalesce(b.t, 'file') as object from small_graphs e join (select actorID, arg_max(actor_type || '_' || action, edge_id) as t from small_graphs group by actorID) a on a.actorID = e.actorID
      left join (select actorID, arg_max(actor_type || '_' || action, edge_id) as t from small_graphs group by actorID) b on b.actorID = e.objectID""",
)
