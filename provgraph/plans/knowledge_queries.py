"""Registered queries of the knowledge base's operators, over techniques, actors and links made of the event table, with their SQL in files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.operators import knowledge as T
from provgraph.operators import monitor as W
from provgraph.plans.graph_queries import sql_file
from provgraph.plans.queries import ORACLES, _add


def _techniques(d: DataFrame) -> DataFrame:
    """One technique an event; lists and texts go by its number."""
    return d.selectExpr(
        "concat('T', edge_id) as tid", "concat('x', edge_id) as id", "action as name", "edge_id as pos",
        "element_at(array('Opens it with a password', 'Speaks over a Remote line', 'Runs a SCRIPT', 'Waits'), cast(edge_id % 4 as int) + 1) as description",
        "element_at(array(array('discovery', 'impact'), array('execution'), cast(array() as array<string>), cast(null as array<string>), array('Credential-Access', 'unknown')), cast(edge_id % 5 as int) + 1) as tactics",
        "element_at(array(array('Windows 10', 'Linux'), array('macOS'), cast(null as array<string>)), cast(edge_id % 3 as int) + 1) as platforms",
        "element_at(array(array('User', 'SYSTEM'), array('root'), array('user'), array('guest')), cast(edge_id % 4 as int) + 1) as permissions",
        "if(edge_id % 2 = 0, array('Availability'), null) as impact_types", "if(edge_id % 7 = 0, array('Process: commands', ''), null) as data_sources",
    )


def _links(d: DataFrame) -> DataFrame:
    return d.selectExpr("actorID as source", "objectID as target", "case action when 'read' then 'uses' when 'write' then 'related-to' else action end as kind", "edge_id as pos")


def _named(d: DataFrame) -> DataFrame:
    """Techniques behind the ends of events; some don't count, as their names start with another letter."""
    ids = d.selectExpr("actorID as id", "edge_id as pos").unionByName(d.selectExpr("objectID as id", "edge_id as pos")).groupBy("id").agg(F.min("pos").alias("pos"))
    return ids.selectExpr("id", "concat(if(id like '%7', 'S', 'T'), id) as tid", "id as name", "array('impact') as tactics", "pos")


def p10_keyword_capabilities(d: DataFrame) -> DataFrame:
    return _techniques(d).select("tid", F.array_join(T.keyword_capabilities(F.col("description"), F.transform("tactics", F.lower)), ",").alias("capabilities"))


def t1_technique_vectors(d: DataFrame) -> DataFrame:
    part = lambda first, size: F.array_join(F.transform(F.slice("vec", first, size), lambda x: x.cast("int").cast("string")), "")
    return T.technique_vectors(_techniques(d)).select("tid", part(1, 14).alias("tactics"), part(15, 9).alias("platforms"), F.get("vec", F.lit(23)).alias("privilege"), F.get("vec", F.lit(24)).alias("impact"))


def t2_technique_context(d: DataFrame) -> DataFrame:
    joined = [F.array_join(c, ",").alias(c) for c in ("tactics", "platforms", "data_sources", "capabilities")]
    return T.technique_context(_techniques(d)).select("tid", "name", *joined, "privilege", "impact", "requires_network", "requires_execution", "produces_access")


def j4_actor_techniques(d: DataFrame) -> DataFrame:
    actors = d.select("actorID").distinct().selectExpr("actorID as id", "concat('Group ', actorID) as name")
    return T.actor_techniques(_named(d), actors, _links(d))


def j5_technique_graph(d: DataFrame) -> DataFrame:
    return T.technique_graph(_named(d), _links(d))[1]


def j6_rule_instances(d: DataFrame) -> DataFrame:
    library = d.selectExpr("objectID as technique_id", "if(edge_id % 2 = 0, 'linux', 'windows') as os", "'MF' as entity_type", "concat('n', edge_id) as name")
    return T.rule_instances(d.selectExpr("action as rule", "objectID as technique_id"), library, "linux")


def w11_f1_curves(d: DataFrame) -> DataFrame:
    curves, last = W.f1_curves(d.selectExpr("concat('runs/', run_id) as run_id", "step as episode", "if(step % 3 = 0, null, round(f1, 6)) as f1"), "1")
    return curves.join(last.hint("merge"), "run_id").select("run_id", F.col("episode").cast("bigint").alias("episode"), "f1", "last_f1")


for query, views in {p10_keyword_capabilities: "ev_edges", t1_technique_vectors: "ev_edges", t2_technique_context: "ev_edges", j4_actor_techniques: "ev_edges", j5_technique_graph: "ev_edges", j6_rule_instances: "ev_edges", w11_f1_curves: "steps"}.items():
    _add(query.__name__, views, query)
    ORACLES[query.__name__] = sql_file(query.__name__, views)
