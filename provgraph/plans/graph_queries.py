"""Registered queries of measures on graphs of any size, with their SQL in files of their own names."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame

from provgraph.operators import chains as T
from provgraph.operators import depth as H
from provgraph.operators import reduce as B
from provgraph.plans.queries import ORACLES, _add
from provgraph.plans.views import with_views


def sql_file(name: str, *views: str) -> str:
    """The SQL of ``sql/name.sql`` behind the views that it names; it starts with further tables, each after a comma."""
    text = (Path(__file__).parent / "sql" / f"{name}.sql").read_text(encoding="utf-8").rstrip()
    return with_views("", *views).rstrip() + text


def ends(d: DataFrame) -> DataFrame:
    return d.selectExpr("graph_id", "actorID as src", "objectID as dst")


_add("g10_causal_depth", "small_graphs", lambda d: H.causal_depth(ends(d)))
_add("g11_articulation_count", "small_graphs", lambda d: H.articulation_count(ends(d)))
_add("g10_depth_trade", "trade_edges", H.causal_depth)
_add("g14_chain_depth_trade", "trade_edges", lambda d: B.chain_depth(d, None))
_add("g11_articulation_trade", "trade_edges", H.articulation_count)
ORACLES["g10_causal_depth"] = sql_file("g10_causal_depth", "small_graphs")
ORACLES["g11_articulation_count"] = sql_file("g11_articulation_count", "small_graphs")
ORACLES["g14_chain_depth_trade"] = sql_file("g14_chain_depth_trade", "trade_edges")
ORACLES["g10_depth_trade"] = sql_file("g10_depth_trade", "trade_edges")

#: Three tactics by number, and chains of up to three items out of every fifty.
_TACTIC = "element_at(array('execution', 'persistence', 'exfiltration'), cast(id % 3 as int) + 1) as tactic"
_add(
    "t9_fill_missing_tactics", "vectors",
    lambda d: T.fill_missing_tactics(d.where("id % 50 < 3 and id % 7 < 5").selectExpr("cast(floor(id / 50) as bigint) as chain_id", "cast(id % 50 as bigint) as pos", "id as item", _TACTIC, "vec"), d.selectExpr("id as item", _TACTIC, "vec"), ["exfiltration", "execution", "persistence"], 4).drop("vec"),
)
ORACLES["t9_fill_missing_tactics"] = sql_file("t9_fill_missing_tactics", "vectors")
