"""All registered queries of the event-graph operators and their SQL."""

from provgraph.plans import chain_queries, graph_queries, knowledge_queries, more_queries, round_trips  # noqa: F401  they add their queries to the same tables
from provgraph.plans.queries import ORACLES, QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
