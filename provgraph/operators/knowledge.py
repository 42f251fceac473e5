"""Knowledge-base analytics: techniques as vectors and contexts, who uses them, how they hang together, names for rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provgraph.functions.names import TACTICS, normalize_platform, privilege_score

# Platforms of the vector, what each tactic needs or gives, and the words that add a capability.
PLATFORMS = ["windows", "linux", "macos", "network", "containers", "iaas", "saas", "office-365", "azure-ad"]
CAPABILITIES = {
    "reconnaissance": ["discovery", "network"], "resource-development": ["file", "payload"], "initial-access": ["execution", "file", "network"],
    "execution": ["execution", "file", "process"], "persistence": ["file", "persistence", "process"], "privilege-escalation": ["execution", "privilege", "process"],
    "defense-evasion": ["file", "stealth"], "credential-access": ["credential", "file"], "discovery": ["discovery", "file", "network"],
    "lateral-movement": ["credential", "execution", "network"], "collection": ["collection", "file"], "command-and-control": ["c2", "network"],
    "exfiltration": ["exfiltration", "file", "network"], "impact": ["file", "impact"],
}
KEYWORDS = {
    "network": ["network", "remote", "c2", "command and control"], "credential": ["credential", "password", "token", "hash"],
    "file": ["file", "directory", "registry", "script"], "execution": ["execute", "execution", "process", "command"],
}
LINKS = ["uses", "subtechnique-of", "related-to"]
STRINGS = "array<string>"


def _list(column: Column) -> Column:
    return F.coalesce(column, F.array().cast(STRINGS))


def _lower(column: Column) -> Column:
    return F.transform(_list(column), F.lower)


def keyword_capabilities(text: Column, tactics: Column) -> Column:
    """Sorted capabilities: those of the tactics, and those whose words the lower-cased text holds. Nulls have none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    named = [F.when(F.coalesce(low.rlike("|".join(words)), F.lit(False)), F.lit(cap)) for cap, words in KEYWORDS.items()]
    table = F.create_map(*(x for tactic, caps in CAPABILITIES.items() for x in (F.lit(tactic), F.array(*map(F.lit, caps)))))
    of_tactics = F.flatten(F.transform(_list(tactics), lambda t: _list(F.element_at(table, t))))
    return F.array_sort(F.array_distinct(F.concat(of_tactics, F.array_compact(F.array(*named)).cast(STRINGS))))


def technique_vectors(techniques: DataFrame) -> DataFrame:
    """(tid, vec array[25]): tactics 14, platforms by substring 9, privilege, impact."""
    tactics, platforms = _lower(F.col("tactics")), _lower(F.col("platforms"))
    hot = lambda yes: F.when(yes, 1.0).otherwise(0.0)
    parts = [hot(F.array_contains(tactics, t)) for t in TACTICS]
    parts += [hot(F.contains(F.array_join(platforms, "\n"), F.lit(p))) for p in PLATFORMS]
    impact = hot(F.size(_list(F.col("impact_types"))) > 0)
    return techniques.select("tid", F.array(*parts, privilege_score(F.col("permissions")), impact).alias("vec"))


def vectors_of(ids: DataFrame, techniques: DataFrame) -> DataFrame:
    """(tid, vec) of the listed ids; an unknown one is all zeros."""
    known = ids.select("tid").distinct().join(technique_vectors(techniques).hint("merge"), "tid", "left")
    return known.select("tid", F.coalesce("vec", F.array_repeat(F.lit(0.0), 25)).alias("vec"))


def technique_context(techniques: DataFrame) -> DataFrame:
    """(tid, name, tactics, platforms, privilege, impact, data_sources, capabilities, requires_network, requires_execution, produces_access)."""
    tactics = F.filter(_lower(F.col("tactics")), lambda t: t != "")
    distinct = lambda xs: F.array_sort(F.array_distinct(F.filter(xs, lambda x: x.isNotNull() & (x != ""))))
    sources = distinct(_lower(F.col("data_sources")))
    text = F.concat_ws(" ", "name", "description", F.array_join(sources, " "))
    base = techniques.select(
        "tid", F.coalesce("name", "tid").alias("name"), tactics.alias("tactics"), distinct(F.transform(_list(F.col("platforms")), normalize_platform)).alias("platforms"),
        privilege_score(F.col("permissions")).alias("privilege"), (F.size(_list(F.col("impact_types"))) > 0).alias("impact"), sources.alias("data_sources"), keyword_capabilities(text, tactics).alias("capabilities"),
    )
    has = lambda *caps: F.arrays_overlap("capabilities", F.array(*map(F.lit, caps)))
    return base.withColumns({"requires_network": has("network"), "requires_execution": has("execution"), "produces_access": has("credential", "persistence", "privilege")})


def actor_techniques(techniques: DataFrame, actors: DataFrame, relationships: DataFrame) -> DataFrame:
    """(actor, tid, pos): who uses what, repeats kept, in the order of the relationships. Tables as ``read_attack_kb`` gives them."""
    uses = relationships.where("kind = 'uses'")
    named = uses.join(actors.select(F.col("id").alias("source"), F.col("name").alias("actor")).hint("merge"), "source")
    return named.join(techniques.select(F.col("id").alias("target"), "tid").hint("merge"), "target").select("actor", "tid", "pos")


def technique_graph(techniques: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (tid, name, tactics) and edges (src, dst, kind): techniques whose id starts with T; of several links between two, and of several records of one id, the last counts."""
    known = techniques.where(F.startswith("tid", F.lit("T")))
    nodes = known.groupBy("tid").agg(F.max_by(F.struct("name", "tactics"), "pos").alias("_x")).select("tid", "_x.*")
    end = lambda c, to: known.select(F.col("id").alias(c), F.col("tid").alias(to)).hint("merge")
    links = relationships.where(F.col("kind").isin(LINKS)).join(end("source", "src"), "source").join(end("target", "dst"), "target")
    return nodes, links.groupBy("src", "dst").agg(F.max_by("kind", "pos").alias("kind"))


def rule_instances(rules: DataFrame, library: DataFrame, os: str) -> DataFrame:
    """(rule, entity_type, name): the names that a rule's techniques (rule, technique_id) have in the library for one system."""
    own = library.where(F.col("os") == os).select("technique_id", "entity_type", "name")
    return rules.select("rule", "technique_id").distinct().join(own.hint("merge"), "technique_id").select("rule", "entity_type", "name")
