"""Filters, validation and repair of typed event edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provgraph.functions.names import clean_entity_type, fallback_name, is_executable, name_extension, normalize_tool
from provgraph.operators.features import graph_structure
from provgraph.operators.ranking import numbered

PROCESS, FILES, SOCKET = ["MP", "TP"], ["MF", "SF", "TF"], ["SO"]
ALL = PROCESS + FILES + SOCKET
# Fixed values: (source types, verb, target types) that cannot be.
FORBIDDEN = [
    *((FILES, verb, ALL) for verb in ["RD", "WR", "EX", "FR", "IJ", "ST", "CD", "UK"]),
    *((SOCKET, verb, ALL) for verb in ["WR", "EX", "IJ", "FR", "ST", "CD", "RD", "UK"]),
    (PROCESS, "FR", FILES + SOCKET),
    (ALL, "IJ", FILES + SOCKET),
    (ALL, "ST", PROCESS + FILES),
    (PROCESS + FILES, "RF", ALL),
    (ALL, "EX", SOCKET),
]
# Tools that may start others, tools that may use the network, extensions of programs.
EXECUTORS = [
    "bash", "sh", "zsh", "csh", "ksh", "tcsh", "cmd", "powershell", "pwsh", "python", "python3", "perl", "ruby", "php", "cron", "crond",
    "at", "systemd", "sudo", "su", "schtasks", "wmic", "rundll32", "regsvr32", "mshta", "cscript", "wscript", "runas", "msbuild",
    "msiexec", "wusa", "gdb",
]
NETWORK = [
    "curl", "wget", "nc", "ncat", "netcat", "socat", "bash", "sh", "zsh", "ssh", "ssh-keygen", "ftp", "sftp", "scp", "ping", "traceroute",
    "telnet", "nmap", "masscan", "python", "python3", "perl", "ruby", "php", "nikto", "dirb", "gobuster", "powershell", "pwsh",
]
PROGRAM_EXTENSIONS = [".sh", ".bash", ".exe", ".elf", ".bin", ".bat", ".cmd", ".ps1", ".pl", ".py", ".rb", ".php", ".cgi", ".jar"]
# Edge codes that may join two node types; EX needs an executable target too.
LEGAL = {"process>process": ["FR"], "process>file": ["RF", "WF"], "process>socket": ["ST"], "file>process": ["RF", "LOAD"], "socket>process": ["RCV"]}
TACTIC_EDGES = {
    "reconnaissance": ["ST", "RF", "WF"], "initial-access": ["RF", "WF", "EX", "FR"], "execution": ["FR", "EX", "WF"],
    "persistence": ["WF", "RF", "FR"], "privilege-escalation": ["EX", "FR", "IJ"], "defense-evasion": ["WF", "RF", "EX"],
    "credential-access": ["RF", "WF"], "discovery": ["RF", "WF", "ST"], "lateral-movement": ["ST", "RF", "EX", "WF"],
    "collection": ["RF", "WF"], "command-and-control": ["ST", "RCV", "RF"], "exfiltration": ["ST", "WF", "RF", "RCV"],
}


def type_rule_ok(src: Column, verb: Column, dst: Column) -> Column:
    """False for a forbidden triple of cleaned types; unknown types pass."""
    s, d = clean_entity_type(src), clean_entity_type(dst)
    broken = F.lit(False)
    for sources, v, targets in FORBIDDEN:
        broken = broken | (s.isin(sources) & (verb == v) & d.isin(targets))
    return ~F.coalesce(broken & s.isin(ALL) & d.isin(ALL), F.lit(False))


def tool_rule_ok(tool: Column, verb: Column, target: Column) -> Column:
    """False where a named tool may not use the verb, or EX has a named target without a program's extension."""
    t = normalize_tool(tool)
    named = F.coalesce(target, F.lit("")).isin("", "unknown") == F.lit(False)
    bad_start = verb.isin("FR", "IJ", "EX") & (t != "") & ~t.isin(EXECUTORS)
    bad_target = (verb == "EX") & named & ~name_extension(target).isin(PROGRAM_EXTENSIONS)
    bad_net = verb.isin("ST", "RF") & (t != "") & ~t.isin(NETWORK)
    return ~F.coalesce(bad_start | bad_target | bad_net, F.lit(False))


def filter_type_rules(edges: DataFrame, src: str = "src_type", verb: str = "verb", dst: str = "dst_type") -> DataFrame:
    return edges.where(type_rule_ok(F.col(src), F.col(verb), F.col(dst)))


def filter_tool_rules(edges: DataFrame, tool: str = "tool", verb: str = "verb", target: str = "target") -> DataFrame:
    return edges.where(tool_rule_ok(F.col(tool), F.col(verb), F.col(target)))


def graph_validity(edges: DataFrame, threshold: float = 0.30) -> DataFrame:
    """(graph_id, total, removed, remaining, rate, graph_valid) under the type rules."""
    ok = type_rule_ok(F.col("src_type"), F.col("verb"), F.col("dst_type"))
    counted = edges.groupBy("graph_id").agg(F.count("*").alias("total"), F.count_if(~ok).alias("removed"))
    rate = F.col("removed") / F.col("total")
    return counted.select("graph_id", "total", "removed", (F.col("total") - F.col("removed")).alias("remaining"), F.round(rate, 6).alias("rate"), (rate <= threshold).alias("graph_valid"))


def violation_counts(edges: DataFrame) -> DataFrame:
    """(graph_id, src_type, verb, dst_type, n) of edges that the type rules remove, by cleaned types."""
    bad = edges.where(~type_rule_ok(F.col("src_type"), F.col("verb"), F.col("dst_type")))
    return bad.groupBy("graph_id", clean_entity_type(F.col("src_type")).alias("src_type"), "verb", clean_entity_type(F.col("dst_type")).alias("dst_type")).agg(F.count("*").alias("n"))


def drop_dangling_nodes(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and map (graph_id, old_idx, new_idx): nodes in no edge go, the rest is numbered again from 0 in the old order.

    Columns: nodes (graph_id, node_idx, ...), edges (graph_id, src, dst, ...).
    """
    ends = edges.select("graph_id", F.col("src").alias("node_idx")).unionByName(edges.select("graph_id", F.col("dst").alias("node_idx"))).distinct()
    used = nodes.join(ends, ["graph_id", "node_idx"], "left_semi")
    again = numbered(used, ["node_idx"], ["graph_id"], "_i").withColumn("new_idx", F.col("_i").cast("int")).drop("_i")
    mapping = again.select("graph_id", F.col("node_idx").alias("old_idx"), "new_idx")
    return again.drop("node_idx").withColumnRenamed("new_idx", "node_idx"), remap_ids(edges, mapping), mapping


def remap_ids(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with both ends rewritten by (graph_id, old_idx, new_idx); edges with an end that isn't in the map go."""
    end = lambda c: mapping.select("graph_id", F.col("old_idx").alias(c), F.col("new_idx").alias(f"_{c}"))
    joined = edges.join(end("src"), ["graph_id", "src"]).join(end("dst"), ["graph_id", "dst"])
    return joined.withColumns({"src": F.col("_src"), "dst": F.col("_dst")}).select(edges.columns)


def legal_codes(src_type: Column, dst_type: Column, dst_label: Column) -> Column:
    """The edge codes that the mask allows, none for other pairs."""
    pair = F.concat_ws(">", F.lower(src_type), F.lower(dst_type))
    found = F.array().cast("array<string>")
    for key, codes in LEGAL.items():
        listed = F.array(*map(F.lit, codes))
        found = F.when(pair == key, F.array_union(listed, F.when(is_executable(dst_label), F.array(F.lit("EX"))).otherwise(F.array().cast("array<string>"))) if key == "process>file" else listed).otherwise(found)
    return found


def check_action_mask(edges: DataFrame) -> DataFrame:
    """Edges (src_type, dst_type, dst_label, code) and ``legal``."""
    return edges.withColumn("legal", F.array_contains(legal_codes(F.col("src_type"), F.col("dst_type"), F.col("dst_label")), F.col("code")))


def repair_edges(edges: DataFrame, seed: int = 0) -> DataFrame:
    """Edges with ``old_code``, ``code`` and ``reason``: an illegal code becomes the legal one of least md5, or null where none is legal."""
    codes = legal_codes(F.col("src_type"), F.col("dst_type"), F.col("dst_label"))
    least = F.array_min(F.transform(codes, lambda c: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("edge_id").cast("string"), c)).alias("h"), c.alias("c"))))["c"]
    legal = F.array_contains(codes, F.col("code"))
    reason = F.when(legal, "kept").when(F.size(codes) > 0, "replaced").otherwise("removed")
    return edges.select("graph_id", "edge_id", F.col("code").alias("old_code"), F.when(legal, F.col("code")).otherwise(least).alias("code"), reason.alias("reason"))


def semantic_violations(edges: DataFrame) -> DataFrame:
    """(graph_id, edge_id, kind): one row a problem, several an edge."""
    s, d, code = F.lower("src_type"), F.lower("dst_type"), F.col("code")
    bridge = F.coalesce(F.col("is_bridge"), F.lit(False))
    legal = F.array_contains(legal_codes(s, d, F.col("dst_label")), code)
    kinds = [
        F.when(~legal, "mask"),
        F.when((code == "FR") & (s == "process") & (d == "file"), "fork_to_file"),
        F.when((code == "EX") & ~is_executable(F.col("dst_label")), "execute_non_executable"),
        F.when((s == "process") & (d == "process") & (code != "FR") & ~bridge, "process_to_process"),
        F.when((code == "LATERAL_MOVE") & (s == "process") & (d == "process"), "lateral_move"),
        F.when(bridge & (s == "process") & (d == "process"), "bridge_joins_processes"),
    ]
    return edges.select("graph_id", "edge_id", F.explode(F.array_compact(F.array(*kinds))).alias("kind"))


# Tactics that need network activity, and those that need a file.
NETWORK_TACTICS = ["command-and-control", "exfiltration", "lateral-movement"]
ARTIFACT_TACTICS = ["persistence", "credential-access", "collection"]


def check_stage_semantics(stages: DataFrame) -> DataFrame:
    """Stages (graph_id, stage, tactic, edge_types, node_types) with ``issues``, codes of what a tactic lacks, and ``valid``.

    ``no_edge``: none of the tactic's edge codes; ``no_network``: a tactic over the network without socket node or network
    code; ``no_file``: a tactic that leaves artifacts without a file node. Other tactics have no issues.
    """
    tactic, codes, kinds = F.col("tactic"), F.col("edge_types"), F.col("node_types")
    any_of = lambda column, values: F.arrays_overlap(column, F.array(*map(F.lit, values)))
    wanted = F.element_at(F.create_map(*(x for name, listed in TACTIC_EDGES.items() for x in (F.lit(name), F.array(*map(F.lit, listed))))), tactic)
    rules = [
        ("no_edge", wanted.isNotNull() & ~F.arrays_overlap(codes, wanted)),
        ("no_network", tactic.isin(NETWORK_TACTICS) & ~any_of(kinds, ["socket"]) & ~any_of(codes, ["ST", "RCV"])),
        ("no_file", tactic.isin(ARTIFACT_TACTICS) & ~any_of(kinds, ["file"])),
    ]
    issues = F.array_compact(F.array(*(F.when(broken, name) for name, broken in rules)))
    return stages.withColumn("issues", issues).withColumn("valid", F.size("issues") == 0)


def validate_graphs(nodes: DataFrame, edges: DataFrame, threshold: float = 0.30) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kept edges, stats (as ``graph_validity``, a graph a row) and violations (graph_id, kind, n).

    Nodes are (graph_id, node_idx, type), edges (graph_id, src, verb, dst, ...) over all stages. An edge to an index that isn't
    listed is removed as ``out_of_bounds``, another that breaks a type rule under its ``SRC-VERB->DST``. A node listed twice
    counts with the least of its types.
    """
    types = nodes.groupBy("graph_id", "node_idx").agg(F.min("type").alias("type"))
    end = lambda c: types.select("graph_id", F.col("node_idx").alias(c), F.col("type").alias(f"_{c}")).hint("merge")
    typed = edges.join(end("src"), ["graph_id", "src"], "left").join(end("dst"), ["graph_id", "dst"], "left")
    lost = F.col("_src").isNull() | F.col("_dst").isNull()
    triple = F.concat(clean_entity_type(F.col("_src")), F.lit("-"), "verb", F.lit("->"), clean_entity_type(F.col("_dst")))
    marked = typed.withColumn("_kind", F.when(lost, "out_of_bounds").when(~type_rule_ok(F.col("_src"), F.col("verb"), F.col("_dst")), triple))
    counted = marked.groupBy("graph_id").agg(F.count("*").alias("total"), F.count("_kind").alias("removed"))
    rate = F.col("removed") / F.col("total")
    stats = counted.select("graph_id", "total", "removed", (F.col("total") - F.col("removed")).alias("remaining"), F.round(rate, 6).alias("rate"), (rate <= threshold).alias("graph_valid"))
    violations = marked.where("_kind is not null").groupBy("graph_id", F.col("_kind").alias("kind")).agg(F.count("*").alias("n"))
    return marked.where("_kind is null").select(edges.columns), stats, violations


def quality_gate(nodes: DataFrame, edges: DataFrame, chain: DataFrame) -> DataFrame:
    """(graph_id, issues, ok) of nodes (graph_id, node, label, type), edges (graph_id, edge_id, src, dst, code, is_bridge) and chain (graph_id, tactic).

    Issues: ``few_tactics`` (under 3), ``repeated_labels`` (distinct labels under half the nodes), ``writes_dominate`` (WF over
    half the edges), ``isolated_nodes``, ``semantic`` (any row of ``semantic_violations``). A graph without nodes has no row.
    """
    structure = graph_structure(nodes, edges)
    tactics = chain.groupBy("graph_id").agg(F.count_distinct("tactic").alias("_t"))
    codes = edges.groupBy("graph_id").agg(F.count("*").alias("_e"), F.count_if(F.col("code") == "WF").alias("_w"))
    end = lambda c, *cols: nodes.select("graph_id", F.col("node").alias(c), *cols).hint("merge")
    typed = edges.join(end("src", F.col("type").alias("src_type")), ["graph_id", "src"]).join(end("dst", F.col("type").alias("dst_type"), F.col("label").alias("dst_label")), ["graph_id", "dst"])
    broken = semantic_violations(typed).groupBy("graph_id").agg(F.count("*").alias("_v"))
    joined = structure
    for part in (tactics, codes, broken):
        joined = joined.join(part.hint("merge"), "graph_id", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    rules = [
        ("few_tactics", n("_t") < 3), ("repeated_labels", F.col("unique_labels") < 0.5 * F.col("n_nodes")), ("writes_dominate", n("_w") > 0.5 * n("_e")),
        ("isolated_nodes", F.col("isolated") > 0), ("semantic", n("_v") > 0),
    ]
    issues = F.array_compact(F.array(*(F.when(bad, name) for name, bad in rules)))
    return joined.select("graph_id", issues.alias("issues"), (F.size(issues) == 0).alias("ok"))


def node_name_consistent(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (graph_id, node, type, name) with ``ok`` and the name to use: it must pass the tool rules with the verb of every edge out (target unknown) and, as target of an unknown tool, of every edge in; else the type's default name.

    Verbs are counted once a node. A node without a name is left alone: its name stays null and ok is true.
    """
    verbs = edges.select("graph_id", F.col("src").alias("node"), "verb", F.lit(True).alias("_out")).unionByName(edges.select("graph_id", F.col("dst").alias("node"), "verb", F.lit(False).alias("_out"))).distinct()
    joined = nodes.select("graph_id", "node", "name").join(verbs.hint("merge"), ["graph_id", "node"])
    fits = F.when(F.col("_out"), tool_rule_ok(F.col("name"), F.col("verb"), F.lit("unknown"))).otherwise(tool_rule_ok(F.lit("unknown"), F.col("verb"), F.col("name")))
    bad = joined.where(F.col("name").isNotNull() & ~fits).select("graph_id", "node").distinct().withColumn("_bad", F.lit(True))
    marked = nodes.join(bad.hint("merge"), ["graph_id", "node"], "left")
    return marked.withColumns({"ok": F.col("_bad").isNull(), "name": F.when(F.col("_bad").isNull(), F.col("name")).otherwise(fallback_name(F.col("type")))}).select(*nodes.columns, "ok")


def prune_named_edges(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (graph_id, node_idx, name, ...) with a name, numbered again in the old order, and the edges (graph_id, src, dst, verb, ...) between them whose names pass the tool rules."""
    named = nodes.where("name is not null and name != ''")
    kept = numbered(named, ["node_idx"], ["graph_id"], "_new")
    mapping = kept.select("graph_id", F.col("node_idx").alias("old_idx"), F.col("_new").cast("int").alias("new_idx"), "name")
    end = lambda c: mapping.select("graph_id", F.col("old_idx").alias(c), F.col("new_idx").alias(f"_{c}"), F.col("name").alias(f"_{c}_name")).hint("merge")
    both = edges.join(end("src"), ["graph_id", "src"]).join(end("dst"), ["graph_id", "dst"])
    fine = both.where(tool_rule_ok(F.col("_src_name"), F.col("verb"), F.col("_dst_name"))).withColumns({"src": F.col("_src"), "dst": F.col("_dst")})
    return kept.withColumn("node_idx", F.col("_new").cast("int")).select(nodes.columns), fine.select(edges.columns)


def filter_allowed_triples(edges: DataFrame, allowed: DataFrame) -> DataFrame:
    """Edges whose (src_type, verb, dst_type) is in the table."""
    return edges.join(allowed.select("src_type", "verb", "dst_type"), ["src_type", "verb", "dst_type"], "left_semi")
