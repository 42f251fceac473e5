"""Scalar functions on names, types and actions; native columns throughout."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Audit event names and the action each stands for.
EVENT_ACTION = {
    "EVENT_WRITE": "write", "EVENT_WRITE_SOCKET_PARAMS": "write", "EVENT_SENDMSG": "send", "EVENT_READ": "read",
    "EVENT_READ_SOCKET_PARAMS": "read", "EVENT_RECVMSG": "read", "EVENT_RECVFROM": "read", "EVENT_SENDTO": "send",
    "EVENT_CONNECT": "send", "EVENT_EXECUTE": "execute", "EVENT_FORK": "clone", "EVENT_CLONE": "clone", "EVENT_MMAP": "mmap",
    "EVENT_MPROTECT": "mmap", "EVENT_LOADLIBRARY": "load", "EVENT_OPEN": "read", "EVENT_CLOSE": "read",
    "EVENT_MODIFY_FILE_ATTRIBUTES": "write", "EVENT_RENAME": "write", "EVENT_UNLINK": "write", "EVENT_CREATE_OBJECT": "write",
    "EVENT_ACCEPT": "send", "EVENT_BIND": "send",
}
# Risks, codes, default names, extensions of programs, tactics and what joins two of them.
ACTION_RISK = {"execute": 1.0, "mmap": 0.8, "write": 0.6, "read": 0.2, "clone": 0.9}
OTHER_RISK = 0.1
NODE_CODE = {"process": "MP", "file": "MF", "socket": "SO"}
EDGE_CODE = {"FR": "EX", "WF": "WR", "RF": "RD", "RCV": "RF", "LOAD": "RD"}
DEFAULT_NAME = {"MP": "unknown_process", "TP": "unknown_tool", "MF": "unknown_malware.bin", "SF": "unknown_sysfile", "TF": "unknown_tempfile.tmp", "SO": "0.0.0.0:0"}
EXECUTABLE_LABELS = [".sh", ".py", ".pl", ".rb", ".elf", ".bin", ".so", ".php", ".js", ".jar", ".class", ".service", ".bash", ".exe", ".dll", ".bat", ".ps1", ".cmd"]
TACTICS = [
    "reconnaissance", "resource-development", "initial-access", "execution", "persistence", "privilege-escalation", "defense-evasion",
    "credential-access", "discovery", "lateral-movement", "collection", "command-and-control", "exfiltration", "impact",
]
BRIDGES = {
    "initial-access>execution": "file", "execution>persistence": "file", "execution>privilege-escalation": "file",
    "credential-access>exfiltration": "socket", "collection>exfiltration": "socket", "discovery>command-and-control": "socket",
    "lateral-movement>command-and-control": "socket",
}


def lookup(key: Column, table: Mapping[str, object], default: object = None) -> Column:
    """The value of a small fixed table, else ``default``."""
    pairs = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    found = F.element_at(pairs, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def map_event_action(event: Column) -> Column:
    """An audit event name's action; null for a name that is to be dropped."""
    return lookup(event, EVENT_ACTION)


def object_type(kind: Column) -> Column:
    """socket for a kind that names a network flow, else file."""
    return F.when(F.contains(kind, F.lit("NetFlow")), "socket").otherwise("file")


def ref_uuid(reference: Column) -> Column:
    """The id of a reference in JSON: a plain string, or an object whose first string value is the id; null if it has none."""
    values = F.map_values(F.from_json(reference, "map<string,variant>"))
    inner = F.get(F.filter(values, lambda v: F.schema_of_variant(v) == "STRING"), F.lit(0)).cast("string")
    plain = F.nullif(F.regexp_replace(reference, '^"|"$', ""), F.lit(""))
    return F.when(F.startswith(F.ltrim(reference), F.lit("{")), inner).otherwise(plain)


def clean_entity_type(raw: Column) -> Column:
    """A type code without index prefix, instance suffix and hub marks: ``11_TP*-x`` is ``TP``."""
    bare = F.regexp_replace(F.trim(raw), r"^\d+_(?=.)", "")
    return F.trim(F.replace(F.split_part(bare, F.lit("-"), F.lit(1)), F.lit("*"), F.lit("")))


def _without_program_suffix(name: Column) -> Column:
    """Each of .exe, .bin and .sh taken off once, in this order."""
    for suffix in (r"(?i)\.exe$", r"(?i)\.bin$", r"(?i)\.sh$"):
        name = F.regexp_replace(name, suffix, "")
    return name


def normalize_tool(name: Column) -> Column:
    """The tool in an instance name: what follows the last dash unless that is empty or a number, else the path's base name."""
    whole = F.trim(F.coalesce(name, F.lit("")))
    last = F.trim(F.lower(F.element_at(F.split(whole, "-"), -1)))
    numeric = F.replace(last, F.lit("."), F.lit("")).rlike(r"^\d+$")
    base = F.regexp_replace(F.element_at(F.split(F.replace(whole, F.lit("\\"), F.lit("/")), "/"), -1), r"\*+$", "")
    by_dash = F.contains(whole, F.lit("-")) & (last != "") & ~numeric
    return F.when(by_dash, _without_program_suffix(last)).otherwise(F.trim(F.lower(_without_program_suffix(base))))


def name_extension(name: Column) -> Column:
    """Lower-case extension with its dot; none for addresses, urls and parts without a letter."""
    whole = F.trim(F.coalesce(name, F.lit("")))
    last = F.trim(F.lower(F.element_at(F.split(whole, r"\."), -1)))
    address = F.element_at(F.split(whole, "-"), -1).rlike(r"^[\d.]+$")
    has = F.contains(whole, F.lit(".")) & last.rlike("[a-z]") & ~F.contains(whole, F.lit("://")) & ~address
    return F.when(has, F.concat(F.lit("."), last)).otherwise("")


def label_extension(label: Column) -> Column:
    whole = F.coalesce(label, F.lit(""))
    return F.when(F.contains(whole, F.lit(".")), F.concat(F.lit("."), F.lower(F.element_at(F.split(whole, r"\."), -1)))).otherwise("")


def is_executable(label: Column) -> Column:
    """Whether a label's extension is one of programs; unknown extensions are not."""
    return label_extension(label).isin(EXECUTABLE_LABELS)


def normalize_platform(raw: Column) -> Column:
    value = F.replace(F.lower(F.coalesce(raw, F.lit(""))), F.lit(" "), F.lit("-"))
    has = lambda x: F.contains(value, F.lit(x))
    return F.when(has("windows"), "windows").when(has("linux"), "linux").when(has("macos") | has("mac-os"), "macos").when(has("network"), "network").otherwise(value)


def privilege_score(needs: Column) -> Column:
    """1 for system or kernel, 0.5 for administrator or root, 0.2 for user, else 0."""
    low = F.transform(F.coalesce(needs, F.array().cast("array<string>")), F.lower)
    has = lambda *x: F.arrays_overlap(low, F.array(*map(F.lit, x)))
    return F.when(has("system", "kernel"), 1.0).when(has("administrator", "root"), 0.5).when(has("user"), 0.2).otherwise(0.0)


def fallback_name(kind: Column) -> Column:
    return lookup(clean_entity_type(kind), DEFAULT_NAME, "unknown_entity")


def action_risk(action: Column, weights: Mapping[str, float] = ACTION_RISK) -> Column:
    return lookup(F.lower(action), weights, OTHER_RISK)


def bridge_hint(src: Column, dst: Column, src_caps: Column, dst_caps: Column) -> Column:
    """The entity that joins two tactics: from the table, else a socket where either has a network capability, else a file."""
    wide = F.arrays_overlap(F.array_union(src_caps, dst_caps), F.array(*map(F.lit, ("network", "c2", "exfiltration"))))
    return F.coalesce(lookup(F.concat_ws(">", src, dst), BRIDGES), F.when(wide, "socket").otherwise("file"))


def stage_order(stage: Column) -> Column:
    """``stageN...`` is N, ``bridge_a_b`` lies half way, everything else comes last."""
    number = F.nullif(F.regexp_extract(stage, r"^stage(\d+)", 1), F.lit("")).cast("double")
    ends = [F.nullif(F.regexp_extract(stage, r"^bridge_(\d+)_(\d+)", i), F.lit("")).cast("double") for i in (1, 2)]
    return F.coalesce(number, (ends[0] + ends[1]) / 2, F.lit(999.0))


def tactic_rank(tactics: Column, order: list[str] = TACTICS) -> Column:
    """The first place in ``order`` of any of a row's tactics, from 0; 99 if there is none."""
    places = F.transform(tactics, lambda t: F.array_position(F.array(*map(F.lit, order)), t))
    return F.coalesce((F.array_min(F.filter(places, lambda p: p > 0)) - 1).cast("int"), F.lit(99))


def to_env_codes(edges: DataFrame, src: str = "src_type", dst: str = "dst_type", code: str = "code") -> DataFrame:
    """Edges with their node types and code in the validator's terms: process, file and socket as MP, MF and SO (others SO), codes by the table, others as they are."""
    kind = lambda c: lookup(F.col(c), NODE_CODE, "SO")
    return edges.withColumns({src: kind(src), dst: kind(dst), code: F.coalesce(lookup(F.col(code), EDGE_CODE), code)})


def edges_by_label(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph_id, actorID, actor_type, objectID, object, action, timestamp): edges (graph_id, src, dst, type, event_order, timestamp) by the labels of their nodes (graph_id, node, label, type).

    Nodes of one label merge; a node that isn't listed, or without a label, goes by its id. An absent type is process for a
    source and file for a target. The order is event_order, else timestamp, else 0.
    """
    end = lambda c: nodes.select("graph_id", F.col("node").alias(c), F.col("label").alias(f"_{c}_l"), F.col("type").alias(f"_{c}_t")).hint("merge")
    both = edges.join(end("src"), ["graph_id", "src"], "left").join(end("dst"), ["graph_id", "dst"], "left")
    order = F.coalesce(F.col("event_order").cast("string"), F.col("timestamp").cast("string"), F.lit("0"))
    kind = lambda c, default: F.coalesce(lookup(F.coalesce(F.col(c), F.lit(default)), NODE_CODE), F.col(c))
    code = F.coalesce(lookup(F.upper("type"), EDGE_CODE), F.col("type"))
    return both.select("graph_id", F.coalesce("_src_l", "src").alias("actorID"), kind("_src_t", "process").alias("actor_type"), F.coalesce("_dst_l", "dst").alias("objectID"), kind("_dst_t", "file").alias("object"), code.alias("action"), order.alias("timestamp"))
