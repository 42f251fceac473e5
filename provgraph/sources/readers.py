"""Readers of audit logs, graph files and result records; every one is a plan over Spark's file sources.

A record's place is (file, start of its block, running number), which follows the order of lines in a file however it is split.
Bad records give no row, unless a reader says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provgraph.functions.names import map_event_action, object_type, ref_uuid
from provgraph.operators.joins import attach_node_types

# Record kinds that declare an object.
OBJECT_KINDS = ["FileObject", "NetFlowObject", "MemoryObject", "SrcSinkObject", "RegistryKeyObject", "UnnamedPipeObject"]
UUID = "[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, pos) of every line."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), place.alias("pos"))


def _stem() -> Column:
    """The file's name without directory and last extension."""
    return F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")


def cdm_records(lines: DataFrame) -> DataFrame:
    """(kind, body, pos) of lines (value, pos): the last part of the first key under ``datum``, and its object as JSON."""
    datum = F.from_json(F.get_json_object("value", "$.datum"), "map<string,string>")
    key = F.element_at(F.map_keys("_d"), 1)
    return lines.withColumn("_d", datum).where(F.size("_d") > 0).select(F.element_at(F.split(key, r"\."), -1).alias("kind"), F.element_at("_d", key).alias("body"), "pos")


def cdm_nodes(records: DataFrame) -> DataFrame:
    """(uuid, type, pos): process for subjects; socket or file for objects by their kind."""
    kind = F.when(F.col("kind") == "Subject", "process").otherwise(object_type(F.col("kind")))
    return records.where(F.col("kind").isin("Subject", *OBJECT_KINDS)).select(F.get_json_object("body", "$.uuid").alias("uuid"), kind.alias("type"), "pos").where("uuid is not null")


def cdm_events(records: DataFrame) -> DataFrame:
    """(src, dst, action, ts, pos): events with a known type, a subject and an object."""
    field = lambda x: F.get_json_object("body", f"$.{x}")
    events = records.where("kind = 'Event'").select(
        ref_uuid(field("subject")).alias("src"), ref_uuid(field("predicateObject")).alias("dst"), map_event_action(field("type")).alias("action"), F.coalesce(field("timestampNanos"), F.lit("0")).alias("ts"), "pos"
    )
    return events.where("src is not null and dst is not null and action is not null")


def read_cdm_events(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (uuid, type, pos) and events (src, dst, action, ts, pos) of a JSON-lines audit log."""
    records = cdm_records(_lines(spark, path))
    return cdm_nodes(records), cdm_events(records)


def read_cdm_edges(spark: SparkSession, path: str) -> DataFrame:
    """The typed edges (src, dst, action, ts, pos, actor_type, object) of an audit log; a node's last declaration counts, wherever it stands."""
    nodes, events = read_cdm_events(spark, path)
    return attach_node_types(events, nodes)


def read_event_tsv(spark: SparkSession, path: str, benign_below: int = 125) -> DataFrame:
    """Edges of tab-separated files, one graph a file named by its number, with ``graph_id`` and ``label`` (0 below ``benign_below``)."""
    names = ["actorID", "actor_type", "objectID", "object", "action", "timestamp"]
    rows = spark.read.csv(path, sep="\t", schema=", ".join(f"{n} string" for n in names))
    return rows.select(*names, _stem().alias("graph_id")).withColumn("label", (F.col("graph_id").try_cast("int") >= benign_below).cast("int"))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(uuid): every distinct identifier in the text."""
    return spark.read.text(path).select(F.explode(F.regexp_extract_all("value", F.lit(f"({UUID})"), F.lit(1))).alias("uuid")).distinct()


def read_run_logs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """series (run_id, episode, f1) and runs (run_id, converged_at, stop_reason, last_f1) of log files, a run named by its file's path.

    The first stop mark names the reason, but a convergence mark anywhere overrides it, and its last one gives the episode.
    A value that is no number is passed over.
    """
    lines = _lines(spark, path).withColumnRenamed("file", "run_id")
    f1 = F.regexp_extract("value", r"Global F1\s*:\s*([0-9.]+)", 1).try_cast("double")
    met = F.nullif(F.regexp_extract("value", r"\[STOP-CONVERGED\].*sau\s+(\d+)\s+episodes", 1), F.lit("")).cast("int")
    mark = F.when(F.col("value").contains("[STOP-PLATEAU]"), "PLATEAU").when(F.col("value").contains("[STOP-FAILURE]"), "FAILURE")
    marked = lines.select("run_id", "pos", f1.alias("f1"), met.alias("met"), mark.alias("mark"))
    ordered = marked.where("f1 is not null").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("pos", "f1"))).alias("_s"))
    series = ordered.select("run_id", F.posexplode("_s").alias("_p", "_v")).select("run_id", (F.col("_p") + 1).alias("episode"), F.col("_v.f1").alias("f1"))
    first = F.min_by("mark", F.when(F.col("mark").isNotNull(), F.col("pos")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos")))
    runs = marked.groupBy("run_id").agg(last("met").alias("converged_at"), first.alias("_first"), last("f1").alias("last_f1"))
    return series, runs.select("run_id", "converged_at", F.when(F.col("converged_at").isNotNull(), "CONVERGED").otherwise(F.col("_first")).alias("stop_reason"), "last_f1")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """(rq, condition, seed, metrics, meta): one JSON file a record; a file that is no JSON, or without a condition, gives no row."""
    schema = "rq string, condition string, seed int, metrics map<string,double>, meta map<string,string>"
    return spark.read.schema(schema).json(path, multiLine=True).where("condition is not null")


def read_verdicts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """verdicts and rejects (file, reason): graph_id, predicted_label and malicious_score are required, confidence is the score if absent."""
    schema = "graph_id string, predicted_label string, malicious_score double, confidence double, is_false_negative boolean, detector_name string, notes string"
    rows = spark.read.schema(schema).json(path, multiLine=True).withColumn("file", F.col("_metadata.file_path"))
    required = ["graph_id", "predicted_label", "malicious_score"]
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), c) for c in required)))
    marked = rows.withColumn("_missing", missing)
    good = marked.where(F.size("_missing") == 0).withColumn("confidence", F.coalesce("confidence", "malicious_score")).drop("_missing")
    return good, marked.where(F.size("_missing") > 0).select("file", F.concat(F.lit("missing "), F.array_join("_missing", ", ")).alias("reason"))


def read_bundles(spark: SparkSession, path: str, families: list[str] | None = None, variants: list[str] | None = None, lines: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """samples, nodes and edges of nested JSON bundles, one a file, or one a line with ``lines``; a bundle that can't be read, or without nodes or edges, gives no row."""
    node, edge = "id:string,label:string,type:string,stage:string,role:string", "id:string,source:string,target:string,type:string,event_order:int,is_bridge:boolean"
    schema = f"graph_id string, apt string, variant_type string, label string, nodes array<struct<{node}>>, edges array<struct<{edge}>>"
    rows = spark.read.schema(schema).json(path, multiLine=not lines).where("size(nodes) > 0 and size(edges) > 0")
    for column, kept in (("apt", families), ("variant_type", variants)):
        if kept:
            rows = rows.where(F.col(column).isin(kept))
    rows = rows.withColumn("sample_id", F.concat_ws("_", "apt", "variant_type"))
    part = lambda c: rows.select("sample_id", F.explode(c).alias("_x")).select("sample_id", "_x.*")
    return rows.select("sample_id", "graph_id", "apt", "variant_type", "label"), part("nodes"), part("edges")


def read_dot_edges(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes (graph_id, node, label, type) and edges (graph_id, src, dst, type) of DOT files; of repeated lines the last one counts."""
    place = F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    lines = spark.read.text(path).select(F.trim("value").alias("line"), _stem().alias("graph_id"), place.alias("pos"))
    attr = lambda name: F.nullif(F.regexp_extract("line", rf'\b{name}=(?:"([^"]*)"|(\w+))', 1), F.lit(""))
    bare = F.nullif(F.regexp_extract("line", r"\btype=(\w+)", 1), F.lit(""))
    name = lambda c: F.concat_ws("__", "graph_id", c)
    edge, node = r"^(\w+)\s*->\s*(\w+)", r"^(\w+)\s*\["
    edges = lines.where(F.col("line").rlike(edge)).select("graph_id", F.regexp_extract("line", edge, 1).alias("s"), F.regexp_extract("line", edge, 2).alias("d"), F.coalesce(attr("label"), F.lit("")).alias("type"), "pos")
    edges = edges.select("graph_id", name("s").alias("src"), name("d").alias("dst"), "type", "pos").groupBy("graph_id", "src", "dst").agg(F.max_by("type", "pos").alias("type"))
    found = lines.where(F.col("line").rlike(node) & ~F.col("line").contains("->") & ~F.col("line").startswith("digraph")).withColumn("id", F.regexp_extract("line", node, 1))
    listed = found.select("graph_id", name("id").alias("node"), F.struct(F.coalesce(attr("label"), "id").alias("label"), F.coalesce(attr("type"), bare, F.lit("")).alias("type")).alias("x"), "pos")
    return listed.groupBy("graph_id", "node").agg(F.max_by("x", "pos").alias("x")).select("graph_id", "node", "x.*"), edges


VERBS = ["RD", "WR", "EX", "UK", "CD", "FR", "IJ", "ST", "RF"]  # fixed values, as the entity types below
ENTITIES = ["MP", "TP", "MF", "SF", "TF", "SO"]


def _placed_lines(spark: SparkSession, path: str, mark: str | None = None) -> DataFrame:
    """(graph_id, k, line): the lines that aren't blank, numbered from 1 within a file, or within the part of it that a line of the
    form ``mark`` (with a number) starts; such a part is named by file and number, and what comes before the first is left out. The folder
    ``graph_layout=...`` of ``write_graph_text`` has marks of its own, with a graph's name, and a backslash before lines that could be taken for one.

    A large file is read in splits. A line's number is its number within its split plus the lines of the splits before, and
    its mark the last one in its split or before it, so that what meets over splits is one row a split.
    """
    read = spark.read.text(path)
    named = "graph_layout" in read.columns
    mark = r"^#(.*)$" if named else mark
    name = F.col("graph_id").cast("string") if "graph_id" in read.columns else _stem()
    placed = read.select(
        name.alias("_f"), F.trim(F.regexp_replace("value", "\r", "")).alias("line"), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_n")
    ).where("line != ''")
    within = Window.partitionBy("_file", "_split").orderBy("_n")
    started = F.when(F.col("line").rlike(mark), F.struct(F.col("_i").alias("at"), F.regexp_extract("line", mark, 1).alias("no"))) if mark else F.lit(None).cast("struct<at:int,no:string>")
    local = placed.withColumn("_i", F.row_number().over(within)).withColumn("_own", started)
    local = local.withColumn("_mark", F.last("_own", True).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    splits = local.groupBy("_file", "_split").agg(F.count("*").alias("_lines"), F.max_by("_own", F.when(F.col("_own").isNotNull(), F.col("_i"))).alias("_last"))
    earlier = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    ahead = splits.withColumn("_before", F.coalesce(F.sum("_lines").over(earlier), F.lit(0)))
    carried = F.last(F.when(F.col("_last").isNotNull(), F.struct((F.col("_before") + F.col("_last.at")).alias("at"), F.col("_last.no").alias("no"))), True).over(earlier)
    ahead = ahead.withColumn("_carried", carried).select(F.col("_file").alias("_of_file"), F.col("_split").alias("_of_split"), "_before", "_carried")
    joined = local.join(ahead.hint("merge"), (F.col("_file") == F.col("_of_file")) & (F.col("_split") == F.col("_of_split")))
    at = F.col("_before") + F.col("_i")
    if mark is None:
        return joined.select(F.col("_f").alias("graph_id"), at.alias("k"), "line")
    here = F.coalesce(F.when(F.col("_mark").isNotNull(), F.struct((F.col("_before") + F.col("_mark.at")).alias("at"), F.col("_mark.no").alias("no"))), F.col("_carried"))
    graph = F.url_decode("_here.no") if named else F.concat_ws("#", "_f", "_here.no")
    line = F.regexp_replace("line", r"^\\", "") if named else F.col("line")
    return joined.withColumn("_here", here).where("_here is not null and _own is null").select(graph.alias("graph_id"), (at - F.col("_here.at")).alias("k"), line.alias("line"))


def _graph_blocks(blocks: DataFrame, staged: bool) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of (graph_id, text), where a text is N, N node lines, M, and M lines ``src dst VERB[-s..]``."""
    clean = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(F.regexp_replace(x, "\r", ""))), lambda x: x != "")
    return _graph_lines(blocks.select("graph_id", F.posexplode(clean).alias("_k", "line")).select("graph_id", (F.col("_k") + 1).alias("k"), "line"), staged)


def _graph_lines(lines: DataFrame, staged: bool) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of numbered lines (graph_id, k, line): N, N node lines, M, and M lines ``src dst VERB[-s..]``."""
    sizes = lines.where("k = 1").select("graph_id", F.col("line").try_cast("int").alias("_n")).where("_n >= 0")
    known = lines.join(sizes.hint("merge"), "graph_id")
    nodes = known.where("k > 1 and k <= _n + 1").select("graph_id", (F.col("k") - 2).cast("int").alias("node_idx"), F.col("line").alias("name"))
    lines = known.where("k >= _n + 3").select("graph_id", (F.col("k") - F.col("_n") - 3).cast("int").alias("edge_idx"), "line")
    form = r"^(\d+)\s+(\d+)\s+([A-Z]{2})(?:-([0-9-]+))?$" if staged else r"^(\d+)\s+(\d+)\s+([A-Za-z_]+)(?:-([0-9-]+))?$"
    part = lambda i: F.regexp_extract("line", form, i)
    stages = F.transform(F.filter(F.split(part(4), "-"), lambda x: x.rlike("^[1-4]$")), lambda x: x.cast("int"))
    every = F.array(*map(F.lit, (1, 2, 3, 4)))
    found = lines.where(F.col("line").rlike(form)).select("graph_id", "edge_idx", part(1).cast("int").alias("src_idx"), part(2).cast("int").alias("dst_idx"), part(3).alias("verb"), F.when(part(4) == "", every).otherwise(F.array_distinct(stages)).alias("_s"))
    end = lambda c: nodes.select("graph_id", F.col("node_idx").alias(f"{c}_idx"), F.col("name").alias(c)).hint("merge")
    named = found.join(end("src"), ["graph_id", "src_idx"], "left").join(end("dst"), ["graph_id", "dst_idx"], "left")
    columns = ["graph_id", "edge_idx", "src_idx", "dst_idx", "src", "dst", "verb"]
    return nodes, named.select(*columns, F.explode("_s").alias("stage")) if staged else named.select(*columns)


def read_graph_text(spark: SparkSession, path: str, staged: bool = False) -> tuple[DataFrame, DataFrame]:
    """nodes (graph_id, node_idx, name) and edges (graph_id, edge_idx, src_idx, dst_idx, src, dst, verb), a graph a file.

    ``staged`` adds a row for each stage of the suffix, for all four without one; stages outside 1 to 4 are ignored, and
    only verbs of two capitals count. An index without a node has a null name. A file without a number first gives no row.
    A graph is named by its file, or by the folder ``graph_id=...`` that it lies in, as ``write_graph_text`` leaves it; where that has put many graphs into a file, by the line before it. Files are read in splits.
    """
    return _graph_lines(_placed_lines(spark, path), staged)


def read_graph_blocks(spark: SparkSession, path: str, staged: bool = False) -> tuple[DataFrame, DataFrame]:
    """Like ``read_graph_text`` for files that hold many graphs, each after a line ``#i``; a graph is named by file and i."""
    return _graph_lines(_placed_lines(spark, path, r"^#(\d+)$"), staged)


def read_token_graphs(spark: SparkSession, path: str, max_node: int | None = None) -> tuple[DataFrame, DataFrame]:
    """nodes (graph_id, node_idx, type) and edges (graph_id, edge_idx, src_idx, dst_idx, verb), a graph a line.

    Entity tokens, marked with ``*`` or not, come first; the last one is dropped unless there are exactly ``max_node``
    (None: unless none is marked, as such a line has been cut already). The other tokens are read by threes; a stage suffix is cut,
    and triples without two numbers and a known verb give no edge. A graph is named by file and line number from 0.
    """
    lines = _lines(spark, path).where(F.trim("value") != "")
    name = F.regexp_extract("file", r"([^/]*?)(?:\.[^./]*)?$", 1)
    numbered = lines.withColumn("_i", F.row_number().over(Window.partitionBy("file").orderBy("pos")) - 1)
    tokens = numbered.select(F.concat_ws("#", name, F.col("_i").cast("string")).alias("graph_id"), F.split(F.trim("value"), r"\s+").alias("_t"))
    bare = lambda x: F.regexp_replace(x, r"^\*+", "")
    rows = tokens.withColumn("_e", F.filter("_t", lambda x: bare(x).isin(ENTITIES))).withColumn("_o", F.filter("_t", lambda x: ~bare(x).isin(ENTITIES)))
    marked = F.exists("_e", lambda x: F.startswith(x, F.lit("*")))
    whole = F.size("_e") == max_node if max_node is not None else ~marked
    nodes = rows.select("graph_id", F.posexplode(F.when(whole | (F.size("_e") == 0), F.col("_e")).otherwise(F.slice("_e", F.lit(1), F.size("_e") - 1))).alias("node_idx", "_x")).select("graph_id", "node_idx", bare(F.col("_x")).alias("type"))
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size("_o") - 3, F.lit(0))), lambda i: (i % 3 == 0) & (i + 2 < F.size("_o")))
    triple = rows.select("graph_id", "_o", F.posexplode(at).alias("edge_idx", "_at"))
    get = lambda k: F.get("_o", F.col("_at") + k)
    edges = triple.select("graph_id", "edge_idx", get(0).try_cast("int").alias("src_idx"), get(1).try_cast("int").alias("dst_idx"), F.split_part(get(2), F.lit("-"), F.lit(1)).alias("verb"))
    return nodes, edges.where(F.col("verb").isin(VERBS) & F.col("src_idx").isNotNull() & F.col("dst_idx").isNotNull())


def graph_means(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graphs, mean_nodes, mean_edges) over the graphs that have a node."""
    n, e = nodes.groupBy("graph_id").agg(F.count("*").alias("_n")), edges.groupBy("graph_id").agg(F.count("*").alias("_e"))
    return n.join(e, "graph_id", "left").agg(F.count("*").alias("graphs"), F.round(F.avg("_n"), 6).alias("mean_nodes"), F.round(F.avg(F.coalesce("_e", F.lit(0))), 6).alias("mean_edges"))


def read_attack_kb(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """techniques, actors and relationships of a knowledge-base bundle (one JSON object with ``objects``); ``pos`` is the place in it.

    Techniques (id, tid, name, description, tactics, platforms, permissions, impact_types, data_sources, pos) are those neither
    revoked nor deprecated that have an id of the source ``mitre-attack``; of several such ids the last counts.
    """
    strings = ["x_mitre_platforms", "x_mitre_permissions_required", "x_mitre_impact_type", "x_mitre_data_sources"]
    fields = ["type:string", "id:string", "name:string", "description:string", "revoked:boolean", "x_mitre_deprecated:boolean", "relationship_type:string", "source_ref:string", "target_ref:string"]
    fields += ["external_references:array<struct<source_name:string,external_id:string>>", "kill_chain_phases:array<struct<phase_name:string>>", *(f"{c}:array<string>" for c in strings)]
    rows = spark.read.schema(f"objects array<struct<{','.join(fields)}>>").json(path, multiLine=True).select(F.posexplode("objects").alias("pos", "o")).select("pos", "o.*")
    live = (F.col("type") == "attack-pattern") & ~F.coalesce("revoked", F.lit(False)) & ~F.coalesce("x_mitre_deprecated", F.lit(False))
    own = F.filter("external_references", lambda r: r.source_name == "mitre-attack")
    named = rows.where(live).withColumn("tid", F.when(F.size(own) > 0, F.element_at(own, -1).external_id)).where("tid is not null and tid != ''")
    phases = F.transform("kill_chain_phases", lambda p: p.phase_name).alias("tactics")
    techniques = named.select("id", "tid", "name", "description", phases, *(F.col(c).alias(to) for c, to in zip(strings, ("platforms", "permissions", "impact_types", "data_sources"))), "pos")
    actors = rows.where("type = 'intrusion-set'").select("id", "name", "pos")
    links = rows.where("type = 'relationship'").select(F.col("source_ref").alias("source"), F.col("target_ref").alias("target"), F.col("relationship_type").alias("kind"), "pos")
    return techniques, actors, links


def read_instance_library(spark: SparkSession, path: str) -> DataFrame:
    """(technique_id, os, entity_type, name) of JSON lines ``{"stage-key": "technique-os", TYPE: [names]}``; repeats stay, an absent type gives no row."""
    rows = spark.read.schema("`stage-key` string, " + ", ".join(f"{t} array<string>" for t in ENTITIES)).json(path).where("`stage-key` is not null")
    key = r"^(.*)-([^-]*)$"
    listed = F.explode(F.array(*(F.struct(F.lit(t).alias("entity_type"), F.col(t).alias("names")) for t in ENTITIES))).alias("x")
    parts = rows.select(F.regexp_extract("stage-key", key, 1).alias("technique_id"), F.regexp_extract("stage-key", key, 2).alias("os"), listed)
    return parts.select("technique_id", "os", "x.entity_type", F.explode("x.names").alias("name"))
