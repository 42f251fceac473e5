"""Registered round trips: views of the given tables written by the library's sinks, or as the foreign formats it reads, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provgraph.plans.graph_queries import sql_file
from provgraph.plans.queries import ORACLES, _add
from provgraph.session import scratch_dir
from provgraph.sources import readers as S
from provgraph.sources import writers as K


def _folder(df: DataFrame) -> str:
    return f"{scratch_dir(df.sparkSession)}/files/{uuid.uuid4().hex}"


def _text(df: DataFrame, value: Column) -> str:
    """The folder in which ``value`` lies as lines of text."""
    path = _folder(df)
    df.select(value.alias("value")).write.text(path)
    return path


def k1_edge_cache(edges: DataFrame) -> DataFrame:
    """Edges written to the cache, kept when written again without the wish to overwrite, and read."""
    path = _folder(edges)
    named = edges.withColumn("dataset", F.concat(F.lit("day "), F.substring("graph_id", 9, 2)))
    K.write_edges(named, path)
    K.write_edges(named.limit(0), path)
    return edges.sparkSession.read.parquet(path).select("dataset", "graph_id", "edge_id", "actorID", "objectID", "action")


def k2_s3_graph_text(edges: DataFrame) -> DataFrame:
    path = _folder(edges)
    K.write_graph_text(edges, path)
    return S.read_graph_text(edges.sparkSession, path)[1].select("graph_id", "edge_idx", "src", "dst", "verb")


def s13_graph_blocks(edges: DataFrame) -> DataFrame:
    """Many graphs a file, each behind its number."""
    numbered = F.transform(F.array_sort(F.collect_list(F.struct("edge_id", "actorID", "objectID", "action"))), lambda e: F.concat_ws(" ", F.lit("0"), F.lit("1"), e.action))
    graphs = edges.groupBy("graph_id").agg(numbered.alias("_e"), F.min("actorID").alias("_a"), F.max("objectID").alias("_b"))
    path = _text(graphs, F.concat_ws("\n", F.concat(F.lit("#"), "graph_id"), F.lit("2"), "_a", "_b", F.size("_e").cast("string"), F.array_join("_e", "\n"), F.lit("")))
    found = S.read_graph_blocks(edges.sparkSession, path)[1]
    return found.select(F.split_part("graph_id", F.lit("#"), F.lit(-1)).alias("graph_id"), "edge_idx", "src", "dst", "verb")


def s4_token_graphs(edges: DataFrame) -> DataFrame:
    """A graph a line: marked entities, then triples by their numbers."""
    triples = F.array_join(F.transform(F.collect_list("edge_id"), lambda e: F.concat_ws(" ", (e % 3).cast("string"), (e % 2).cast("string"), F.lit("FR-1"))), " ")
    path = _text(edges.groupBy("graph_id").agg(triples.alias("_t")), F.concat_ws(" ", F.lit("*MP *TP MF SO"), "_t"))
    return S.graph_means(*S.read_token_graphs(edges.sparkSession, path))


def k3_s6_bundles(edges: DataFrame) -> DataFrame:
    path, name = _folder(edges), F.concat(F.lit("g"), "graph_id")
    samples = edges.select("graph_id", name.alias("apt")).distinct().select(F.concat("apt", F.lit("_v")).alias("sample_id"), "graph_id", "apt", F.lit("v").alias("variant_type"), F.lit("malicious").alias("label"))
    sample = F.concat(name, F.lit("_v")).alias("sample_id")
    null = lambda c: F.lit(None).cast("string").alias(c)
    nodes = edges.select(sample, F.col("actorID").alias("id"), F.lit("process").alias("type")).distinct().select("sample_id", "id", F.col("id").alias("label"), "type", null("stage"), null("role"))
    links = edges.select(sample, F.col("actorID").alias("source"), F.col("objectID").alias("target"), F.col("action").alias("type"), F.col("edge_id").cast("int").alias("event_order"), (F.col("edge_id") % 5 == 0).alias("is_bridge"))
    K.write_bundles(samples, nodes, links, path)
    return S.read_bundles(edges.sparkSession, path, lines=True)[2].select("sample_id", "id", "source", "target", "type", "event_order", "is_bridge")


def k5_long_results(results: DataFrame) -> DataFrame:
    path = _folder(results)
    records = results.groupBy("rq", "condition", "seed").agg(F.count("*").alias("_n"), F.max("qty").alias("_q"))
    metrics = F.create_map(F.lit("rows"), F.col("_n").cast("double"), F.lit("largest"), "_q", F.lit("none"), F.lit(None).cast("double"))
    K.write_long_results(records.select("rq", "condition", "seed", metrics.alias("metrics")), path)
    return results.sparkSession.read.csv(path, header=True, schema="rq string, condition string, seed int, metric string, value double")


def k6_manifest(scores: DataFrame) -> DataFrame:
    path = _folder(scores)
    K.write_manifest(scores.select("sample_id", "label"), "corpus", path)
    read = scores.sparkSession.read
    listed = read.schema("sample_id bigint, label int").json(f"{path}/samples").agg(F.count("*").alias("n_listed"), F.sum("sample_id").alias("ids"))
    return read.schema("name string, n_total bigint, n_mal bigint, n_ben bigint").json(f"{path}/totals").crossJoin(F.broadcast(listed))


def k7_hard_samples(scores: DataFrame) -> DataFrame:
    """Two evaluations append to one file."""
    path, edges = _folder(scores), scores.select("sample_id", F.concat(F.lit("e"), F.col("sample_id").cast("string")).alias("edge"))
    for prob in ("prob", "prob_after"):
        K.append_hard_samples(edges, scores.select("sample_id", "label", F.col(prob).alias("prob")), path)
    return scores.sparkSession.read.csv(path, sep="\t", schema="sample_id bigint, edge string, prob double")


def k8_eval_metrics(scores: DataFrame) -> DataFrame:
    path = _folder(scores)
    for prob in ("prob", "prob_after"):
        K.append_eval_metrics(scores.groupBy("grp").agg(F.count(prob).alias("n"), F.count_if(F.col(prob) >= 0.5).alias("above")).select(F.lit(prob).alias("run"), "grp", "n", "above"), path)
    return scores.sparkSession.read.csv(path, header=True, schema="run string, grp string, n bigint, above bigint")


def s1_cdm_edges(edges: DataFrame) -> DataFrame:
    """An audit log as JSON lines: declarations of the objects that are sockets and of all subjects, events of known and unknown types, and lines that are none."""
    json = lambda kind, *fields: F.concat(F.lit('{"datum":{"x.y.' + kind + '":{'), F.concat_ws(",", *fields), F.lit("}}}"))
    field = lambda name, value: F.concat(F.lit(f'"{name}":"'), value.cast("string"), F.lit('"'))
    kind = F.when(F.col("action") == "read", "EVENT_RECVFROM").when(F.col("action") == "clone", "EVENT_FORK").when(F.col("action") == "send", "EVENT_CONNECT").when(F.col("action") == "write", "EVENT_OTHER").otherwise(F.concat(F.lit("EVENT_"), F.upper("action")))
    event = json("Event", field("type", kind), field("subject", F.col("actorID")), field("predicateObject", F.col("objectID")), field("timestampNanos", F.col("edge_id")))
    nodes = edges.select("actorID").distinct().select(json("Subject", field("uuid", F.col("actorID"))).alias("value"))
    sockets = edges.where("object = 'socket'").select("objectID").distinct().select(json("NetFlowObject", field("uuid", F.col("objectID"))).alias("value"))
    path = _text(edges.select(event.alias("value")).unionByName(nodes).unionByName(sockets).unionByName(edges.select(F.lit("{broken").alias("value")).distinct()), F.col("value"))
    return S.read_cdm_edges(edges.sparkSession, path).select("src", "actor_type", "dst", "object", "action", "ts")


def s2_event_tsv(edges: DataFrame) -> DataFrame:
    path = _folder(edges)
    edges.select("actorID", "actor_type", "objectID", "object", "action", "edge_id").write.csv(path, sep="\t")
    return S.read_event_tsv(edges.sparkSession, path).select("actorID", "actor_type", "objectID", "object", "action", "timestamp")


def s8_ground_truth(edges: DataFrame) -> DataFrame:
    """Identifiers in running text, two a line."""
    known = lambda c: F.regexp_replace(F.md5(c), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return S.read_ground_truth(edges.sparkSession, _text(edges, F.concat(F.lit("node "), known("actorID"), F.lit(","), known("objectID"), F.lit("; and no more"))))


def s11_instance_library(edges: DataFrame) -> DataFrame:
    path = _text(edges.groupBy("actorID").agg(F.array_sort(F.collect_set("objectID")).alias("_n")), F.to_json(F.struct(F.concat("actorID", F.lit("-a-linux")).alias("stage-key"), F.col("_n").alias("MF"))))
    return S.read_instance_library(edges.sparkSession, path)


for query, views in {
    k1_edge_cache: "ev_edges", k2_s3_graph_text: "small_graphs", s13_graph_blocks: "small_graphs", s4_token_graphs: "small_graphs", k3_s6_bundles: "small_graphs", k5_long_results: "results", k6_manifest: "scores",
    k7_hard_samples: "scores", k8_eval_metrics: "scores", s1_cdm_edges: "ev_edges", s2_event_tsv: "ev_edges", s8_ground_truth: "ev_edges", s11_instance_library: "ev_edges",
}.items():
    _add(query.__name__, views, query)
    ORACLES[query.__name__] = sql_file(query.__name__, *views.split())
