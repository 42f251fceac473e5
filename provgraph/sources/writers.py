"""Sinks: edge tables, graph text, bundles, DOT, results, manifests and reports, all by Spark's own writers.

Formats of one file a graph are written as one text row a graph, partitioned by graph, so tasks write side by side; only a
graph's own lines meet in one row. Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provgraph.operators.features import index_graph
from provgraph.operators.results import melt_metrics


def write_edges(edges: DataFrame, path: str, overwrite: bool = False, by: str = "dataset") -> bool:
    """Parquet partitioned by ``by``; what is there already is kept unless ``overwrite``. Tells whether it was written."""
    spark = edges.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not overwrite and at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return False
    edges.write.mode("overwrite").partitionBy(by).parquet(path)
    return True


#: Most graphs that get a folder each in ``write_graph_text``.
FOLDERS = 1000


def _by_graph(rows: DataFrame, path: str, key: str = "graph_id") -> None:
    """One text row (key, value) a graph, in a folder ``key=...`` each."""
    rows.select(key, "value").write.mode("overwrite").partitionBy(key).option("lineSep", "\n").text(path)


def _lines(rows: DataFrame, order: Sequence[str], line: str, key: str = "graph_id") -> DataFrame:
    """(key, lines): a group's lines in order, one under the other."""
    sorted_lines = F.array_sort(F.collect_list(F.struct(*order, line)))
    return rows.groupBy(key).agg(F.array_join(F.transform(sorted_lines, lambda x: x[line]), "\n").alias("lines"), F.count("*").alias("n"))


def write_graph_text(edges: DataFrame, path: str, folders: int | None = None) -> None:
    """The layout of ``read_graph_text``: N, node lines in the order of first appearance, M, edge lines by edge_id.

    Edges are (graph_id, edge_id, actorID, actor_type, objectID, object, action). Line feeds in names become spaces. Up to ``folders`` graphs (None: ``FOLDERS``) get a
    folder each. More lie together in the files of one folder ``graph_layout=blocks``, each behind a line ``#`` with its name as in a URL, so that neither the writer
    nor a reader has to list a file a graph; there a backslash goes before node names that start with ``#`` or a backslash.
    """
    most = FOLDERS if folders is None else folders
    blocks = edges.select("graph_id").distinct().limit(most + 1).count() > most
    nodes, ends = index_graph(edges)
    plain = lambda c: F.regexp_replace(F.col(c), r"[\r\n]+", " ")
    name = F.regexp_replace(plain("node"), r"^ *([#\\])", r"\\$1") if blocks else plain("node")
    listed = _lines(nodes.withColumn("line", name), ["idx"], "line").select("graph_id", F.col("lines").alias("_nodes"), F.col("n").alias("_n"))
    named = ends.join(edges.select("graph_id", "edge_id", "action"), ["graph_id", "edge_id"]).withColumn("line", F.concat_ws(" ", F.col("src_idx").cast("string"), F.col("dst_idx").cast("string"), plain("action")))
    links = _lines(named, ["edge_id"], "line")
    text = F.concat_ws("\n", F.col("_n").cast("string"), "_nodes", F.col("n").cast("string"), "lines")
    rows = listed.join(links.hint("merge"), "graph_id").select("graph_id", text.alias("value"))
    if blocks:
        marked = F.concat_ws("\n", F.concat(F.lit("#"), F.url_encode(F.col("graph_id").cast("string"))), "value")
        _by_graph(rows.select(F.lit("blocks").alias("graph_layout"), marked.alias("value")), path, "graph_layout")
    else:
        _by_graph(rows, path)


def bundles(samples: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a sample with nested nodes and edges, edge ids ``e000000`` by event_order, and stats.

    Samples (sample_id, graph_id, apt, variant_type, label), nodes (sample_id, id, label, type, stage, role), edges
    (sample_id, source, target, type, event_order, is_bridge). A sample without nodes or edges has empty lists.
    """
    node, edge = ["id", "label", "type", "stage", "role"], ["id", "source", "target", "type", "event_order", "is_bridge"]
    n = nodes.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct(*node))).alias("nodes"))
    ordered = F.array_sort(F.collect_list(F.struct("event_order", "source", "target", "type", "is_bridge")))
    numbered = F.transform(ordered, lambda x, i: F.struct(F.concat(F.lit("e"), F.lpad(i.cast("string"), 6, "0")).alias("id"), *(x[c].alias(c) for c in edge[1:])))
    e = edges.groupBy("sample_id").agg(numbered.alias("edges"))
    both = samples.join(n.hint("merge"), "sample_id", "left").join(e.hint("merge"), "sample_id", "left")
    none = lambda c, like: F.coalesce(F.col(c), F.array().cast(like.schema[c].dataType))
    full = both.withColumns({"nodes": none("nodes", n), "edges": none("edges", e)})
    stats = F.struct(F.size("nodes").alias("nodes"), F.size("edges").alias("edges"))
    return full.select(F.lit("1.0").alias("schema_version"), "graph_id", "apt", "variant_type", "label", stats.alias("stats"), "nodes", "edges")


def write_bundles(samples: DataFrame, nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """JSON bundles, one object a line; ``read_bundle_lines`` and any JSON reader take them."""
    bundles(samples, nodes, edges).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def _escaped(value: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        value = F.replace(value, F.lit(raw), F.lit(safe))
    return F.regexp_replace(value, r"[\r\n]+", " ")


def _attributes(df: DataFrame, skip: Sequence[str], names: Mapping[str, str]) -> Column:
    """``name="value"`` of every other column that isn't null."""
    shown = [F.concat(F.lit(f'{names.get(c, c)}="'), _escaped(F.col(c).cast("string")), F.lit('"')) for c in df.columns if c not in skip]
    return F.array_join(F.array_compact(F.array(*shown)), " ")


def write_dot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """DOT text a graph: nodes (graph_id, node, ...) and edges (graph_id, src, dst, type, ...) with their other columns as attributes, nulls skipped, html-escaped."""
    quoted = lambda c: F.concat(F.lit('"'), _escaped(F.col(c)), F.lit('"'))
    own = nodes.withColumn("line", F.concat(F.lit("  "), quoted("node"), F.lit(" ["), _attributes(nodes, ["graph_id", "node"], {}), F.lit("]")))
    link = edges.withColumn("line", F.concat(F.lit("  "), quoted("src"), F.lit(" -> "), quoted("dst"), F.lit(" ["), _attributes(edges, ["graph_id", "src", "dst"], {"type": "label"}), F.lit("]")))
    first, last = _lines(own, ["node"], "line").select("graph_id", F.col("lines").alias("_n")), _lines(link, ["src", "dst"], "line").select("graph_id", F.col("lines").alias("_e"))
    _by_graph(first.join(last.hint("merge"), "graph_id", "full").select("graph_id", F.concat_ws("\n", F.lit("digraph {"), "_n", "_e", F.lit("}")).alias("value")), path)


def write_long_results(results: DataFrame, path: str) -> None:
    """CSV (rq, condition, seed, metric, value) with a header; a null value is empty."""
    melt_metrics(results).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def manifest(samples: DataFrame, name: str, extra: Mapping[str, str] | None = None) -> DataFrame:
    """One row of totals: name, n_total, n_mal, n_ben, and what ``extra`` adds. An empty corpus has zeros."""
    row = samples.agg(F.count("*").alias("n_total"), F.count_if(F.col("label") == 1).alias("n_mal"), F.count_if(F.col("label") == 0).alias("n_ben"))
    return row.select(F.lit(name).alias("name"), "*", *(F.lit(v).alias(k) for k, v in (extra or {}).items()))


def write_manifest(samples: DataFrame, name: str, path: str, extra: Mapping[str, str] | None = None) -> None:
    """``path``/totals holds the one row of totals, ``path``/samples a JSON line a sample, without edges; so a corpus of any size can be listed."""
    manifest(samples, name, extra).write.mode("overwrite").json(f"{path}/totals")
    listed = [c for c in ("sample_id", "label", "source", "apt", "variant") if c in samples.columns]
    samples.select(*listed).write.mode("overwrite").json(f"{path}/samples")


def append_hard_samples(edges: DataFrame, scores: DataFrame, path: str, threshold: float = 0.5) -> None:
    """Tab-separated rows, one an edge, of the missed positives (sample_id, label, prob) with their score, added to what is there."""
    missed = scores.where((F.col("label") == 1) & (F.col("prob") < threshold)).select("sample_id", "prob")
    edges.join(missed.hint("merge"), "sample_id").write.mode("append").csv(path, sep="\t")


def append_eval_metrics(metrics: DataFrame, path: str) -> None:
    """CSV with a header, one row an evaluation, added to what is there."""
    metrics.write.mode("append").csv(path, header=True)


def summary_lines(summary: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(rq, place, value): a table a question, conditions down and ``metrics`` across, cells ``mean±std``, the mean alone for one seed, ``-`` for none.

    The summary is (rq, condition, metric, mean, std, n_seeds).
    """
    shown = F.when(F.col("n_seeds") > 1, F.format_string("%.3f±%.3f", "mean", "std")).otherwise(F.format_string("%.3f", "mean"))
    cells = summary.where("mean is not null").groupBy("rq", "condition").pivot("metric", list(metrics)).agg(F.first(shown))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "condition", *(F.coalesce(F.col(f"`{m}`"), F.lit("-")) for m in metrics)), F.lit(" |"))
    body = cells.select("rq", F.concat(F.lit("3"), F.col("condition")).alias("place"), row.alias("value"))
    heads = [("0", "concat('## ', rq)"), ("1", f"'| condition | {' | '.join(metrics)} |'"), ("2", f"'|{'---|' * (len(metrics) + 1)}'")]
    top = summary.select("rq").distinct().select("rq", F.explode(F.array(*(F.struct(F.lit(p).alias("place"), F.expr(e).alias("value")) for p, e in heads))).alias("_x")).select("rq", "_x.*")
    return top.unionByName(body)


def write_summary_table(summary: DataFrame, path: str, metrics: Sequence[str]) -> None:
    """``summary_lines`` as text, a folder ``rq=...`` each with its lines in order."""
    rows = _lines(summary_lines(summary, metrics), ["place"], "value", "rq")
    _by_graph(rows.select("rq", F.col("lines").alias("value")), path, "rq")


def graph_reports(quality: DataFrame, chains: DataFrame, removed: DataFrame | None = None, invalid: DataFrame | None = None) -> DataFrame:
    """Quality rows (graph_id, total, parts..) with the chain's stages, the stages removed and the invalid ones as lists.

    Chains are (graph_id, pos, item, tactic, score, bridge_hint), removed (graph_id, item, reason), invalid (graph_id, stage, issues).
    A graph without any has empty lists.
    """
    out = quality
    for name, rows, columns in (("chain", chains, ["pos", "item", "tactic", "score", "bridge_hint"]), ("removed", removed, ["item", "reason"]), ("invalid_stages", invalid, ["stage", "issues"])):
        if rows is not None:
            listed = rows.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
            out = out.join(listed.hint("merge"), "graph_id", "left").withColumn(name, F.coalesce(name, F.array().cast(listed.schema[name].dataType)))
    return out


def write_graph_report(quality: DataFrame, chains: DataFrame, path: str, removed: DataFrame | None = None, invalid: DataFrame | None = None) -> None:
    """``path``/json holds the reports as JSON lines, ``path``/text a readable page a graph."""
    reports = graph_reports(quality, chains, removed, invalid)
    reports.write.mode("overwrite").json(f"{path}/json")
    parts = [c for c, t in quality.dtypes if t == "double"]
    head = [F.concat(F.lit("# "), F.col("graph_id")), *(F.concat(F.lit(f"- {c}: "), F.when(F.col(c).isNull(), "none").otherwise(F.format_string("%.4f", c))) for c in parts), F.lit("## Chain")]
    step = lambda x: F.concat(F.concat_ws(" ", F.concat(x["pos"].cast("string"), F.lit(".")), x["item"].cast("string"), F.concat(F.lit("("), x["tactic"], F.lit(")"))), F.when(x["score"].isNull(), "").otherwise(F.concat(F.lit(" -> score="), F.format_string("%.4f", x["score"]), F.lit(", bridge="), F.coalesce(x["bridge_hint"], F.lit("")))))
    lines = [*head, F.array_join(F.transform("chain", step), "\n")]
    if removed is not None:
        lines += [F.when(F.size("removed") > 0, F.concat(F.lit("## Removed\n"), F.array_join(F.transform("removed", lambda x: F.concat(F.lit("- "), x["item"].cast("string"), F.lit(": "), x["reason"])), "\n")))]
    if invalid is not None:
        lines += [F.when(F.size("invalid_stages") > 0, F.concat(F.lit("## Stage issues\n"), F.array_join(F.transform("invalid_stages", lambda x: F.concat(F.lit("- "), x["stage"].cast("string"), F.lit(": "), F.array_join(x["issues"], "; "))), "\n")))]
    _by_graph(reports.select("graph_id", F.concat_ws("\n", *lines).alias("value")), f"{path}/text")


def write_result_record(metrics: DataFrame, rq: str, condition: str, seed: int, path: str, meta: Mapping[str, str] | None = None) -> None:
    """One JSON record of one row of metrics, in the folder of its (rq, condition, seed); an earlier one there is replaced. Only numbers go in."""
    numbers = [c for c, t in metrics.dtypes if t in ("int", "bigint", "double", "float") or t.startswith("decimal")]
    found = F.map_from_arrays(F.array(*map(F.lit, numbers)), F.array(*(F.col(c).cast("double") for c in numbers)))
    held = F.create_map(*(F.lit(x) for pair in (meta or {}).items() for x in pair)) if meta else F.create_map().cast("map<string,string>")
    key = f"{path}/rq={rq}/condition={condition}/seed={seed}"
    metrics.select(F.lit(rq).alias("rq"), F.lit(condition).alias("condition"), F.lit(seed).alias("seed"), found.alias("metrics"), held.alias("meta")).write.mode("overwrite").option("ignoreNullFields", "false").json(key)
