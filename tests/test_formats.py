"""Readers and writers of graph files, bundles, results and the knowledge base; what is written is read back."""

import json

from pyspark.sql import functions as F

from provgraph.operators import knowledge as T
from provgraph.operators import monitor as W
from provgraph.sources import readers as S
from provgraph.sources import writers as K


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_graph_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("3\nMP\nTP\nSO\n4\n0 1 FR-1-2\n0 2 ST\n1 9 WR-7\n0 1 fork\n\n\n")
    (tmp_path / "bad.txt").write_text("nothing here\n")
    nodes, edges = S.read_graph_text(spark, str(tmp_path))
    assert _rows(nodes) == [("a", 0, "MP"), ("a", 1, "TP"), ("a", 2, "SO")]
    assert [(r.src, r.dst, r.verb) for r in edges.orderBy("edge_idx").collect()] == [("MP", "TP", "FR"), ("MP", "SO", "ST"), ("TP", None, "WR"), ("MP", "TP", "fork")]
    staged = S.read_graph_text(spark, str(tmp_path), staged=True)[1]
    assert _rows(staged.select("edge_idx", "stage")) == [(0, 1), (0, 2), (1, 1), (1, 2), (1, 3), (1, 4)]


def test_graph_blocks(spark, tmp_path):
    (tmp_path / "b.txt").write_text("#0\n2\nMP\nSO\n1\n0 1 ST\n\n#1\n1\nTP\n0\n\n#2\n2\nMP\nTP\n2\n0 1 FR\n1 0 IJ\n")
    nodes, edges = S.read_graph_blocks(spark, str(tmp_path))
    assert _rows(nodes.groupBy("graph_id").count()) == [("b#0", 2), ("b#1", 1), ("b#2", 2)]
    assert _rows(edges.select("graph_id", "src", "dst", "verb")) == [("b#0", "MP", "SO", "ST"), ("b#2", "MP", "TP", "FR"), ("b#2", "TP", "MP", "IJ")]
    assert tuple(S.graph_means(nodes, edges).first()) == (3, 1.666667, 1.0)


def test_token_graphs(spark, tmp_path):
    (tmp_path / "t.txt").write_text("*MP *TP *SO 0 1 FR-1 1 2 ST x y z 0 1\n\nMP TP 0 1 FR\n")
    nodes, edges = S.read_token_graphs(spark, str(tmp_path))
    assert _rows(nodes) == [("t#0", 0, "MP"), ("t#0", 1, "TP"), ("t#2", 0, "MP"), ("t#2", 1, "TP")] or _rows(nodes) == [("t#0", 0, "MP"), ("t#0", 1, "TP"), ("t#1", 0, "MP"), ("t#1", 1, "TP")]
    assert _rows(edges.select("src_idx", "dst_idx", "verb")) == [(0, 1, "FR"), (0, 1, "FR"), (1, 2, "ST")]
    assert S.read_token_graphs(spark, str(tmp_path), max_node=3)[0].where("graph_id = 't#0'").count() == 3


KB = {
    "objects": [
        {"type": "attack-pattern", "id": "a1", "name": "Shell", "description": "Runs a command over the network.", "external_references": [{"source_name": "other", "external_id": "X"}, {"source_name": "mitre-attack", "external_id": "T1"}], "kill_chain_phases": [{"phase_name": "execution"}, {"phase_name": "persistence"}], "x_mitre_platforms": ["Windows 10", "Linux"], "x_mitre_permissions_required": ["User", "SYSTEM"]},
        {"type": "attack-pattern", "id": "a2", "name": "Old", "revoked": True, "external_references": [{"source_name": "mitre-attack", "external_id": "T2"}]},
        {"type": "attack-pattern", "id": "a3", "name": "Gone", "x_mitre_deprecated": True, "external_references": [{"source_name": "mitre-attack", "external_id": "T3"}]},
        {"type": "attack-pattern", "id": "a4", "name": "Wipe", "external_references": [{"source_name": "mitre-attack", "external_id": "T4"}], "x_mitre_impact_type": ["Availability"]},
        {"type": "intrusion-set", "id": "s1", "name": "Group"},
        {"type": "relationship", "relationship_type": "uses", "source_ref": "s1", "target_ref": "a4"},
        {"type": "relationship", "relationship_type": "uses", "source_ref": "s1", "target_ref": "a1"},
        {"type": "relationship", "relationship_type": "uses", "source_ref": "s1", "target_ref": "a1"},
        {"type": "relationship", "relationship_type": "uses", "source_ref": "s1", "target_ref": "a9"},
        {"type": "relationship", "relationship_type": "related-to", "source_ref": "a1", "target_ref": "a4"},
        {"type": "relationship", "relationship_type": "subtechnique-of", "source_ref": "a1", "target_ref": "a4"},
        {"type": "relationship", "relationship_type": "mitigates", "source_ref": "a4", "target_ref": "a1"},
    ]
}


def test_knowledge_base(spark, tmp_path):
    (tmp_path / "kb.json").write_text(json.dumps(KB))
    techniques, actors, links = S.read_attack_kb(spark, str(tmp_path / "kb.json"))
    assert _rows(techniques.select("tid", "name")) == [("T1", "Shell"), ("T4", "Wipe")]
    assert [r.tid for r in T.actor_techniques(techniques, actors, links).orderBy("pos").collect()] == ["T4", "T1", "T1"]
    nodes, edges = T.technique_graph(techniques, links)
    assert (nodes.count(), _rows(edges)) == (2, [("T1", "T4", "subtechnique-of")])
    vectors = {r.tid: r.vec for r in T.vectors_of(spark.createDataFrame([("T1",), ("T4",), ("T9",)], "tid string"), techniques).collect()}
    assert [i for i, x in enumerate(vectors["T1"]) if x] == [3, 4, 14, 15, 23] and vectors["T1"][23] == 1.0
    assert [i for i, x in enumerate(vectors["T4"]) if x] == [24] and vectors["T9"] == [0.0] * 25
    context = {r.tid: r for r in T.technique_context(techniques).collect()}
    assert context["T1"].capabilities == ["execution", "file", "network", "persistence", "process"] and context["T1"].platforms == ["linux", "windows"]
    assert context["T1"].requires_network and context["T1"].produces_access and not context["T4"].requires_execution and context["T4"].impact


def test_instance_library(spark, tmp_path):
    (tmp_path / "lib.jsonl").write_text(json.dumps({"stage-key": "T1059.004-linux", "MP": ["sh", "bash"]}) + "\n" + json.dumps({"stage-key": "T1-windows", "SF": ["a"]}) + "\n")
    library = S.read_instance_library(spark, str(tmp_path / "lib.jsonl"))
    assert _rows(library) == [("T1", "windows", "SF", "a"), ("T1059.004", "linux", "MP", "bash"), ("T1059.004", "linux", "MP", "sh")]
    rules = spark.createDataFrame([("r", "T1059.004"), ("r", "T1059.004"), ("q", "T1")], "rule string, technique_id string")
    assert _rows(T.rule_instances(rules, library, "linux")) == [("r", "MP", "bash"), ("r", "MP", "sh")]


def test_run_curves(spark, tmp_path):
    for name, values in (("rq1_a.log", (0.5, 0.7)), ("rq2_b.log", (0.1,))):
        (tmp_path / name).write_text("".join(f"Global F1 : {v}\n" for v in values))
    curves, last = W.f1_curves(S.read_run_logs(spark, str(tmp_path))[0], "rq1")
    assert _rows(curves.select("episode", "f1")) == [(1, 0.5), (2, 0.7)] and [r.last_f1 for r in last.collect()] == [0.7]


EDGES = "graph_id string, edge_id int, actorID string, actor_type string, objectID string, object string, action string"


def test_graph_text_round_trip(spark, tmp_path):
    rows = [("g", 2, "b", "process", "c d", "file", "read"), ("g", 1, "a", "process", "b", "process", "clone"), ("h", 5, "x", "process", "x", "process", "read")]
    K.write_graph_text(spark.createDataFrame(rows, EDGES), str(tmp_path / "out"))
    read = spark.read.text(str(tmp_path / "out"), wholetext=True)
    assert [r.value.strip() for r in read.where("graph_id = 'g'").collect()] == ["3\na\nb\nc d\n2\n0 1 clone\n1 2 read"]
    nodes, edges = S._graph_blocks(read.select("graph_id", F.col("value").alias("text")), False)
    assert _rows(edges.select("graph_id", "src", "dst", "verb")) == [("g", "a", "b", "clone"), ("g", "b", "c d", "read"), ("h", "x", "x", "read")]


def test_bundles_round_trip(spark, tmp_path):
    samples = spark.createDataFrame([("A_x", "g1", "A", "x", "malicious"), ("B_x", "g2", "B", "x", "malicious")], "sample_id string, graph_id string, apt string, variant_type string, label string")
    nodes = spark.createDataFrame([("A_x", "n1", "sh", "process", None, "hub"), ("A_x", "n0", "f", "file", "stage1", "internal")], "sample_id string, id string, label string, type string, stage string, role string")
    edges = spark.createDataFrame([("A_x", "n1", "n0", "WF", 7, False), ("A_x", "n0", "n1", "RF", 3, True)], "sample_id string, source string, target string, type string, event_order int, is_bridge boolean")
    K.write_bundles(samples, nodes, edges, str(tmp_path / "b"))
    s, n, e = S.read_bundles(spark, str(tmp_path / "b"), lines=True)
    assert _rows(s.select("sample_id", "graph_id")) == [("A_x", "g1")] and n.where("stage is null").count() == 1 and n.count() == 2
    assert _rows(e.select("id", "source", "event_order", "is_bridge")) == [("e000000", "n0", 3, True), ("e000001", "n1", 7, False)]
    assert spark.read.json(str(tmp_path / "b")).where("graph_id = 'g2'").select("stats.nodes", "stats.edges").first() == (0, 0)


def test_dot_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([("g", "a", 'x<"1">&', "process", None), ("g", "b", "f", "file", "stage1")], "graph_id string, node string, label string, type string, stage string")
    edges = spark.createDataFrame([("g", "a", "b", "WF")], "graph_id string, src string, dst string, type string")
    K.write_dot(nodes, edges, str(tmp_path / "d"))
    text = spark.read.text(str(tmp_path / "d"), wholetext=True).first().value
    assert text.strip() == 'digraph {\n  "a" [label="x&lt;&quot;1&quot;&gt;&amp;" type="process"]\n  "b" [label="f" type="file" stage="stage1"]\n  "a" -> "b" [label="WF"]\n}'


def test_edge_cache_and_appends(spark, tmp_path):
    edges = spark.createDataFrame([("d1", "s", 1), ("d2", "t", 2)], "dataset string, sample_id string, edge_id int")
    assert K.write_edges(edges, str(tmp_path / "e")) and not K.write_edges(edges.limit(1), str(tmp_path / "e"))
    assert spark.read.parquet(str(tmp_path / "e")).count() == 2 and K.write_edges(edges.limit(1), str(tmp_path / "e"), overwrite=True)
    scores = spark.createDataFrame([("s", 1, 0.25), ("t", 1, 0.75)], "sample_id string, label int, prob double")
    for _ in range(2):
        K.append_hard_samples(edges, scores, str(tmp_path / "h"))
        K.append_eval_metrics(spark.createDataFrame([(1, 0.5)], "step int, f1 double"), str(tmp_path / "m"))
    assert _rows(spark.read.csv(str(tmp_path / "h"), sep="\t")) == [("s", "d1", "1", "0.25")] * 2
    assert _rows(spark.read.csv(str(tmp_path / "m"), header=True)) == [("1", "0.5")] * 2


def test_results(spark, tmp_path):
    results = spark.createDataFrame([("q", "c", 1, {"f1": 0.5, "x": None})], "rq string, condition string, seed int, metrics map<string,double>")
    K.write_long_results(results, str(tmp_path / "l"))
    assert sorted(set("".join(p.read_text() for p in (tmp_path / "l").glob("part*")).split())) == ["q,c,1,f1,0.5", "q,c,1,x,", "rq,condition,seed,metric,value"]
    summary = spark.createDataFrame([("q", "b", "f1", 0.774, 0.0, 3), ("q", "a", "f1", 0.5, None, 1), ("q", "a", "auc", 0.25, 0.125, 2)], "rq string, condition string, metric string, mean double, std double, n_seeds int")
    K.write_summary_table(summary, str(tmp_path / "s"), ["f1", "auc"])
    assert spark.read.text(str(tmp_path / "s"), wholetext=True).first().value.strip().split("\n") == ["## q", "| condition | f1 | auc |", "|---|---|---|", "| a | 0.500 | 0.250±0.125 |", "| b | 0.774±0.000 | - |"]
    for value in (1.0, 2.0):
        K.write_result_record(spark.createDataFrame([(value, 3, "text")], "f1 double, n int, note string"), "q", "c", 7, str(tmp_path / "r"), {"by": "test"})
    (record,) = S.read_results(spark, str(tmp_path / "r")).collect()
    assert (record.rq, record.condition, record.seed, record.metrics, record.meta) == ("q", "c", 7, {"f1": 2.0, "n": 3.0}, {"by": "test"})


def test_manifest_and_report(spark, tmp_path):
    samples = spark.createDataFrame([("a", 1), ("b", 0), ("c", 0)], "sample_id string, label int")
    K.write_manifest(samples, "m", str(tmp_path / "m"), {"dataset": "d"})
    assert spark.read.json(str(tmp_path / "m" / "totals")).select("name", "n_total", "n_mal", "n_ben", "dataset").first() == ("m", 3, 1, 2, "d")
    assert spark.read.json(str(tmp_path / "m" / "samples")).count() == 3
    quality = spark.createDataFrame([("g", 0.5, 0.25), ("h", 0.5, None)], "graph_id string, total double, novelty double")
    chain = spark.createDataFrame([("g", 1, "T1", "execution", 0.5, "file"), ("g", 2, "T2", "impact", None, None)], "graph_id string, pos int, item string, tactic string, score double, bridge_hint string")
    gone = spark.createDataFrame([("g", "T9", "weak")], "graph_id string, item string, reason string")
    K.write_graph_report(quality, chain, str(tmp_path / "r"), gone)
    page = spark.read.text(str(tmp_path / "r" / "text"), wholetext=True).where("graph_id = 'g'").first().value
    assert page.strip().split("\n") == ["# g", "- total: 0.5000", "- novelty: 0.2500", "## Chain", "1. T1 (execution) -> score=0.5000, bridge=file", "2. T2 (impact)", "## Removed", "- T9: weak"]
    assert spark.read.json(str(tmp_path / "r" / "json")).where("graph_id = 'h'").select(F.size("chain"), F.size("removed")).first() == (0, 0)


def test_graph_text_in_splits(spark, tmp_path):
    """Files read in splits of 1 kB give the rows of files read in one, whatever falls on a border; blank lines, carriage returns and text before the first block included."""
    import random
    import re

    r = random.Random(3)
    block = lambda n, m: "\n".join([str(n), *(f"node {i} {'x' * r.randrange(30)}" for i in range(n)), "", f"{m}\r", *(f"{r.randrange(n)} {r.randrange(n)} FR-{r.randrange(1, 6)}" + "\n" * r.randrange(3) for _ in range(m))]) + "\n"
    for folder, texts in {"one": {"a.txt": block(300, 700), "b.txt": block(2, 3), "c.txt": "no graph\n"}, "many": {"d.txt": "lead\n" + "".join(f"#{i}\n" + block(r.randrange(1, 60), r.randrange(90)) for i in range(40)), "e.txt": "#7\n" + block(500, 400), "f.txt": "none\n"}}.items():
        (tmp_path / folder).mkdir()
        for name, text in texts.items():
            (tmp_path / folder / name).write_bytes(text.encode())
    read = {"one": S.read_graph_text, "many": S.read_graph_blocks}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for folder, reader in read.items():
        for staged in (False, True):
            whole = [_rows(x) for x in reader(spark, str(tmp_path / folder), staged)]
            spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
            split = [_rows(x) for x in reader(spark, str(tmp_path / folder), staged)]
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
            links = [m for f in (tmp_path / folder).iterdir() for m in re.findall(r"^\d+ \d+ FR-(\d)$", f.read_text(), re.M)]
            assert whole == split and len(whole[0]) > 300 and len(whole[1]) == sum(not staged or m != "5" for m in links) > 500
    nodes, edges = S.read_graph_blocks(spark, str(tmp_path / "many"))
    assert nodes.where("graph_id = 'e#7'").count() == 500 and edges.where("graph_id = 'e#7'").count() == 400 and nodes.select("graph_id").distinct().count() == 41


def test_graph_text_written_and_read(spark, tmp_path):
    """What the writer leaves a folder a graph is read back under the graphs' names."""
    rows = [(g, i, f"n{i % 5}", "process", f"n{i % 3}", "file", "read") for g in ("g", "h") for i in range(9)]
    K.write_graph_text(spark.createDataFrame(rows, EDGES), str(tmp_path / "out"))
    nodes, edges = S.read_graph_text(spark, str(tmp_path / "out"))
    assert _rows(edges.select("graph_id", "edge_idx", "src", "dst", "verb")) == sorted((g, i, s, d, v) for g, i, s, _, d, _, v in rows) and nodes.count() == 10


def test_graph_text_many_graphs_a_file(spark, tmp_path):
    """Beyond ``folders`` graphs share files and come back whole, whatever they and their nodes are called, and wherever a split falls."""
    names = ["007", "1e5", "a b", "#3", "50%+x/y", "\\\\", "é"]
    rows = [(g, i, f"{mark}n{i % 5}", "process", f"#n{i % 3}", "file", "read") for g in names for i in range(9) for mark in ("#", " #", "\\", "2 2 ")[i % 4 : i % 4 + 1]]
    K.write_graph_text(spark.createDataFrame(rows, EDGES), str(tmp_path / "out"), folders=len(names) - 1)
    assert [p.name for p in tmp_path.joinpath("out").iterdir() if p.is_dir()] == ["graph_layout=blocks"]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (before, "100"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            nodes, edges = S.read_graph_text(spark, str(tmp_path / "out"))
            assert _rows(edges.select("graph_id", "edge_idx", "src", "dst", "verb")) == sorted((g, i, s.strip(), d, v) for g, i, s, _, d, _, v in rows)
            assert _rows(nodes.groupBy("graph_id").count()) == sorted((g, len({x for r in rows if r[0] == g for x in (r[2], r[4])})) for g in names)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    K.write_graph_text(spark.createDataFrame(rows, EDGES), str(tmp_path / "each"), folders=len(names))
    assert len([p for p in tmp_path.joinpath("each").iterdir() if p.is_dir()]) == len(names)
