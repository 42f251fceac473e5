"""Readers on small files written by the tests."""

import json

from provgraph.operators import chains as T
from provgraph.sources import readers as S

A, B, C = (f"0000000{i}-0000-0000-0000-00000000000{i}" for i in (1, 2, 3))
NS = "com.example.cdm18."


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_cdm_events(spark, tmp_path):
    event = lambda kind, s, o, ts: {"datum": {NS + "Event": {"type": kind, "subject": s, "predicateObject": o, "timestampNanos": ts}}}
    records = [
        event("EVENT_WRITE", {NS + "UUID": A}, B, 5), {"datum": {NS + "Subject": {"uuid": A, "type": "SUBJECT_PROCESS"}}}, {"datum": {NS + "FileObject": {"uuid": B}}}, {"datum": {"x.cdm20.NetFlowObject": {"uuid": B}}},
        event("EVENT_OTHER", A, B, 6), event("EVENT_READ", A, None, 7), event("EVENT_READ", C, {NS + "UUID": C}, 8), {"other": 1},
    ]
    (tmp_path / "log.jsonl").write_text("\n".join([*map(json.dumps, records), "{not json", ""]))
    edges = S.read_cdm_edges(spark, str(tmp_path)).select("src", "actor_type", "dst", "object", "action", "ts")
    assert _rows(edges) == [(A, "process", B, "socket", "write", "5"), (C, "process", C, "file", "read", "8")]


def test_tsv_and_truth(spark, tmp_path):
    for number in (124, 125):
        (tmp_path / f"{number}.txt").write_text("a\tprocess\tb\tfile\tread\t1\n")
    assert _rows(S.read_event_tsv(spark, str(tmp_path)).select("graph_id", "label", "actorID")) == [("124", 0, "a"), ("125", 1, "a")]
    (tmp_path / "truth").mkdir()
    (tmp_path / "truth" / "t.txt").write_text(f"x {A} and {B}\nnone\n{A}\n")
    assert _rows(S.read_ground_truth(spark, str(tmp_path / "truth"))) == [(A,), (B,)]


def test_run_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text("  Global F1      : 0.5\n[STOP-PLATEAU]\nGlobal F1 : N/A\nGlobal F1 : 0.75\n[STOP-CONVERGED] sau 14 episodes\n")
    (tmp_path / "b.log").write_text("[STOP-FAILURE]\n[STOP-PLATEAU]\n")
    series, runs = S.read_run_logs(spark, str(tmp_path))
    assert _rows(series.select("episode", "f1")) == [(1, 0.5), (2, 0.75)]
    assert [tuple(r) for r in runs.orderBy("run_id").select("converged_at", "stop_reason", "last_f1").collect()] == [(14, "CONVERGED", 0.75), (None, "FAILURE", None)]


def test_records(spark, tmp_path):
    for name in ("r", "v", "b"):
        (tmp_path / name).mkdir()
    (tmp_path / "r" / "1.json").write_text(json.dumps({"rq": "q", "condition": "c", "seed": 1, "metrics": {"f1": 0.5, "x": None}, "meta": {}}))
    (tmp_path / "r" / "2.json").write_text("{bad")
    assert [(r.condition, r.metrics) for r in S.read_results(spark, str(tmp_path / "r")).collect()] == [("c", {"f1": 0.5, "x": None})]
    (tmp_path / "v" / "1.json").write_text(json.dumps({"graph_id": "g", "predicted_label": "malicious", "malicious_score": 0.9}))
    (tmp_path / "v" / "2.json").write_text(json.dumps({"graph_id": "h", "predicted_label": "benign"}))
    good, bad = S.read_verdicts(spark, str(tmp_path / "v"))
    assert _rows(good.select("graph_id", "confidence")) == [("g", 0.9)]
    assert _rows(bad.select("reason")) == [("missing malicious_score",)]
    bundle = {"graph_id": "g", "apt": "A", "variant_type": "x", "nodes": [{"id": "1", "type": "process"}], "edges": [{"id": "e", "source": "1", "target": "1", "type": "FR"}]}
    (tmp_path / "b" / "1.json").write_text(json.dumps(bundle))
    (tmp_path / "b" / "2.json").write_text(json.dumps({**bundle, "apt": "B", "edges": []}))
    samples, nodes, edges = S.read_bundles(spark, str(tmp_path / "b"))
    assert (_rows(samples.select("sample_id")), nodes.count(), edges.count()) == ([("A_x",)], 1, 1)
    assert S.read_bundles(spark, str(tmp_path / "b"), families=["B"])[0].count() == 0


def test_dot(spark, tmp_path):
    (tmp_path / "g.dot").write_text('digraph {\n a [label="sh" type=process];\n b [type="file"]\n a -> b [label="RF"];\n a -> b [label="WF"]\n}\n')
    nodes, edges = S.read_dot_edges(spark, str(tmp_path))
    assert _rows(nodes) == [("g", "g__a", "sh", "process"), ("g", "g__b", "b", "file")]
    assert _rows(edges) == [("g", "g__a", "g__b", "WF")]


def test_drop_weak_stages(spark):
    chain = spark.createDataFrame([("c", i, x) for i, x in enumerate("abcdef")], "chain_id string, pos int, item string")
    scores = spark.createDataFrame([("c", "a", "b", 0.9), ("c", "b", "c", 0.1), ("c", "b", "d", 0.5), ("c", "d", "e", 0.2), ("c", "d", "f", 0.1)], "chain_id string, src string, dst string, score double")
    found = T.drop_weak_stages(chain, scores).first()
    assert (found.kept, found.removed) == (list("abdef"), ["c"])
    assert T.drop_weak_stages(chain.where("pos < 1"), scores).first().kept == ["a"]


def test_fill_missing_tactics(spark):
    chain = spark.createDataFrame([("c", 1, "a", "t1", [1.0, 0.0])], "chain_id string, pos int, item string, tactic string, vec array<double>")
    offered = spark.createDataFrame([("p", "t2", [1.0, 0.1]), ("q", "t2", [0.0, 1.0]), ("r", "t1", [1.0, 0.0])], "item string, tactic string, vec array<double>")
    assert _rows(T.fill_missing_tactics(chain, offered, ["t1", "t2", "t3"]).select("pos", "item")) == [(1, "a"), (2, "p")]
