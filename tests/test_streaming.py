"""Streams give what the batch operators give."""

import json

import pytest
from pyspark.sql import functions as F

from provgraph.operators import evaluate as M
from provgraph.operators import monitor as W
from provgraph.sources import readers as S
from provgraph.streaming import streams as X


def _run(stream, name, mode="append"):
    # else timers of processing time keep the query going without data
    stream.sparkSession.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    stream.sparkSession.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    return stream.sparkSession.table(name)


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def parts(spark, tmp_path):
    """Writes row lists as files and reads them as a stream, a file a batch."""

    def start(name, schema, *batches):
        folder = tmp_path / name
        folder.mkdir()
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / f"{name}-{i}"))
            (part,) = (tmp_path / f"{name}-{i}").glob("part*")
            part.rename(folder / f"{i}.json")
            import os

            os.utime(folder / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder)), spark.read.schema(schema).json(str(folder))

    return start


def test_edges(spark, tmp_path):
    event = lambda s, d: json.dumps({"datum": {"x.Event": {"type": "EVENT_WRITE", "subject": s, "predicateObject": d, "timestampNanos": "1"}}})
    (tmp_path / "log").mkdir()
    for i in range(3):
        (tmp_path / "log" / f"{i}.jsonl").write_text("\n".join([event("a", f"o{i}"), json.dumps({"datum": {"x.Subject": {"uuid": "a"}}}), "bad"]))
    nodes = spark.createDataFrame([("o1", "socket", 1)], "uuid string, type string, pos int")
    got = _run(X.stream_edges(spark, str(tmp_path / "log"), nodes, 1), "x1")
    batch = S.cdm_events(S.cdm_records(S._lines(spark, str(tmp_path / "log"))))
    assert batch.count() == 3
    assert _rows(got.select("src", "dst", "object")) == [("a", "o0", "file"), ("a", "o1", "socket"), ("a", "o2", "file")]


def test_rolling_confusion(parts):
    rows = [(f"r{i % 2}", i, i % 3 == 0 and 1 or 0, i % 5 == 0 and 1 or 0, i % 7 == 0 and 1 or 0) for i in range(90)]
    stream, batch = parts("steps", "run_id string, step int, tp int, fp int, fn int", rows[:37], rows[37:41], rows[41:])
    columns = ["run_id", "step", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "accuracy"]
    got = _run(X.stream_rolling_confusion(stream, 20), "x2")
    assert _rows(got.select(columns)) == _rows(W.rolling_confusion(batch, 20).select(columns))
    assert _rows(got.select("run_id", "step", "miss_rate")) == _rows(W.rolling_miss_rate(batch, 20))


def test_hard_samples(spark, parts, tmp_path):
    rows = [(i, i % 2, (i * 37 % 100) / 100) for i in range(200)]
    stream, batch = parts("scores", "sample_id int, label int, prob double", rows[:50], rows[50:150], rows[150:])
    for _ in range(2):
        X.stream_hard_samples(stream, str(tmp_path / "hard"), str(tmp_path / "c3"), 15).awaitTermination()
    kept = W.hard_samples(X.read_hard_samples(spark, str(tmp_path / "hard")), 15)
    assert _rows(kept) == _rows(W.hard_samples(batch, 15)) and len(list((tmp_path / "hard").glob("batch=*"))) <= 3


def test_drift(spark, parts, tmp_path):
    """Within the bound that comes with it, for each batch and for all so far, over a restart, and with small summaries."""
    import random

    r = random.Random(21)
    rows = [([r.gauss(0, 1), float(i % 5), None],) for i in range(400)] + [([r.gauss(2, 1), float(i % 7), 1.0],) for i in range(400)] + [([r.gauss(-9, 3), 100.0, 2.0],) for _ in range(90)] + [(None,)]
    stream, batch = parts("vectors", "vec array<double>", rows[:400], rows[400:800], rows[800:])
    reference = spark.createDataFrame([([r.gauss(0, 1), float(i % 5), 1.0],) for i in range(3000)], "vec array<double>")
    for _ in range(2):
        X.stream_drift(stream, reference, str(tmp_path / "drift"), str(tmp_path / "c4"), 0.5, 16).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "drift" / "result")).orderBy("batch").collect()
    assert [x.batch for x in got] == [0, 1, 2] and [x.n for x in got] == [400, 400, 90] and [x.so_far_n for x in got] == [400, 800, 890]
    for x, (a, b) in zip(got, ((0, 400), (400, 800), (800, 891))):
        exact = lambda part: M.drift_flag(M.sliced_wasserstein(spark.createDataFrame(part, "vec array<double>"), reference), 0.5).first()
        one, every = exact(rows[a:b]), exact(rows[:b])
        assert abs(x.distance - one.distance) <= x.bound + 2e-6 and x.drifted == one.drifted and abs(x.so_far - every.distance) <= x.bound + 0.2
        assert x.bound < 0.2 + x.distance / 4
    assert {x.drifted for x in got} == {True, False}
    assert spark.read.parquet(str(tmp_path / "drift" / "so_far" / "batch=2")).count() <= 3 * (2 * 16 + 2 * 24 + 2) and len(list((tmp_path / "drift" / "so_far").glob("batch=*"))) <= 3


def test_summaries_merge(spark):
    """Merged parts are the whole, and the bound holds in every dimension."""
    import random

    from provgraph.operators import drift as D

    r = random.Random(22)
    sample = lambda n, mean: [([r.gauss(mean, 1), r.choice([0.0, 5.0]), r.random() ** 4 * 50],) for _ in range(n)]
    reference, current = (spark.createDataFrame(x, "vec array<double>") for x in (sample(2000, 0), sample(700, 0.4)))
    edges = D.bin_edges(reference, 32)
    assert all(x.edges == sorted(set(x.edges)) and len(x.edges) <= 2 * 32 + 2 * 24 + 1 for x in edges.collect()) and D.bin_edges(reference.limit(0)).count() == 0
    whole, halves = D.summary(current, edges), [D.summary(current.where(f"vec[0] {op} 0.3"), edges) for op in ("<", ">=")]
    exactly = lambda df: sorted((x.dim, x.bin, x.n, round(x.total, 6), x.low, x.high) for x in df.collect())
    assert exactly(D.merged_summaries(*halves)) == exactly(whole)
    exact = {x.dim: x.distance for x in M.sliced_wasserstein(current, reference).collect()}
    for x in D.summary_distance(whole, D.summary(reference, edges)).collect():
        assert abs(x.distance - exact[x.dim]) <= x.bound + 1e-6 and x.bound < 0.9


def test_state_expires(parts):
    """A key without rows for longer than ``idle`` loses its state and starts anew; one with rows in every batch keeps it."""
    from datetime import timedelta

    steps = [(k, i, 1, 0, 0) for i, k in enumerate(["kept", "gone"] * 3)]
    later = [[("kept", 10 + b, 1, 0, 0)] for b in range(3)]
    stream, _ = parts("idle", "run_id string, step int, tp int, fp int, fn int", steps, *later, [("kept", 20, 1, 0, 0), ("gone", 20, 1, 0, 0)])
    got = {(x.run_id, x.step): x.tp for x in _run(X.stream_rolling_confusion(stream, 20, timedelta(milliseconds=1)), "x2idle").collect()}
    assert got["gone", 20] == 1 and got["gone", 5] == 3
    stream, _ = parts("idle2", "run_id string, step int, tp int, fp int, fn int", steps, *later, [("kept", 20, 1, 0, 0), ("gone", 20, 1, 0, 0)])
    got = {(x.run_id, x.step): x.tp for x in _run(X.stream_rolling_confusion(stream, 20), "x2kept").collect()}
    assert got["gone", 20] == 4 and got["kept", 20] == 7
    edges = [[("a", i) for i in range(10)] + [("b", 1)], [("b", 2)], [("b", 3)], [("a", 99), ("b", 4)]]
    stream, _ = parts("graphs", "graph_id string, edge_id int", *edges)
    got = [(x.graph_id, x.live) for x in _run(X.stream_bounded_graph(stream, idle=timedelta(milliseconds=1)), "x5idle", "update").collect()]
    assert ("a", 10) in got and ("a", 1) in got


def test_bounded_graph(parts):
    batches = [[("g", i) for i in range(90)], [("g", i) for i in range(90, 130)] + [("h", 1)], [("g", 500)]]
    stream, _ = parts("edges", "graph_id string, edge_id int", *batches)
    got = _run(X.stream_bounded_graph(stream, 100, 0.3, 20), "x5", "update").collect()
    live, expected = {}, []
    for rows in batches:
        for g in {g for g, _ in rows}:
            every = live.get(g, []) + [e for k, e in rows if k == g]
            stay = max(20, int(len(every) * 0.3)) if len(every) > 100 else len(every)
            live[g] = sorted(every)[-stay:]
            expected.append((g, tuple(live[g])))
    assert sorted((r.graph_id, tuple(r.edge_ids)) for r in got) == sorted(expected) and F is not None
