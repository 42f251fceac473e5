"""Event graphs on Structured Streaming: the batch operators over arriving data, with the same results.

State is kept by key and bounded; sinks are idempotent by batch id, so a batch that runs again after a loss changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from provgraph.operators.drift import bin_edges, merged_summaries, summary, summary_distance
from provgraph.operators.evaluate import metric_columns
from provgraph.operators.joins import attach_node_types
from provgraph.operators.monitor import hard_samples
from provgraph.session import remove
from provgraph.sources.readers import cdm_events, cdm_records

STORE = "spark.sql.streaming.stateStore.providerClass"


def stream_edges(spark: SparkSession, path: str, nodes: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """Typed edges (src, dst, action, ts, actor_type, object) of audit-log files as they arrive in a folder; types from a static node table (uuid, type, pos)."""
    reader = spark.readStream if files_per_batch is None else spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    lines = reader.text(path).select("value", F.col("_metadata.file_path").alias("pos"))
    return attach_node_types(cdm_events(cdm_records(lines)).drop("pos"), nodes)


def _keyed_state(stream: DataFrame) -> None:
    """State of one's own types and timers need the RocksDB store; it is set where the session still has the default one.

    Spark runs batches without data as long as there may be timers, so a query with the ``availableNow`` trigger only ends if
    ``spark.sql.streaming.noDataMicroBatches.enabled`` is false; then timers are looked at in batches with data.
    """
    conf = stream.sparkSession.conf
    if "HDFSBackedStateStoreProvider" in conf.get(STORE, "HDFSBackedStateStoreProvider"):
        conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Expiring(StatefulProcessor):
    """A processor whose state of a key goes once the key has had no row for ``idle_ms`` of processing time."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def touch(self, timers: TimerValues) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


class _RollingCounts(_Expiring):
    """The last n - 1 counts of a run as a list; each step of a batch comes out with the sums over its last n."""

    FIELDS = ["tp", "fp", "fn"]

    def __init__(self, n: int, idle_ms: int):
        super().__init__(idle_ms)
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getListState("last", ", ".join(f"{c} bigint" for c in self.FIELDS))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        fields = self.FIELDS
        before = pd.DataFrame([list(x) for x in self.state.get()], columns=fields) if self.state.exists() else pd.DataFrame(columns=fields)
        new = pd.concat(list(rows)).sort_values("step", kind="stable")
        every = pd.concat([before, new[fields].fillna(0)], ignore_index=True).astype("int64")
        sums = every.rolling(self.n, min_periods=1).sum().astype("int64").iloc[len(before) :].reset_index(drop=True)
        size = every["tp"].rolling(self.n, min_periods=1).count().astype("int64").iloc[len(before) :].reset_index(drop=True)
        if self.n > 1:
            self.state.put([tuple(x) for x in every.tail(self.n - 1).to_numpy().tolist()])
        self.touch(timerValues)
        yield sums.assign(run_id=key[0], step=new["step"].to_numpy(), tn=size - sums.sum(axis=1))[["run_id", "step", *fields, "tn"]]


def stream_rolling_confusion(stream: DataFrame, n: int = 20, idle: timedelta = timedelta(days=7)) -> DataFrame:
    """``rolling_confusion`` and the miss rate of arriving steps (run_id, step, tp, fp, fn).

    The state of a run is the typed list of its last n - 1 steps; a run that has been ``idle`` for so long of processing time loses it, and starts anew
    if it comes again. Steps of a batch are put in order; one that comes later than its successors
    counts where it arrives. Null counts are 0.
    """
    kinds = dict(stream.dtypes)
    _keyed_state(stream)
    out = f"run_id {kinds['run_id']}, step {kinds['step']}, tp bigint, fp bigint, fn bigint, tn bigint"
    rows = stream.select("run_id", "step", *_RollingCounts.FIELDS).groupBy("run_id").transformWithStateInPandas(_RollingCounts(n, _millis(idle)), out, "append", "ProcessingTime")
    metrics = {k: F.round(v, 6) for k, v in metric_columns("zero").items() if k != "fn_rate"}
    return rows.withColumns(metrics).withColumn("miss_rate", F.round(F.col("fn") / (F.col("fn") + F.col("tp") + 1e-9), 6))


def _millis(span: timedelta) -> int:
    return max(1, int(span.total_seconds() * 1000))


def _latest(spark: SparkSession, path: str, before: int) -> tuple[int | None, DataFrame | None]:
    """The newest table under ``path`` of a batch earlier than ``before``."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(at) if x.getPath().getName().startswith("batch=")] if fs.exists(at) else []
    found = [b for b in found if b < before]
    return (max(found), spark.read.parquet(f"{path}/batch={max(found)}")) if found else (None, None)


def read_hard_samples(spark: SparkSession, path: str) -> DataFrame | None:
    """The buffer that ``stream_hard_samples`` keeps; None before the first batch."""
    return _latest(spark, path, 1 << 62)[1]


def stream_hard_samples(stream: DataFrame, path: str, checkpoint: str, k: int = 500) -> StreamingQuery:
    """Keeps the k hardest missed positives of arriving scores (sample_id, label, prob) under ``path``: after each batch the top k of the last table and the batch, as one table a batch.

    A batch that runs again reads the same table before it and writes the same one; tables before the last two are removed.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last, held = _latest(spark, path, batch_id)
        own = batch.select("sample_id", "label", "prob")
        rows = own if held is None else held.unionByName(own)
        top = hard_samples(rows.distinct(), k)
        rows.distinct().join(top.select("sample_id").hint("merge"), "sample_id", "left_semi").where("label = 1 and prob < 0.5").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        older = None if last is None else _latest(spark, path, last)[0]
        if older is not None:
            remove(spark, f"{path}/batch={older}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_drift(stream: DataFrame, reference: DataFrame, path: str, checkpoint: str, tau: float = 0.5, bins: int = 64) -> StreamingQuery:
    """(batch, n, distance, bound, drifted, so_far_n, so_far) under ``path/result``: each batch of vectors (vec), and all that came so far, against a fixed reference.

    The reference is read once, for its bins and its summary, which are kept under ``path`` and found there after a restart; a batch is
    summed up by the same bins and added to the summary of all before it. So the state is at most a row a bin, and
    no batch reads the reference or an earlier batch. ``distance`` is that of ``sliced_wasserstein``, as mean over dimensions, to within
    ``bound``. A batch that runs again writes the same tables; summaries before the last two are removed. An empty batch writes nothing.
    """
    spark = stream.sparkSession
    edges_path, reference_path = f"{path}/edges", f"{path}/reference"
    if not _exists(spark, f"{reference_path}/_SUCCESS"):
        bin_edges(reference, bins).write.mode("overwrite").parquet(edges_path)
        summary(reference, spark.read.parquet(edges_path)).write.mode("overwrite").parquet(reference_path)
    edges, held = spark.read.parquet(edges_path), spark.read.parquet(reference_path)

    def measure(batch: DataFrame, batch_id: int) -> None:
        own = batch.select("vec").where("vec is not null").persist()
        n = own.count()
        if n:
            last, before = _latest(batch.sparkSession, f"{path}/so_far", batch_id)
            part = summary(own, edges).persist()
            whole = part.withColumn("_vectors", F.lit(n).cast("bigint")) if before is None else merged_summaries(part, before.drop("_vectors")).crossJoin(F.broadcast(before.agg((F.max("_vectors") + n).alias("_vectors"))))
            whole.write.mode("overwrite").parquet(f"{path}/so_far/batch={batch_id}")
            every = batch.sparkSession.read.parquet(f"{path}/so_far/batch={batch_id}")
            one = summary_distance(part, held).agg(F.round(F.avg("distance"), 6).alias("distance"), F.round(F.avg("bound"), 6).alias("bound"))
            all_of = summary_distance(every.drop("_vectors"), held).agg(F.round(F.avg("distance"), 6).alias("so_far"))
            told = one.crossJoin(F.broadcast(all_of)).crossJoin(F.broadcast(every.agg(F.max("_vectors").alias("so_far_n"))))
            told.select(F.lit(n).cast("bigint").alias("n"), "distance", "bound", (F.col("distance") > tau).alias("drifted"), "so_far_n", "so_far").write.mode("overwrite").parquet(f"{path}/result/batch={batch_id}")
            older = None if last is None else _latest(batch.sparkSession, f"{path}/so_far", last)[0]
            if older is not None:
                remove(batch.sparkSession, f"{path}/so_far/batch={older}")
            part.unpersist()
        own.unpersist()

    return stream.writeStream.foreachBatch(measure).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


class _BoundedGraph(_Expiring):
    """The ids of a graph's live edges as a list."""

    def __init__(self, trigger: int, ratio: float, floor: int, cap: int, idle_ms: int):
        super().__init__(idle_ms)
        self.trigger, self.ratio, self.floor, self.cap, self.most = trigger, ratio, floor, cap, max(trigger, cap)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getListState("live", "edge_id bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        held = [x[0] for x in self.state.get()] if self.state.exists() else []
        live, added = pd.Series(held, dtype="int64"), 0
        for batch in rows:
            added += len(batch)
            live = pd.concat([live, batch["edge_id"]]).nlargest(self.most)
        total = len(held) + added
        stay = max(self.floor, int(total * self.ratio)) if total > self.trigger else total
        kept = sorted(live.nlargest(min(stay, self.cap)).tolist())
        self.state.put([(x,) for x in kept])
        self.touch(timerValues)
        yield pd.DataFrame({"graph_id": [key[0]], "added": [added], "live": [len(kept)], "reduced": [len(kept) < total], "edge_ids": [kept]})


def stream_bounded_graph(stream: DataFrame, trigger: int = 100, ratio: float = 0.3, floor: int = 50, cap: int = 1000, idle: timedelta = timedelta(days=7)) -> DataFrame:
    """(graph_id, added, live, reduced, edge_ids) after each batch of edges (graph_id, edge_id): the graph that stays small.

    New edges join a graph's live ones; above ``trigger`` edges only the newest max(floor, E * ratio) stay, and never more
    than ``cap``. The newest are those of the largest edge_id, as in ``compress_recent``. State is a typed list of at most max(trigger, cap)
    ids a graph, gone once the graph has been ``idle`` for so long; of a batch's edges, too, only the newest ``cap`` are held at a time.
    """
    _keyed_state(stream)
    out = f"graph_id {dict(stream.dtypes)['graph_id']}, added bigint, live bigint, reduced boolean, edge_ids array<bigint>"
    return stream.select("graph_id", F.col("edge_id").cast("bigint").alias("edge_id")).groupBy("graph_id").transformWithStateInPandas(_BoundedGraph(trigger, ratio, floor, cap, _millis(idle)), out, "update", "ProcessingTime")
