"""Lookups and set joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_node_types(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """Events (src, dst, ...) with actor_type and object: the type of a node's last record (nodes: uuid, type, pos), else process and file."""
    last = nodes.groupBy("uuid").agg(F.max_by("type", "pos").alias("type"))
    end = lambda c, to: last.select(F.col("uuid").alias(c), F.col("type").alias(to))
    joined = events.join(end("src", "_s"), "src", "left").join(end("dst", "_d"), "dst", "left")
    return joined.select(*events.columns, F.coalesce("_s", F.lit("process")).alias("actor_type"), F.coalesce("_d", F.lit("file")).alias("object"))


def mark_malicious_nodes(edges: DataFrame, truth: DataFrame) -> DataFrame:
    """Edges with src_bad and dst_bad: whether an end is in the truth set (uuid)."""
    known = truth.select("uuid").distinct()
    end = lambda c, to: known.select(F.col("uuid").alias(c), F.lit(True).alias(to))
    joined = edges.join(end("actorID", "_s"), "actorID", "left").join(end("objectID", "_d"), "objectID", "left")
    return joined.select(*edges.columns, F.coalesce("_s", F.lit(False)).alias("src_bad"), F.coalesce("_d", F.lit(False)).alias("dst_bad"))


def lookup_with_parent(df: DataFrame, key: str, dim: DataFrame, default: str, value: str = "value") -> DataFrame:
    """``df`` and ``value`` of its key in ``dim`` (key, value), else of the key before its first dot, else of ``default``."""
    own = dim.select(F.col("key").alias("_k1"), F.col(value).alias("_v1"))
    parent = dim.select(F.col("key").alias("_k2"), F.col(value).alias("_v2"))
    generic = dim.where(F.col("key") == default).agg(F.first(value).alias("_v3"))
    joined = df.join(own, F.col(key) == F.col("_k1"), "left").join(parent, F.split_part(key, F.lit("."), F.lit(1)) == F.col("_k2"), "left").crossJoin(F.broadcast(generic))
    return joined.select(*df.columns, F.coalesce("_v1", "_v2", "_v3").alias(value))


def hold_out(samples: DataFrame, col: str, values: Sequence) -> DataFrame:
    return samples.where(~F.coalesce(F.col(col).isin(list(values)), F.lit(False)))


def restrict(samples: DataFrame, col: str, values: Sequence) -> DataFrame:
    return samples.where(F.col(col).isin(list(values)))


def compare_runs(base: DataFrame, after: DataFrame) -> DataFrame:
    """(sample_id, label, pred_base, pred_after) of two score tables (sample_id, label, pred); null where a run skipped the sample."""
    a = after.select("sample_id", F.col("label").alias("_l"), F.col("pred").alias("pred_after"))
    b = base.select("sample_id", F.col("label").alias("_m"), F.col("pred").alias("pred_base"))
    return b.join(a, "sample_id", "full").select("sample_id", F.coalesce("_m", "_l").alias("label"), "pred_base", "pred_after")
