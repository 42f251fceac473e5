"""Consolidation of result records over seeds and conditions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def melt_metrics(results: DataFrame) -> DataFrame:
    """(rq, condition, seed, metric, value) of a map column ``metrics``."""
    return results.select("rq", "condition", "seed", F.explode("metrics").alias("metric", "value"))


def seed_summary(long: DataFrame) -> DataFrame:
    """(rq, condition, metric, mean, std, n_seeds): population deviation, nulls left out."""
    return long.where("value is not null").groupBy("rq", "condition", "metric").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), F.count("*").alias("n_seeds"))


def pivot_summary(summary: DataFrame, metrics: Sequence[str], condition_order: Sequence[str] = ()) -> DataFrame:
    """(rq, condition, place, one column a metric): ``place`` orders conditions as listed, others after them."""
    wide = summary.groupBy("rq", "condition").pivot("metric", list(metrics)).agg(F.first("mean"))
    place = F.array_position(F.array(*map(F.lit, condition_order)) if condition_order else F.array().cast("array<string>"), F.col("condition"))
    return wide.withColumn("place", F.when(place > 0, place).otherwise(F.lit(999)).cast("int"))


def corpus_counts(samples: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Counts by every prefix of ``dims`` (a rollup)."""
    return samples.rollup(*dims).agg(F.count("*").alias("n"))


def pick_checkpoint_record(artifacts: DataFrame) -> DataFrame:
    """(run_id, path, kind): a run's best record, else its final one."""
    rank = F.when(F.col("kind") == "best", 0).when(F.col("kind") == "final", 1)
    return artifacts.where(rank.isNotNull()).groupBy("run_id").agg(F.min_by("path", F.struct(rank.alias("r"), "path")).alias("path"), F.min_by("kind", F.struct(rank.alias("r"), "path")).alias("kind"))
