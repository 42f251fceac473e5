"""Ordered windows per run: rolling confusion, convergence, plateaus, stops. Columns: run_id, step and metrics.

Steps of a run are distinct; a null metric takes no part in means and deviations and meets no bound. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provgraph.operators.evaluate import metric_columns

def _run():
    return Window.partitionBy("run_id").orderBy("step")


def _last(n: int):
    return _run().rowsBetween(1 - n, 0)


def rolling_confusion(steps: DataFrame, n: int = 20) -> DataFrame:
    """Steps with tp, fp, fn of the last n steps, tn as the rest, and the metrics of those."""
    w = _last(n)
    sums = steps.select("run_id", "step", *(F.sum(c).over(w).alias(c) for c in ("tp", "fp", "fn")), F.count("*").over(w).alias("_n"))
    counts = sums.withColumn("tn", F.col("_n") - F.col("tp") - F.col("fp") - F.col("fn")).drop("_n")
    return counts.withColumns({k: F.round(v, 6) for k, v in metric_columns("zero").items() if k != "fn_rate"})


def rolling_miss_rate(steps: DataFrame, n: int = 20) -> DataFrame:
    w = _last(n)
    return steps.select("run_id", "step", F.round(F.sum("fn").over(w) / (F.sum("fn").over(w) + F.sum("tp").over(w) + 1e-9), 6).alias("miss_rate"))


def converged_flag(n: int = 12, f1: float = 0.75, std: float = 0.04, miss: float = 0.20) -> Column:
    w = _last(n)
    return (F.count("*").over(w) == n) & (F.avg("f1").over(w) >= f1) & (F.round(F.stddev_samp("miss_rate").over(w), 9) < std) & (F.avg("miss_rate").over(w) < miss)


def converged(steps: DataFrame, n: int = 12, f1: float = 0.75, std: float = 0.04, miss: float = 0.20) -> DataFrame:
    """Steps with ``flag``: over n steps mean F1 high, sample deviation of the miss rate low, and its mean low."""
    return steps.select("run_id", "step", F.coalesce(converged_flag(n, f1, std, miss), F.lit(False)).alias("flag"))


def running_best(steps: DataFrame) -> DataFrame:
    """(run_id, step, best_f1, best_miss_rate, best_combined, is_new_best) so far."""
    before = F.max("combined").over(_run().rowsBetween(Window.unboundedPreceding, -1))
    up = _run().rowsBetween(Window.unboundedPreceding, 0)
    return steps.select("run_id", "step", F.max("f1").over(up).alias("best_f1"), F.min("miss_rate").over(up).alias("best_miss_rate"), F.max("combined").over(up).alias("best_combined"), (before.isNull() | (F.col("combined") > before)).alias("is_new_best"))


def _plateau_flag(is_new: Column, n: int = 15, std: float = 0.10) -> Column:
    """Over rows with ``_at``, the running number of a step."""
    since = F.col("_at") - F.max(F.when(is_new, F.col("_at"))).over(_run().rowsBetween(Window.unboundedPreceding, 0))
    flat = (F.count("*").over(_last(n)) == n) & (F.round(F.stddev_samp("reward").over(_last(n)), 9) < std)
    return flat & (since >= n)


def plateau(steps: DataFrame, n: int = 15, std: float = 0.10) -> DataFrame:
    """Steps with ``flag``: reward deviation below ``std`` over n steps, and n steps or more without a new best combined score."""
    before = F.max("combined").over(_run().rowsBetween(Window.unboundedPreceding, -1))
    placed = steps.withColumns({"_at": F.row_number().over(_run()), "_new": before.isNull() | (F.col("combined") > before)})
    return placed.select("run_id", "step", F.coalesce(_plateau_flag(F.col("_new"), n, std), F.lit(False)).alias("flag"))


def run_length(condition: Column) -> Column:
    """How many steps in a row, up to this one, meet a condition (columns run_id, step)."""
    up = _run().rowsBetween(Window.unboundedPreceding, 0)
    return F.count("*").over(up) - F.coalesce(F.max(F.when(~condition, F.col("_at"))).over(up), F.lit(0))


def _degraded_flag(miss: float = 0.80, n: int = 15, low_f1: float = 0.05, m: int = 20) -> Column:
    bad = run_length(F.col("miss_rate") > miss) >= n
    return bad | (run_length((F.col("f1") < low_f1) & (F.col("_at") > m)) >= m)


def degraded(steps: DataFrame, miss: float = 0.80, n: int = 15, low_f1: float = 0.05, m: int = 20) -> DataFrame:
    """Steps with ``flag``: miss rate above ``miss`` for n steps in a row, or F1 below ``low_f1`` for m in a row counted after step m."""
    return steps.withColumn("_at", F.row_number().over(_run())).select("run_id", "step", _degraded_flag(miss, n, low_f1, m).alias("flag"))


def stop_status(steps: DataFrame) -> DataFrame:
    """(run_id, step, reason): the first step that stops a run; FAILURE before CONVERGED before PLATEAU.

    All flags are windows over one ordering of the runs, so the steps are shuffled once and nothing is joined.
    """
    before = F.max("combined").over(_run().rowsBetween(Window.unboundedPreceding, -1))
    placed = steps.withColumns({"_at": F.row_number().over(_run()), "_new": before.isNull() | (F.col("combined") > before)})
    flagged = placed.withColumns({"_d": _degraded_flag(), "_c": F.coalesce(converged_flag(), F.lit(False)), "_p": F.coalesce(_plateau_flag(F.col("_new")), F.lit(False))})
    reason = F.when(F.col("_d"), "FAILURE").when(F.col("_c"), "CONVERGED").when(F.col("_p"), "PLATEAU")
    return flagged.withColumn("reason", reason).where("reason is not null").groupBy("run_id").agg(F.min_by("reason", "step").alias("reason"), F.min("step").alias("step"))


def episode_summary(steps: DataFrame) -> DataFrame:
    """(run_id, episode, calls, misses, miss_rate, mean_f1, mean_reward, detection, total_tp, total_fp): ``detection`` is precision + recall - 2 misses, of the episode's counts, + its mean reward."""
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rows = steps.groupBy("run_id", "episode").agg(F.count("*").alias("calls"), fn.alias("misses"), F.round(fn / (fn + tp + 1e-9), 6).alias("miss_rate"), F.round(F.avg("f1"), 6).alias("mean_f1"), F.avg("reward").alias("_r"), tp.alias("total_tp"), fp.alias("total_fp"))
    score = share(F.col("total_tp"), F.col("total_tp") + F.col("total_fp")) + share(F.col("total_tp"), F.col("total_tp") + F.col("misses")) - 2 * F.col("misses") + F.col("_r")
    return rows.withColumns({"mean_reward": F.round("_r", 6), "detection": F.round(score, 6)}).drop("_r")


def arm_posteriors(outcomes: DataFrame) -> DataFrame:
    """(arm, alpha, beta, mean) of outcomes (arm, success): one and the successes, one and the failures."""
    c = outcomes.groupBy("arm").agg((1 + F.count_if(F.col("success") == 1)).alias("alpha"), (1 + F.count_if(F.col("success") == 0)).alias("beta"))
    return c.withColumn("mean", F.round(F.col("alpha") / (F.col("alpha") + F.col("beta")), 6))


def hard_samples(scores: DataFrame, k: int = 500) -> DataFrame:
    """(sample_id, priority, rank): missed positives by 1 - 2 |p - 0.5| downwards, older first, the first k. A distributed top-k, then ranks of k rows."""
    missed = scores.where("label = 1 and prob < 0.5").select("sample_id", F.round(1 - 2 * F.abs(F.col("prob") - 0.5), 6).alias("priority"))
    top = missed.orderBy(F.desc("priority"), "sample_id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("priority"), "sample_id")))


def f1_curves(series: DataFrame, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """curves (run_id, episode, f1) of the runs whose name starts with ``prefix``, episodes numbered from 1, and (run_id, last_f1)."""
    name = F.element_at(F.split("run_id", "/"), -1)
    rows = series.where(F.startswith(name, F.lit(prefix))).where("f1 is not null")
    curve = rows.select("run_id", F.row_number().over(Window.partitionBy("run_id").orderBy("episode")).alias("episode"), "f1")
    return curve, rows.groupBy("run_id").agg(F.max_by("f1", "episode").alias("last_f1"))
