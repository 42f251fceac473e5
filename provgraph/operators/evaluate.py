"""Scores, confusion, AUC, drift and vector aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provgraph.operators.nearest import near_best
from provgraph.operators.ranking import running_totals


def threshold_predict(scores: DataFrame, threshold: float = 0.5, prob: str = "prob") -> DataFrame:
    """Scores with ``pred``; a null score is skipped (null)."""
    return scores.withColumn("pred", F.when(F.col(prob).isNotNull(), (F.col(prob) >= threshold).cast("int")))


def confusion(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., tp, fp, fn, tn, n, n_skipped) of label and pred."""
    hit = lambda label, pred: F.count_if((F.col("label") == label) & (F.col("pred") == pred))
    return scores.groupBy(*by).agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), hit(0, 0).alias("tn"), F.count("pred").alias("n"), F.count_if(F.col("pred").isNull()).alias("n_skipped"))


def metric_columns(mode: str = "eps") -> dict[str, Column]:
    """precision, recall, f1, accuracy, fn_rate of tp, fp, fn, tn; ``eps`` adds 1e-9 below, ``zero`` gives 0 for nothing."""
    div = (lambda a, b: a / (b + 1e-9)) if mode == "eps" else (lambda a, b: F.when(b > 0, a / b).otherwise(0.0))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    p, r = div(tp, tp + fp), div(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": div(2 * p * r, p + r), "accuracy": div(tp + tn, tp + fp + fn + tn), "fn_rate": div(fn, tp + fn)}


def binary_metrics(counts: DataFrame, mode: str = "eps") -> DataFrame:
    return counts.withColumns({k: F.round(v, 6) for k, v in metric_columns(mode).items()})


def roc_auc(scores: DataFrame, by: Sequence[str] = (), prob: str = "prob") -> DataFrame:
    """(by..., auc): ties count half; null unless both classes are there.

    Rows are first counted by distinct score; the running count over those counts goes by ranges of scores, so neither one
    key nor a whole table without keys is one task.
    """
    groups = scores.where(F.col(prob).isNotNull()).groupBy(*by, prob).agg(F.count_if(F.col("label") == 1).alias("_p"), F.count_if(F.col("label") == 0).alias("_q"))
    below = running_totals(groups, ["_q"], prob, by)
    won = below.withColumn("_w", F.col("_p") * (F.col("before__q") + F.col("_q") / 2)).groupBy(*by).agg(F.sum("_w").alias("_w"), F.sum("_p").alias("_p"), F.sum("_q").alias("_q"))
    return won.select(*by, F.round(F.when((F.col("_p") > 0) & (F.col("_q") > 0), F.col("_w") / (F.col("_p") * F.col("_q"))), 6).alias("auc"))


def recovery_rate(runs: DataFrame) -> DataFrame:
    """(value, n, n_unscored): of the positives that the first run missed, the share not missed by the second; a skipped one counts as recovered."""
    missed = runs.where("label = 1 and pred_base = 0")
    return missed.agg(F.round(1 - F.count_if(F.col("pred_after") == 0) / F.nullif(F.count("*"), F.lit(0)), 6).alias("value"), F.count("*").alias("n"), F.count_if(F.col("pred_after").isNull()).alias("n_unscored"))


def retention(runs: DataFrame) -> DataFrame:
    """(value, n, n_unscored): of what the first run had right, the share that the second has right."""
    right = runs.where("pred_base = label")
    return right.agg(F.round(F.count_if(F.col("pred_after") == F.col("label")) / F.nullif(F.count("*"), F.lit(0)), 6).alias("value"), F.count("*").alias("n"), F.count_if(F.col("pred_after").isNull()).alias("n_unscored"))


def class_report(scores: DataFrame) -> DataFrame:
    """(class, precision, recall, f1, support) of label and pred."""
    sides = scores.where("pred is not null").select(F.explode(F.array(F.struct(F.col("label").cast("int").alias("class"), F.lit(1).alias("l"), (F.col("label") == F.col("pred")).cast("int").alias("t")), F.struct(F.col("pred").alias("class"), F.lit(0).alias("l"), F.lit(0).alias("t")))).alias("s")).select("s.*")
    c = sides.groupBy("class").agg(F.sum("l").alias("support"), F.sum("t").alias("_t"), F.sum(1 - F.col("l")).alias("_p"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = div(F.col("_t"), F.col("_p")), div(F.col("_t"), F.col("support"))
    return c.select("class", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(div(2 * p * r, p + r), 6).alias("f1"), "support")


def class_averages(report: DataFrame) -> DataFrame:
    """(class, precision, recall, f1, support) rows ``accuracy`` (its value in every column), ``macro avg`` and ``weighted avg`` of a ``class_report``; null without rows."""
    total = F.sum("support")
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / F.nullif(total, F.lit(0))
    names = ["precision", "recall", "f1"]
    sums = report.agg(total.alias("support"), weighted("recall").alias("accuracy"), *(F.avg(c).alias(f"m_{c}") for c in names), *(weighted(c).alias(f"w_{c}") for c in names))
    row = lambda name, cells: F.struct(F.lit(name).alias("class"), *(F.round(F.col(cell), 6).alias(c) for c, cell in zip(names, cells)), "support")
    rows = [row("accuracy", ["accuracy"] * 3), row("macro avg", [f"m_{c}" for c in names]), row("weighted avg", [f"w_{c}" for c in names])]
    return sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def confidence_gap(scores: DataFrame, prob: str = "prob") -> DataFrame:
    """(gap): the mean score of label 1 less that of label 0; null where one is absent."""
    return scores.agg(F.round(F.avg(F.when(F.col("label") == 1, F.col(prob))) - F.avg(F.when(F.col("label") == 0, F.col(prob))), 6).alias("gap"))


def class_confidence(scores: DataFrame, prob: str = "prob") -> DataFrame:
    """(label, mean, std, min, max) of the scores by true class; std is the population's."""
    return scores.groupBy("label").agg(*(F.round(f(prob), 6).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))))


def robustness_curve(scores: DataFrame) -> DataFrame:
    """(camo_ratio, mean_prob, missed, n) of the positives by mix-in ratio."""
    return scores.where("label = 1").groupBy("camo_ratio").agg(F.round(F.avg("prob"), 6).alias("mean_prob"), F.count_if(F.col("prob") < 0.5).alias("missed"), F.count("*").alias("n"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def mean_pool(vectors: DataFrame, by: str = "graph_id") -> DataFrame:
    """(by, dim, value): mean of the vectors of a graph, by dimension."""
    return vectors.select(by, F.posexplode("vec").alias("dim", "x")).groupBy(by, "dim").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("value"))


def sliced_wasserstein(current: DataFrame, reference: DataFrame) -> DataFrame:
    """(dim, distance): first Wasserstein distance of two samples (vec) in every dimension; their mean is the drift.

    Values are counted by dimension first; the running shares go by ranges of a dimension's values, so a dimension is many
    tasks. A dimension that one sample lacks has a null distance.
    """
    both = current.select("vec", F.lit(1).alias("_c")).unionByName(reference.select("vec", F.lit(0).alias("_c")))
    values = both.select("_c", F.posexplode("vec").alias("dim", "x")).where("x is not null").groupBy("dim", "x").agg(F.sum("_c").alias("_a"), F.sum(1 - F.col("_c")).alias("_b"))
    total = values.groupBy("dim").agg(F.sum("_a").alias("_na"), F.sum("_b").alias("_nb"))
    run = running_totals(values, ["_a", "_b"], "x", ["dim"]).join(total, "dim")
    share = lambda c, n: (F.col(f"before_{c}") + F.col(c)) / F.nullif(F.col(n), F.lit(0))
    step = F.abs(share("_a", "_na") - share("_b", "_nb")) * (F.col("next_x").cast("double") - F.col("x").cast("double"))
    return run.withColumn("_s", step).groupBy("dim").agg(F.round(F.when((F.max("_na") > 0) & (F.max("_nb") > 0), F.coalesce(F.sum("_s"), F.lit(0.0))), 6).alias("distance"))


def drift_flag(distances: DataFrame, tau: float = 0.5) -> DataFrame:
    """(distance, drifted): the mean over dimensions and whether it is above tau."""
    return distances.agg(F.round(F.avg("distance"), 6).alias("distance")).withColumn("drifted", F.col("distance") > tau)


def top_critical(scores: DataFrame, k: int = 5, by: str = "graph_id", node: str = "node", score: str = "score") -> DataFrame:
    best = Window.partitionBy(by).orderBy(F.desc(score), node)
    return scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(by, node, "rank")


def class_means(features: DataFrame, names: Sequence[str], label: str = "label") -> DataFrame:
    """(feature, mean_0, mean_1)."""
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("x")) for n in names))).alias("f")
    long = features.select(label, pairs).select(label, "f.*")
    return long.groupBy("feature").agg(*(F.round(F.avg(F.when(F.col(label) == i, F.col("x"))), 6).alias(f"mean_{i}") for i in (0, 1)))


def nearest_in_group(items: DataFrame, candidates: DataFrame, k: int = 1, exclude: DataFrame | None = None) -> DataFrame:
    """(id, candidate, sim, rank): the best cosine neighbours of an item with its group; tables (id, vec, grp).

    ``exclude`` (id, candidate) holds pairs that may not be named, such as what a chain has already. All pairs of a group are
    looked at in blocks (``near_best``), a large group by many tasks; only near best ones leave a task, and these meet by item. Ties go to the smaller candidate.
    """
    asked = items.where("id is not null").select("id", F.col("vec").alias("_vec"), "grp", F.col("id").alias("_own"))
    if exclude is not None:
        without = exclude.where("candidate is not null").groupBy(F.col("id").alias("_of")).agg(F.collect_set("candidate").alias("_without"))
        asked = asked.join(without.hint("merge"), F.col("id") == F.col("_of"), "left").drop("_of")
    offered = candidates.where("id is not null").select(F.col("id").alias("candidate"), F.col("vec").alias("_vec"), "grp", F.col("id").alias("_owner"))
    near = near_best(asked, offered, ["grp"], k, ["id"], ["candidate"]).select("id", "candidate", F.round("score", 6).alias("sim"))
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "candidate"))
    return near.withColumn("rank", best).where(F.col("rank") <= k)
