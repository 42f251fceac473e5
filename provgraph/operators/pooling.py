"""Vectors on graphs: pooling, neighbour means, edge scores, outliers, and classifiers on pooled features.

Vectors of a graph have one length; rows with a null key join nothing, null components are left out of means, and empty
tables give no rows, or a null where a single row is returned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provgraph.operators.evaluate import dot
from provgraph.operators.ranking import exact_quantile, numbered
from provgraph.session import Scratch

LAYERS = {"linear": [], "mlp": [32], "deep": [64, 32]}


def pool_top_nodes(vectors: DataFrame, attention: DataFrame, ratio: float = 0.5, k_min: int = 12) -> DataFrame:
    """(graph_id, dim, value): weighted mean of the k = min(N, max(k_min, ceil(ratio N))) nodes of most attention.

    Vectors are (graph_id, node, vec), attention edges (graph_id, src, weight). A node's weight is the sum over the edges
    that start at it; weights are scaled to 1, and where their sum isn't positive the mean is plain. Ties go by node.
    """
    weight = attention.groupBy("graph_id", F.col("src").alias("node")).agg(F.sum("weight").alias("_w"))
    joined = vectors.join(weight, ["graph_id", "node"], "left").withColumn("_w", F.coalesce("_w", F.lit(0.0)))
    sizes = vectors.groupBy("graph_id").agg(F.count("*").alias("_n"))
    ranked = numbered(joined, [F.desc("_w"), "node"], ["graph_id"], "_r").join(sizes, "graph_id")
    kept = ranked.where(F.col("_r") < F.least("_n", F.greatest(F.lit(k_min), F.ceil(F.col("_n") * ratio))))
    long = kept.select("graph_id", "_w", F.posexplode("vec").alias("dim", "x"))
    total = F.sum("_w")
    mean = F.when(total > 0, F.sum(F.col("_w") * F.col("x").cast("double")) / total).otherwise(F.avg(F.col("x").cast("double")))
    return long.groupBy("graph_id", "dim").agg(F.round(mean, 6).alias("value"))


def aggregate_neighbors(edges: DataFrame, vectors: DataFrame, normalize: bool = False) -> DataFrame:
    """(graph_id, node, vec): a node's vector followed by the mean over its distinct out-neighbours (zeros if none), scaled to length 1 if asked."""
    ends = edges.select("graph_id", F.col("src").alias("node"), F.col("dst").alias("_to")).distinct()
    near = ends.join(vectors.select("graph_id", F.col("node").alias("_to"), F.col("vec").alias("_v")), ["graph_id", "_to"])
    means = near.select("graph_id", "node", F.posexplode("_v").alias("dim", "x")).groupBy("graph_id", "node", "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    packed = means.groupBy("graph_id", "node").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("_m"))
    own = F.transform("vec", lambda x: x.cast("double"))
    both = F.concat(own, F.coalesce("_m", F.transform("vec", lambda x: F.lit(0.0))))
    out = vectors.join(packed.hint("merge"), ["graph_id", "node"], "left").select("graph_id", "node", both.alias("vec"))
    if normalize:
        norm = F.sqrt(dot(F.col("vec"), F.col("vec")))
        out = out.withColumn("_norm", norm).select("graph_id", "node", F.transform("vec", lambda x: x / F.when(F.col("_norm") > 0, F.col("_norm")).otherwise(1.0)).alias("vec"))
    return out


def edge_score(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """Edges (src, dst, ...) with ``score``: the sigmoid of the dot product of their ends' vectors (id, vec)."""
    side = lambda c: vectors.select(F.col("id").alias(c), F.col("vec").alias(f"_{c}"))
    both = edges.join(side("src"), "src").join(side("dst"), "dst")
    return both.select(*edges.columns, F.round(1 / (1 + F.exp(-dot(F.col("_src"), F.col("_dst")))), 6).alias("score"))


def log_loss(scores: DataFrame) -> DataFrame:
    """(loss): mean negative log likelihood of label under score; scores are kept 1e-9 away from 0 and 1."""
    p = F.least(F.greatest(F.col("score"), F.lit(1e-9)), F.lit(1 - 1e-9))
    return scores.agg(F.round(-F.avg(F.when(F.col("label") == 1, F.log(p)).otherwise(F.log(1 - p))), 6).alias("loss"))


def centre_distances(vectors: DataFrame) -> DataFrame:
    """(graph_id, node, x): Euclidean distance of each node's vector (graph_id, node, vec) from the mean vector of its graph, halves up at 9 places."""
    parts = vectors.select("graph_id", F.posexplode("vec").alias("dim", "_x"))
    means = parts.groupBy("graph_id", "dim").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    centre = means.groupBy("graph_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "_m"))), lambda s: s["_m"]).alias("_c"))
    off = F.zip_with("vec", "_c", lambda x, m: x.cast("double") - m)
    return vectors.join(centre, "graph_id").select("graph_id", "node", F.round(F.sqrt(dot(off, off)), 9).alias("x"))


def anomaly_ratio(values: DataFrame, z: float = 3.5) -> DataFrame:
    """(graph_id, ratio): share of a graph's values that are outliers by the robust z-score 0.6745 |x - median| / MAD.

    Values are (graph_id, x), say the distance of a node's vector from the graph's mean. Without spread nothing is an outlier.
    Both medians are exact and found by ranks over ranges, so a large graph's values never meet in one task.
    """
    scratch = Scratch(values.sparkSession)
    held = scratch.table(values.select("graph_id", "x"))
    middle = scratch.table(exact_quantile(held, "x", 0.5, ["graph_id"], "_med"))
    off = scratch.table(held.join(middle, "graph_id").select("graph_id", F.abs(F.col("x") - F.col("_med")).alias("_d")))
    spread = scratch.table(exact_quantile(off, "_d", 0.5, ["graph_id"], "_mad"))
    score = F.when(F.col("_mad") > 0, 0.6745 * F.col("_d") / F.col("_mad")).otherwise(0.0)
    result = scratch.table(off.join(spread, "graph_id").groupBy("graph_id").agg(F.round(F.avg((score > z).cast("int")), 6).alias("ratio")))
    scratch.drop_others(result)
    return result


def metric_deltas(base: DataFrame, after: DataFrame, names: Sequence[str] = ("f1", "recall", "fn_rate"), by: str = "grp") -> DataFrame:
    """(by, d_name...): the second run's metrics less the first's."""
    b = after.select(by, *(F.col(n).alias(f"_{n}") for n in names))
    return base.join(b, by).select(by, *(F.round(F.col(f"_{n}") - F.col(n), 6).alias(f"d_{n}") for n in names))


def latency_stats(log: DataFrame) -> DataFrame:
    """(mean_ms, n) over the scored rows of (latency_ms, pred)."""
    scored = log.where("pred is not null")
    return scored.agg(F.round(F.avg("latency_ms"), 6).alias("mean_ms"), F.count("*").alias("n"))


def _assembled(df: DataFrame, names: Sequence[str]) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.withColumn("features", array_to_vector(F.array(*(F.col(n).cast("double") for n in names))))


def fit_classifier(train: DataFrame, names: Sequence[str], head: str = "linear", weight: str | None = None, seed: int = 0):
    """A model of ``label`` on the named columns: logistic regression for ``linear``, else a perceptron with the head's layers."""
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier

    rows = _assembled(train, names)
    if head == "linear":
        return LogisticRegression(maxIter=50, regParam=1e-3, weightCol=weight).fit(rows) if weight else LogisticRegression(maxIter=50, regParam=1e-3).fit(rows)
    return MultilayerPerceptronClassifier(layers=[len(names), *LAYERS[head], 2], maxIter=50, seed=seed).fit(rows)


def score_graphs(model, df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` with ``prob``, the model's probability of label 1."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(_assembled(df, names))
    return scored.select(*df.columns, vector_to_array("probability")[1].alias("prob"))


def leakage_probe(features: DataFrame, sets: dict[str, Sequence[str]], folds: int = 5, leak: float = 0.70, behaviour: float = 0.85) -> DataFrame:
    """(feature_set, auc, verdict): cross-validated AUC of a balanced logistic regression on each named set of columns.

    Features are (sample_id, label, columns). Columns are scaled once over all rows; folds go by md5 of the id within a label.
    ``leak`` for surface sets above that bound, ``behaviour`` for others above theirs, else ``clean``.
    """
    from provgraph.operators.evaluate import roc_auc

    columns = list(dict.fromkeys(c for names in sets.values() for c in names))
    stats = features.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns), F.count_if(F.col("label") == 1).alias("_p"), F.count("*").alias("_n"))
    scaled = features.crossJoin(F.broadcast(stats)).select(
        "sample_id", "label", *(((F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)).alias(c) for c in columns),
        (F.col("_n") / (2 * F.when(F.col("label") == 1, F.col("_p")).otherwise(F.col("_n") - F.col("_p")))).alias("_weight"),
        (F.conv(F.substring(F.md5(F.col("sample_id").cast("string")), 1, 8), 16, 10).cast("bigint") % folds).cast("int").alias("_fold"),
    )
    out = None
    for name, names in sets.items():
        held = None
        for fold in range(folds):
            model = fit_classifier(scaled.where(F.col("_fold") != fold), names, weight="_weight")
            part = score_graphs(model, scaled.where(F.col("_fold") == fold), names).select("label", "prob", "_fold")
            held = part if held is None else held.unionByName(part)
        bound, word = (leak, "leak") if name == "surface" else (behaviour, "behaviour")
        row = roc_auc(held, ["_fold"]).agg(F.round(F.avg("auc"), 6).alias("auc")).select(F.lit(name).alias("feature_set"), "auc", F.when(F.col("auc") > bound, word).otherwise("clean").alias("verdict"))
        out = row if out is None else out.unionByName(row)
    return out
