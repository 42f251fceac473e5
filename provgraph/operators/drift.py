"""Drift from summaries: bins of every dimension that add up over batches, with a bound on what they leave out.

A summary is a table (dim, bin, n, total, low, high): how many of a sample's values of a dimension lie in a bin, their sum, least and
greatest. It has at most a row a bin whatever the sample's size, and those of two samples merge by adding up.
Vectors are arrays ``vec``; null vectors and components don't count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provgraph.operators.ranking import running_totals


def bin_edges(reference: DataFrame, bins: int = 64, beyond: int = 24) -> DataFrame:
    """(dim, edges): where the bins of each dimension begin, in order.

    There are at most ``bins`` that hold about equally many of the reference's values, ``bins`` of equal width over its range, and on
    either side of it ``beyond`` that are half as wide as they are far away, for what has drifted there.
    """
    values = reference.select(F.posexplode("vec").alias("dim", "x")).where("x is not null").groupBy("dim", F.col("x").cast("double").alias("x")).agg(F.count("*").alias("n"))
    sizes = values.groupBy(F.col("dim").alias("_dim")).agg(F.sum("n").alias("_all"))
    placed = running_totals(values, ["n"], "x", ["dim"]).join(sizes.hint("merge"), F.col("dim") == F.col("_dim"))
    starts = placed.groupBy("dim", F.floor(F.col("before_n") * bins / F.col("_all")).alias("_bin")).agg(F.min("x").alias("_edge"), F.max("x").alias("_last"))
    low, high = F.col("_low"), F.col("_high")
    step = F.when(high > low, (high - low) / bins).otherwise(F.greatest(F.abs(low), F.lit(1.0)) / bins)
    even = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: low + i * step)
    out = F.sequence(F.lit(0), F.lit(beyond - 1))
    above, below = F.transform(out, lambda k: high + step * F.pow(F.lit(1.5), k)), F.transform(out, lambda k: low - step * F.pow(F.lit(1.5), k))
    ranges = starts.groupBy("dim").agg(F.collect_list("_edge").alias("_quantiles"), F.min("_edge").alias("_low"), F.max("_last").alias("_high"))
    return ranges.select("dim", F.array_sort(F.array_distinct(F.concat("_quantiles", even, above, below))).alias("edges"))


def summary(vectors: DataFrame, edges: DataFrame) -> DataFrame:
    """The summary of a sample's vectors over the bins of ``edges``, a small table of one row a dimension; dimensions without bins are left out."""
    parts = vectors.select(F.posexplode("vec").alias("dim", "x")).where("x is not null").select("dim", F.col("x").cast("double").alias("x"))
    known = edges.select(F.col("dim").alias("_dim"), "edges")
    binned = parts.join(F.broadcast(known), F.col("dim") == F.col("_dim")).select("dim", F.size(F.filter("edges", lambda e: e <= F.col("x"))).alias("bin"), "x")
    return binned.groupBy("dim", "bin").agg(F.count("*").alias("n"), F.sum("x").alias("total"), F.min("x").alias("low"), F.max("x").alias("high"))


def merged_summaries(*parts: DataFrame) -> DataFrame:
    """The summary of all the samples together."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy("dim", "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))


def summary_distance(current: DataFrame, reference: DataFrame) -> DataFrame:
    """(dim, distance, bound): the first Wasserstein distance of two summaries in every dimension that both have, each bin's values put at their mean.

    That of the samples themselves differs by at most ``bound``: within a bin from low to high with mean m, values lie
    2 (high - m) (m - low) / (high - low) or less from m on average, and the distance of two samples changes by no more than both are moved.
    """
    mean = F.col("total") / F.col("n")
    spread = F.when(F.col("high") > F.col("low"), 2 * (F.col("high") - mean) * (mean - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    side = lambda rows, own: rows.select("dim", mean.alias("x"), (F.col("n") * own).alias("_a"), (F.col("n") * (1 - own)).alias("_b"), (F.col("n") * F.greatest(spread, F.lit(0.0))).alias("_off"))
    rows = side(current, F.lit(1)).unionByName(side(reference, F.lit(0)))
    whole = Window.partitionBy("dim")  # at most two rows a bin
    run = whole.orderBy("x", F.desc("_a"), "_b")
    share = lambda c: F.sum(c).over(run.rowsBetween(Window.unboundedPreceding, 0)) / F.nullif(F.sum(c).over(whole), F.lit(0))
    step = F.abs(share("_a") - share("_b")) * (F.lead("x").over(run) - F.col("x"))
    stepped = rows.select("dim", step.alias("_step"), "_a", "_b", "_off")
    off = lambda c: F.sum(F.when(F.col(c) > 0, F.col("_off"))) / F.sum(c)
    return stepped.groupBy("dim").agg(F.sum("_a").alias("_na"), F.sum("_b").alias("_nb"), F.coalesce(F.sum("_step"), F.lit(0.0)).alias("distance"), (off("_a") + off("_b")).alias("bound")).where("_na > 0 and _nb > 0").select("dim", "distance", "bound")
