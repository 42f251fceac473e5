"""Deterministic sampling and corpora: every draw orders by md5 of seed and key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provgraph.operators.ranking import numbered


def draw(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def uniform(seed: int, *keys: str) -> Column:
    """A number in (0, 1) from the first eight hex digits of the draw."""
    return (F.conv(F.substring(draw(seed, *keys), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def sample_edges(edges: DataFrame, rate: float, seed: int = 0) -> DataFrame:
    """max(1, floor(E * rate)) edges of every graph, without replacement."""
    sizes = edges.groupBy(F.col("graph_id").alias("_of")).agg(F.count("*").alias("_e"))
    ranked = numbered(edges.withColumn("_draw", draw(seed, "edge_id")), ["_draw", "edge_id"], ["graph_id"], "_r").join(sizes, F.col("graph_id").eqNullSafe(F.col("_of")))
    return ranked.where(F.col("_r") < F.greatest(F.lit(1), F.floor(F.col("_e") * rate))).select(edges.columns)


def drawn_number(seed: int, *keys: str) -> Column:
    """The first eight hex digits of the draw as a number."""
    return F.conv(F.substring(draw(seed, *keys), 1, 8), 16, 10).cast("bigint")


def sample_weighted(df: DataFrame, by: str, key: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """n rows a group without replacement, with chances by weight: the largest of ln(u) / weight.

    Rows of weight 0 or null are never drawn, unless a group has no other: then all its rows weigh the same.
    """
    heaviest = df.groupBy(F.col(by).alias("_by")).agg(F.coalesce(F.max(weight), F.lit(0)).alias("_most"))
    weighed = df.join(heaviest.hint("merge"), F.col(by).eqNullSafe(F.col("_by"))).withColumn("_w", F.when(F.col("_most") > 0, F.col(weight)).otherwise(1.0))
    score = F.round(F.log(uniform(seed, key)) / F.col("_w"), 9)
    best = Window.partitionBy(by).orderBy(F.desc(score), key)
    return weighed.where("_w > 0").withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= n).select(df.columns)


def oversample(samples: DataFrame, label: str = "label", key: str = "sample_id", how: str = "cyclic", seed: int = 0) -> DataFrame:
    """Samples with ``copy``, each class repeated up to the size of the largest.

    ``cyclic`` repeats a class in key order; ``random`` keeps every row once (copy 0) and adds draws with replacement, numbered from 1.
    """
    sizes = samples.groupBy(label).agg(F.count("*").alias("_n"))
    most = sizes.agg(F.max("_n").alias("_most"))
    each = sizes.crossJoin(F.broadcast(most)).withColumnRenamed(label, "_label")
    placed = numbered(samples, [key], [label], "_at")
    if how == "cyclic":
        joined = placed.join(each.hint("merge"), F.col(label).eqNullSafe(F.col("_label")))
        copies = joined.withColumn("copy", F.explode(F.sequence(F.lit(0), F.ceil(F.col("_most") / F.col("_n")).cast("int") - 1)))
        return copies.where(F.col("copy") * F.col("_n") + F.col("_at") < F.col("_most")).select(*samples.columns, "copy")
    slots = each.where("_most > _n").withColumn("_slot", F.explode(F.sequence(F.lit(1), (F.col("_most") - F.col("_n")).cast("int"))))
    picked = slots.select(F.col("_label"), F.col("_slot").alias("copy"), (drawn_number(seed, "_label", "_slot") % F.col("_n")).alias("_pick"))
    extra = placed.join(picked.hint("merge"), F.col(label).eqNullSafe(F.col("_label")) & (F.col("_at") == F.col("_pick"))).select(*samples.columns, "copy")
    return samples.withColumn("copy", F.lit(0)).unionByName(extra)


def class_weights(samples: DataFrame, cap: float = 3.0, boost: float | None = None) -> DataFrame:
    """(label, weight): 1 for negatives; min(n_neg / n_pos, cap) for positives, or with ``boost`` (n_neg / n_pos) * boost. Without positives their weight is null."""
    n = samples.agg(F.count_if(F.col("label") == 0).alias("_q"), F.count_if(F.col("label") == 1).alias("_p"))
    share = F.col("_q") / F.nullif(F.col("_p"), F.lit(0))
    weight = F.when(share.isNotNull(), F.least(share, F.lit(cap))) if boost is None else share * boost
    rows = F.explode(F.array(F.struct(F.lit(0).alias("label"), F.lit(1.0).alias("weight")), F.struct(F.lit(1).alias("label"), F.round(weight, 6).alias("weight")))).alias("r")
    return n.select(rows).select("r.*")


def pair_negatives(pos: DataFrame, neg: DataFrame, seed: int = 0) -> DataFrame:
    """(pos_id, neg_id): one negative for each positive, with replacement, by the draw modulo their number (tables of sample_id)."""
    indexed = numbered(neg.select(F.col("sample_id").alias("neg_id")), ["neg_id"], name="_i")
    n = neg.agg(F.count("*").alias("_n"))
    drawn = pos.select(F.col("sample_id").alias("pos_id"), drawn_number(seed, "sample_id").alias("_d")).crossJoin(F.broadcast(n))
    return drawn.withColumn("_i", F.col("_d") % F.nullif(F.col("_n"), F.lit(0))).join(indexed.hint("merge"), "_i").select("pos_id", "neg_id")


def split_groups(samples: DataFrame, group: str, share: float = 2 / 3, seed: int = 0) -> DataFrame:
    """Samples with ``split``: whole groups go to train or test, in the order of the draw."""
    groups = samples.select(group).distinct()
    ranked = numbered(groups.withColumn("_draw", draw(seed, group)), ["_draw", group], name="_r")
    n = ranked.agg(F.count("*").alias("_n"))
    split = ranked.crossJoin(F.broadcast(n)).select(group, F.when(F.col("_r") < F.floor(F.col("_n") * share), "train").otherwise("test").alias("split"))
    return samples.join(split.hint("merge"), group)


def mix_in_noise(edges: DataFrame, pool: DataFrame, ratios: Sequence[float], seed: int = 0) -> DataFrame:
    """(sample_id, camo_ratio, edge_id, origin): each graph at each ratio with round-half-even(E * ratio) edges of the pool (edge_id).

    The pool is put in the order of its draws once; a sample takes the edges from a place of its own on, in a ring. So a
    sample holds no pool edge twice, unless it takes more than there are: then it goes round again. An empty pool adds none.
    """
    sizes = edges.groupBy("graph_id").agg(F.count("*").alias("_e"))
    levels = F.explode(F.array(*map(F.lit, map(float, ratios)))).alias("camo_ratio")
    each = sizes.select("graph_id", "_e", levels).withColumn("sample_id", F.concat(F.col("graph_id"), F.lit("__camo"), F.col("camo_ratio").cast("string")))
    own = edges.select("graph_id", "edge_id").join(each.select("graph_id", "sample_id", "camo_ratio").hint("merge"), "graph_id").select("sample_id", "camo_ratio", "edge_id", F.lit("own").alias("origin"))
    ring = numbered(pool.select(F.col("edge_id").alias("_pool"), draw(seed, "edge_id").alias("_draw")), ["_draw", "_pool"], name="_i").select("_pool", "_i")
    n = pool.agg(F.count("*").alias("_n"))
    slots = each.withColumn("_k", F.bround(F.col("_e") * F.col("camo_ratio"), 0).cast("int")).where("_k > 0").withColumn("_slot", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    picked = slots.crossJoin(F.broadcast(n)).withColumn("_i", (drawn_number(seed, "sample_id") + F.col("_slot")) % F.nullif(F.col("_n"), F.lit(0)))
    noise = picked.join(ring.hint("merge"), "_i").select("sample_id", "camo_ratio", F.col("_pool").alias("edge_id"), F.lit("noise").alias("origin"))
    return own.unionByName(noise)


def sample_negative_edges(edges: DataFrame, nodes: DataFrame, seed: int = 0) -> DataFrame:
    """(graph_id, src_idx, dst_idx): as many random node pairs as edges; nodes have (graph_id, idx)."""
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("_n"))
    at = lambda lo: F.conv(F.substring(draw(seed, "edge_id"), lo, 8), 16, 10).cast("bigint") % F.col("_n")
    return edges.select("graph_id", "edge_id").join(n, "graph_id").select("graph_id", "edge_id", at(1).alias("src_idx"), at(9).alias("dst_idx"))


def corpus_dedup_stats(graphs: DataFrame, reference: DataFrame) -> DataFrame:
    """(unique_rate, valid_rate, novelty) of canonical strings ``canon``: distinct over all, the share of rows that are ``valid`` (all, without
    such a column), and the share of distinct ones not in the reference. Null without rows."""
    valid = F.count_if("valid") if "valid" in graphs.columns else F.count("*")
    distinct = graphs.select("canon").distinct().join(reference.select("canon").distinct().withColumn("_seen", F.lit(1)), "canon", "left")
    d = distinct.agg(F.count("*").alias("_d"), F.count("_seen").alias("_s"))
    rate = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 6)
    counted = graphs.agg(F.count("*").alias("_n"), valid.alias("_v")).crossJoin(d)
    return counted.select(rate("_d", "_n").alias("unique_rate"), rate("_v", "_n").alias("valid_rate"), F.round(1 - F.col("_s") / F.nullif(F.col("_d"), F.lit(0)), 6).alias("novelty"))
