"""Approximate nearest neighbours on robust-pruned directed graphs, one a shard, searched by beam."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from provgraph.session import materialize

#: Out-degree, beam while building, relaxation of the pruning rule, beam while searching, points inserted at a time.
DEGREE, BUILD_BEAM, ALPHA, SEARCH_BEAM, BATCH = 32, 64, 1.2, 100, 256
#: Distances between candidates held at a time while pruning.
PRUNE_CELLS = 4_000_000


def _squared(points: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``to`` (n, d) to its own points (n, m, d)."""
    inner = np.matmul(points, to[:, :, None])[:, :, 0]
    return np.maximum(0, np.einsum("nmd,nmd->nm", points, points) + np.einsum("nd,nd->n", to, to)[:, None] - 2 * inner)


def beam_search(points: np.ndarray, graph: np.ndarray, entry: int, targets: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, squared distances), each (n, beam) and nearest first: greedy searches of all targets at once.

    Every round each search opens its nearest point not opened yet and adds that point's neighbours that it hasn't seen; it
    ends when the whole beam is opened. Free places have id -1 and infinite distance.
    """
    n = len(targets)
    ids = np.full((n, beam), -1, np.int32)
    far = np.full((n, beam), np.inf, np.float32)
    opened = np.ones((n, beam), bool)
    seen = np.zeros((n, len(points) + 1), bool)  # the last column stands for id -1
    seen[:, [entry, -1]] = True
    ids[:, 0], far[:, 0], opened[:, 0] = entry, _squared(points[np.full((n, 1), entry)], targets)[:, 0], False
    live = np.arange(n)
    while len(live):
        row = np.arange(len(live))
        at = np.where(opened[live], np.inf, far[live]).argmin(1)
        opened[live, at] = True
        near = graph[ids[live, at]]
        known = seen[live[:, None], near]
        seen[live[:, None], near] = True
        distance = _squared(points[near], targets[live])
        distance[known] = np.inf
        all_ids, all_far, all_opened = np.concatenate([ids[live], near], 1), np.concatenate([far[live], distance], 1), np.concatenate([opened[live], known], 1)
        best = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
        at = row[:, None], best
        ids[live], far[live], opened[live] = all_ids[at], all_far[at], all_opened[at] | np.isinf(all_far[at])
        live = live[~opened[live].all(1)]
    ids[np.isinf(far)] = -1
    order = np.lexsort((ids, far), axis=1)
    return np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)


def robust_prune(points: np.ndarray, origin: np.ndarray, near: np.ndarray, far: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each row of candidates (ids, squared distances to the origin point; -1 is none): up to ``degree`` that stay.

    The nearest candidate stays and removes every other that is ``alpha`` times nearer to it than to the origin, and so on:
    long edges in other directions survive, neighbours of neighbours do not.
    """
    far = far.copy()
    far[(near < 0) | (near == origin[:, None])] = np.inf
    kept = np.full((len(near), degree), -1, np.int32)
    row = np.arange(len(near))
    vectors = points[near]
    length = np.einsum("nmd,nmd->nm", vectors, vectors)
    apart = length[:, :, None] + length[:, None, :] - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
    for place in range(degree):
        at = far.argmin(1)
        real = np.isfinite(far[row, at])
        if not real.any():
            break
        kept[real, place] = near[row, at][real]
        far[(alpha * alpha * apart[row, at] <= far) & real[:, None]] = np.inf
        far[row, at] = np.inf
    return kept


def build_graph(points: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, batch: int = BATCH, seed: int = 7) -> tuple[np.ndarray, int]:
    """(graph (n, degree) of neighbours, entry point). Points go in by doubling batches; a batch searches the graph so far,
    prunes what it found, and its edges are added backwards, pruning the lists that grow too long."""
    n = len(points)
    graph = np.full((n, degree), -1, np.int32)
    entry = int(_squared(points[None, :, :], points.mean(0, keepdims=True))[0].argmin())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]]).astype(np.int32)
    done = 1
    while done < n:
        new = order[done : done + min(batch, max(1, done))]
        done += len(new)
        found, far = beam_search(points, graph, entry, points[new], beam)
        if len(new) > 1:  # the batch's own points are candidates for each other too
            peers = np.broadcast_to(new, (len(new), len(new)))
            found, far = np.concatenate([found, peers], 1), np.concatenate([far, _squared(points[peers], points[new])], 1)
            cut = np.argsort(far, axis=1, kind="stable")[:, : beam + 16]
            found, far = np.take_along_axis(found, cut, 1), np.take_along_axis(far, cut, 1)
        graph[new] = robust_prune(points, new, found, far, degree, alpha)
        src, dst = np.repeat(new, degree), graph[new].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        heads, starts, counts = np.unique(dst, return_index=True, return_counts=True)
        by = np.argsort(counts, kind="stable")
        heads, starts, counts = heads[by], starts[by], counts[by]
        lo = 0
        while lo < len(heads):
            wide = degree + int(counts[min(lo + batch, len(heads)) - 1])
            step = max(1, min(batch, PRUNE_CELLS // wide**2))
            h, s, c = heads[lo : lo + step], starts[lo : lo + step], counts[lo : lo + step]
            lo += step
            extra = np.full((len(h), int(c.max())), -1, np.int32)
            for i in range(len(h)):
                extra[i, : c[i]] = src[s[i] : s[i] + c[i]]
            listed = np.concatenate([graph[h], extra], 1)
            known = (extra[:, :, None] == graph[h][:, None, :]).any(2)
            listed[:, degree:][known] = -1
            graph[h] = robust_prune(points, h, listed, _squared(points[listed], points[h]), degree, alpha)
    return graph, entry


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec): one row an id whose vector has only finite components, not all zero, and the commonest length; of several vectors of an id the least counts.

    Vectors stay in the precision that they came with: doubles as doubles, all else as floats.
    """
    wide = isinstance(getattr(vectors.schema[vec_col].dataType, "elementType", None), DoubleType)
    v = F.col(vec_col).cast("array<double>" if wide else "array<float>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("vec")).where("vec_id is not null and vec is not null and size(vec) > 0").where(fine.alias("f"))
    common = rows.groupBy(F.size("vec").alias("_d")).count().orderBy(F.desc("count"), "_d").first()
    return rows.where(F.size("vec") == (common["_d"] if common else 0)).groupBy("vec_id").agg(F.min("vec").alias("vec"))


def _numbers(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy())


def _lifted(flat: np.ndarray, top: float) -> np.ndarray:
    """Points with one more coordinate that brings all to one length, so that the largest inner product is the least distance."""
    flat = flat.astype(np.float32)
    lift = np.sqrt(np.maximum(0, top - (flat.astype(float) ** 2).sum(1))).astype(np.float32)
    return np.column_stack([flat, lift])


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, shard_rows: int = 32_768, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, its ``k`` best others by inner product.

    Equal vectors are one point that carries its k + 1 smallest ids, so copies neither crowd a graph nor get lost. Points
    are dealt by hash into shards of about ``shard_rows``, which should be as many as a task's memory takes (at 64
    dimensions about 1 kB a point): a search costs about the logarithm of a shard, so few large ones cost the least. Every shard's
    graph is built once and written; it moves once more, to the task that its queries stream through in batches, and the
    shards' answers meet by query. Scores are inner products of the original vectors in double precision; ties go to the
    smaller id. Recall, not exactness, is what a graph gives: the tests hold it to 0.9 against brute force. Null, zero and
    non-finite vectors, those of another length than most, and rows without an id take no part. No usable row: no result.
    """
    rows = materialize(usable(vectors, id_col, vec_col))
    kind = rows.schema["vec"].dataType.simpleString()
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("_n") <= k + 1)
    points = materialize(ranked.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    count, top = points.agg(F.count("*"), F.max(norm)).first()
    shards, top = max(1, -(-count // shard_rows)), top or 0.0

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        graph, entry = build_graph(_lifted(_numbers(pdf["vec"]), top))
        return pd.DataFrame({"shard": pdf["shard"], "place": np.arange(len(pdf)), "entry": entry, "ids": pdf["ids"], "vec": pdf["vec"], "edges": list(graph)})

    dealt = points.withColumn("shard", F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int"))
    graphs = materialize(dealt.repartition(max(shards, 2), "shard").groupBy("shard").applyInPandas(build, f"shard int, place int, entry int, ids array<bigint>, vec {kind}, edges array<int>"))
    asked = rows.where(F.col("vec_id") % every == 0)
    each_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    questions = asked.select(each_shard, F.col("vec_id").alias("query_id"), "vec")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come by shard, its graph first and then its queries; one graph is held at a time."""
        now, held, exact, lifted, edges, ids, entry = -1, [], None, None, None, None, 0
        for batch in batches:
            out = {"query_id": [], "vec_id": [], "score": []}
            for shard, part in batch.groupby("shard", sort=True):
                if shard != now:
                    now, held, exact = shard, [], None
                is_point = part["query_id"].isna().to_numpy()
                if is_point.any():
                    held.append(part[is_point])
                query = part[~is_point]
                if not len(query) or not held and exact is None:
                    continue
                if exact is None:
                    graph = pd.concat(held)
                    held = []
                    flat = _numbers(graph["vec"])
                    exact, lifted, edges, ids, entry = flat.astype(float), _lifted(flat, top), np.stack(graph["edges"]).astype(np.int32), graph["ids"].tolist(), int(graph["entry"].iloc[0])
                for lo in range(0, len(query), BATCH):
                    some = query.iloc[lo : lo + BATCH]
                    ask = _numbers(some["vec"])
                    found, _ = beam_search(lifted, edges, entry, np.column_stack([ask.astype(np.float32), np.zeros(len(ask), np.float32)]), SEARCH_BEAM)
                    for query_id, vector, near in zip(some["query_id"].tolist(), ask.astype(float), found):
                        near = near[near >= 0]
                        scores = (exact[near] * vector).sum(1)
                        best = sorted(((-s, i) for s, p in zip(scores.tolist(), near.tolist()) for i in ids[p] if i != int(query_id)))[:k]
                        out["query_id"] += [int(query_id)] * len(best)
                        out["vec_id"] += [i for _, i in best]
                        out["score"] += [-s for s, _ in best]
            yield pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    null = lambda t: F.lit(None).cast(t)
    held = graphs.select("shard", F.lit(0).alias("_kind"), "place", null("string").alias("query_id"), "entry", "ids", "vec", "edges")
    asks = questions.select("shard", F.lit(1).alias("_kind"), F.lit(0).alias("place"), F.col("query_id").cast("string"), null("int").alias("entry"), null("array<bigint>").alias("ids"), "vec", null("array<int>").alias("edges"))
    dealt = held.unionByName(asks).repartition(max(shards, 2), "shard").sortWithinPartitions("shard", "_kind", "place")
    found = dealt.mapInPandas(search, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
