"""Hard negatives by BOND: a vertical scan of columnar blocks, dimension by dimension, whose bounds shrink the candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provgraph.session import Scratch

#: Rows a block, anchors that travel together, and dimensions between two looks at the bounds.
BLOCK_ROWS, CHUNK, LOOK = 8192, 256, 4
#: Largest component after scaling: the scores of up to 4096 dimensions then fit 64 bits.
LARGEST = 1 << 25


def whole_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, vec): components x become floor(256 x), as packed 32-bit integers; where the id is divisible by 7 the label is the next of ten.

    Rows with a null id, label or vector, and those with a null, non-finite or too large component, are left out.
    """
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST / 256))
    vec_id, label = F.col(id_col).cast("bigint"), F.col(label_col).cast("bigint")
    kept = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull()).where(fine)
    told = kept.select(vec_id.alias("vec_id"), F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), v.alias("v"))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["vec_id", "label"]].assign(vec=[np.floor(256 * np.asarray(x, np.float64)).astype("<i4").tobytes() for x in pdf["v"]])

    return told.mapInPandas(pack, "vec_id bigint, label bigint, vec binary")


def columnar_blocks(vectors: DataFrame, blocks: int) -> DataFrame:
    """(block, n, ids, labels, cells): the rows of a block and of one length by label and id, ``cells`` dimension after dimension."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, same in pdf.groupby(pdf["vec"].str.len(), sort=True):
            same = same.sort_values(["label", "vec_id"], kind="stable")
            cells = np.frombuffer(b"".join(same["vec"]), "<i4").reshape(len(same), -1).T
            out.append((pdf["block"].iloc[0], len(same), same["vec_id"].to_numpy("<i8").tobytes(), same["label"].to_numpy("<i8").tobytes(), np.ascontiguousarray(cells).tobytes()))
        return pd.DataFrame(out, columns=["block", "n", "ids", "labels", "cells"])

    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id", "vec"), F.lit(blocks)).cast("int"))
    return dealt.repartition(max(2, blocks), "block").groupBy("block").applyInPandas(pack, "block int, n int, ids binary, labels binary, cells binary")


class Block:
    """A columnar block: ids and labels of its rows, cells by dimension, and each dimension's least and greatest cell."""

    def __init__(self, n: int, ids: bytes, labels: bytes, cells: bytes):
        self.ids, self.labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
        self.cells = np.frombuffer(cells, "<i4").reshape(-1, n)
        self.low, self.high = (f(1).astype(np.int64) if len(self.cells) else np.zeros(0, np.int64) for f in (self.cells.min, self.cells.max))

    def of_label(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]))


def bond_scan(block: Block, query: np.ndarray, alive: np.ndarray, keep: Callable[[np.ndarray, np.ndarray], np.ndarray], look: int = LOOK) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows, scores, cells read): the rows of ``alive`` that ``keep`` leaves, with their exact inner products.

    Dimensions come in descending magnitude of the query. Every ``look`` of them each candidate's score lies between its part so far plus the
    least and plus the most that the rest can add by the block's least and greatest cells; ``keep(low, high)`` tells who stays.
    """
    order = np.argsort(-np.abs(query), kind="stable")
    one, two = query[order] * block.low[order], query[order] * block.high[order]
    tail = lambda x: np.concatenate([np.cumsum(x[::-1])[::-1], [0]])
    least, most = tail(np.minimum(one, two)), tail(np.maximum(one, two))
    part, read = np.zeros(len(alive), np.int64), 0
    for k, d in enumerate(order, 1):
        part += query[d] * block.cells[d][alive].astype(np.int64)
        read += len(alive)
        if k % look == 0 or k == len(order):
            stays = keep(part + least[k], part + most[k])
            if not stays.all():
                alive, part = alive[stays], part[stays]
                if not len(alive):
                    break
    if not len(order):
        stays = keep(part, part)
        alive, part = alive[stays], part[stays]
    return alive, part, read


def _largest(k: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Who can still be among the ``k`` largest."""

    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return high >= np.partition(low, len(low) - k)[len(low) - k] if len(low) > k else np.ones(len(low), bool)

    return keep


def _in_windows(windows: list[tuple[int, int]], k: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Who can still be among the ``k`` largest within a window, for any of the windows (first, last score)."""

    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        stays = np.zeros(len(low), bool)
        for first, last in windows:
            can = (high >= first) & (low <= last)
            sure = low[(low >= first) & (high <= last)]
            if len(sure) > k:
                can &= high >= np.partition(sure, len(sure) - k)[len(sure) - k]
            stays |= can
        return stays

    return keep


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int]]:
    order = np.lexsort((ids, -scores))[:k]
    return list(zip(ids[order].tolist(), scores[order].tolist()))


def nearest_of_label(block: Block, anchor: int, label: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(id, score) of the block's best ``k`` rows of the label with another id."""
    same = block.of_label(label)
    alive = np.arange(same.start, same.stop)
    rows, scores, _ = bond_scan(block, query, alive[block.ids[same] != anchor], _largest(k))
    return _best(block.ids[rows], scores, k)


def just_below(block: Block, anchor: int, label: int, query: np.ndarray, positives: list[int], k: int, percent: int) -> list[list[tuple[int, int]]]:
    """For each positive score p the block's best ``k`` (id, score) of other labels and another id with percent p <= 100 score <= 100 p."""
    windows = [(-(-percent * p // 100), p) for p in positives]
    same = block.of_label(label)
    alive = np.concatenate([np.arange(same.start), np.arange(same.stop, len(block.ids))])
    rows, scores, _ = bond_scan(block, query, alive[block.ids[alive] != anchor], _in_windows(windows, k))
    inside = [(scores >= first) & (scores <= last) for first, last in windows]
    return [_best(block.ids[rows[x]], scores[x], k) for x in inside]


def _past_blocks(blocks: DataFrame, count: int, anchors: DataFrame, each: Callable[..., list[tuple]], ddl: str) -> DataFrame:
    """``each(block, *anchor)`` for every anchor (anchor, label, vec, known) and every block whose rows are as long as it; a block moves once, to the task that anchors stream through."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, names = None, {}, [x.split()[0] for x in ddl.split(",")]
        for pdf in batches:
            out: list[tuple] = []
            for r in pdf.itertuples(index=False):
                if r.block != now:
                    now, held = r.block, {}
                if r.kind == 0:
                    one = Block(r.n, r.ids, r.labels, r.vec)
                    held[len(one.cells)] = one
                    continue
                query = np.frombuffer(r.vec, "<i4").astype(np.int64)
                if len(query) in held:
                    out += each(held[len(query)], int(r.row), int(r.anchor), int(r.label), query, r.known)
            yield pd.DataFrame(out, columns=names)

    null = lambda t: F.lit(None).cast(t)
    nothing = F.array().cast("array<bigint>")
    zero = F.lit(0).cast("bigint")
    held = blocks.select("block", F.lit(0).alias("kind"), "n", "ids", "labels", F.col("cells").alias("vec"), zero.alias("row"), zero.alias("anchor"), zero.alias("label"), nothing.alias("known"))
    asks = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).select("block", F.lit(1).alias("kind"), F.lit(0).alias("n"), null("binary").alias("ids"), null("binary").alias("labels"), "vec", "row", "anchor", "label", "known")
    return held.unionByName(asks).repartition(max(2, count), "block").sortWithinPartitions("block", "kind").mapInPandas(run, ddl)


def _top(rows: DataFrame, by: list[str], k: int, name: str) -> DataFrame:
    """The ``k`` rows of largest score, then least id, for each ``by``, numbered from 1."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))).where(F.col(name) <= k)


def hard_negatives(rows: DataFrame, every: int = 100, k: int = 5, percent: int = 80, block_rows: int = BLOCK_ROWS, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of the rows whose id is divisible by ``every``.

    Vectors and labels are those of ``whole_vectors``; a score is an integer inner product, larger first, ties by smaller id.
    An anchor's positives are its first ``k`` rows of its label; a positive's negatives the first ``k`` rows of other labels
    whose score lies within ``percent`` to 100 per cent of the positive's (so a negative score has none). Only rows of the
    anchor's length compare, rows with the anchor's own id are no partners of it, and rows that repeat are rows of their own.

    Rows are dealt by hash into columnar blocks of about ``block_rows``, written once. Anchors meet every block, as the task asks, in two
    passes: the first finds the positives, the second, with their scores as windows, the negatives. Within a block ``bond_scan`` reads dimensions
    until its bounds leave only rows that count, exactly. At most ``k`` rows an anchor (and positive) leave a block, so what meets is
    small. Null rows and unusable vectors take no part; empty tables and tables without anchors give no row.
    """
    scratch = Scratch(rows.sparkSession)
    vectors = scratch.table(whole_vectors(rows, id_col, vec_col, label_col))
    count = max(1, -(-vectors.count() // block_rows))
    blocks = scratch.table(columnar_blocks(vectors, count))
    anchors = scratch.table(vectors.where(F.col("vec_id") % every == 0).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").alias("anchor"), "label", "vec"))

    def positives(block: Block, row: int, anchor: int, label: int, query: np.ndarray, known) -> list[tuple]:
        return [(row, i, s) for i, s in nearest_of_label(block, anchor, label, query, k)]

    def negatives(block: Block, row: int, anchor: int, label: int, query: np.ndarray, known: list[int]) -> list[tuple]:
        below = just_below(block, anchor, label, query, [int(p) for p in known], k, percent)
        return [(row, at, i, s) for at, found in enumerate(below, 1) for i, s in found]

    near = _past_blocks(blocks, count, anchors.withColumn("known", F.array().cast("array<bigint>")), positives, "row bigint, id bigint, score bigint")
    chosen = scratch.table(_top(near, ["row"], k, "at").select("row", "at", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    known = F.transform(F.array_sort(F.collect_list(F.struct("at", "positive_score"))), lambda x: x.positive_score).alias("known")
    asking = anchors.join(chosen.where("positive_score >= 0").groupBy("row").agg(known).hint("merge"), "row")
    far = _past_blocks(blocks, count, asking, negatives, "row bigint, at int, id bigint, score bigint")
    ranked = _top(far, ["row", "at"], k, "rank").select("row", "at", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select("row", F.col("anchor").alias("anchor_id")).join(chosen.hint("merge"), "row")
    out = named.join(ranked.hint("merge"), ["row", "at"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    result = scratch.table(out)
    scratch.drop_others(result)
    return result
