"""Nearest rows by cosine within groups: blocks meet blocks in tasks of their own, as matrix products whose near best are then computed exactly."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

#: How far a cosine by single-precision products may lie from the exact one, and twice the step of a rounding to six places.
SLACK = 2e-5
#: Rows of a matrix product at a time, and pairs whose exact cosines are computed at a time.
STRIP, PAIRS = 256, 1 << 16


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added from the first component on as ``evaluate.dot`` does."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


class _Side:
    """Vectors of one block: rows padded with zeros, lengths (-1 for null), norms, unit rows in single precision, and rows that aren't finite."""

    def __init__(self, vectors: Sequence[np.ndarray | None], width: int):
        self.size = np.array([-1 if v is None else len(v) for v in vectors])
        self.rows = np.zeros((len(vectors), width))
        for i, v in enumerate(vectors):
            if v is not None:
                self.rows[i, : len(v)] = v
        with np.errstate(all="ignore"):
            self.norm = np.sqrt(_dots(self.rows, self.rows))
            self.odd = ~np.isfinite(self.norm) | ((self.norm < 1e-150) & (self.rows != 0).any(1)) | (self.norm > 1e150)
            plain = (self.norm > 0) & ~self.odd
            self.unit = np.where(plain[:, None], self.rows / np.where(plain, self.norm, 1.0)[:, None], 0.0).astype("f4")


def _cosines(a: _Side, b: _Side, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """``evaluate.cosine`` of the pairs of rows; minus infinity stands for null, where lengths differ and neither is zero."""
    out = np.empty(len(r))
    with np.errstate(all="ignore"):
        for at in range(0, len(r), PAIRS):
            i, j = r[at : at + PAIRS], c[at : at + PAIRS]
            norms = a.norm[i] * b.norm[j]
            some = (a.size[i] >= 0) & (b.size[j] >= 0)
            cos = np.where(a.size[i] == b.size[j], _dots(a.rows[i], b.rows[j]) / norms, -np.inf)
            out[at : at + PAIRS] = np.where(some & ((norms > 0) | np.isnan(norms)), cos, 0.0)
    return out


def _best(left: pd.DataFrame, right: pd.DataFrame, k: int, keep: list[str], give: list[str], alpha: float | None) -> Iterator[pd.DataFrame]:
    """The pairs of one block with another that may be among a left row's best k; of equal scores the first k in the order of ``give``."""
    right = right.sort_values(give, kind="stable").reset_index(drop=True)
    lists = [[v] for v in right["_vec"]] if alpha is None else [list(vs) for vs in right["_vecs"]]
    width = max([0, *(len(v) for v in left["_vec"] if v is not None), *(len(v) for vs in lists for v in vs if v is not None)])
    a = _Side(list(left["_vec"]), width)
    deep = max(map(len, lists), default=0)
    parts = [_Side([vs[p] if p < len(vs) else None for vs in lists], width) for p in range(deep)]
    has = [np.array([p < len(vs) for vs in lists]) for p in range(deep)]
    if alpha is not None:
        mean = []
        for vs in lists:
            total = np.zeros(len(vs[0]))
            for v in vs:
                total = total + np.asarray(v, float) if len(v) == len(total) else total * np.nan
            mean.append(total / len(vs))
        centre = _Side(mean, width)
    held = pd.factorize(pd.concat([left["_own"], right["_owner"]]), use_na_sentinel=False)[0] if "_own" in left else None
    places = pd.Series(np.arange(len(right)), right[give[0]]).groupby(level=0).apply(list).to_dict() if "_without" in left else {}
    odd_b = np.any([s.odd & h for s, h in zip(parts, has)], axis=0) if alpha is None else np.any([centre.odd, *(s.odd & h for s, h in zip(parts, has))], axis=0)
    for lo in range(0, len(left), STRIP):
        rows = slice(lo, min(lo + STRIP, len(left)))
        near = a.unit[rows] @ parts[0].unit.T
        if alpha is not None:
            for s, h in zip(parts[1:], has[1:]):
                np.maximum(near, np.where(h[None, :], a.unit[rows] @ s.unit.T, np.float32(-2)), out=near)
            near = np.float32(alpha) * (a.unit[rows] @ centre.unit.T) + np.float32(1 - alpha) * near
        ban = np.zeros(near.shape, bool) if held is None else held[: len(left)][rows][:, None] == held[None, len(left) :]
        if places:
            for i, ids in enumerate(left["_without"].iloc[rows]):
                for x in ids if ids is not None else ():
                    ban[i, places.get(x, [])] = True
        odd = a.odd[rows][:, None] | odd_b[None, :]
        differ = (a.size[rows][:, None] != parts[0].size[None, :]) & (a.norm[rows] > 0)[:, None] & (parts[0].norm > 0)[None, :]
        near[ban | odd | differ] = -np.inf
        least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k] if near.shape[1] >= k else np.full(len(near), -np.inf)
        r, c = np.nonzero((odd | (near >= (least - SLACK)[:, None])) & ~ban)
        r += lo
        score = _cosines(a, parts[0], r, c)
        if alpha is not None:
            for s, h in zip(parts[1:], has[1:]):
                score = np.maximum(score, np.where(h[c], _cosines(a, s, r, c), -np.inf))  # NaN stays, as the greatest
            score = alpha * _cosines(a, centre, r, c) + (1 - alpha) * score
        value = np.where(np.isnan(score), 9.0, score)
        order = np.lexsort((c, -value, r))
        r, c, value = r[order], c[order], value[order]
        first = np.ones(len(r), bool)
        first[1:] = (r[1:] != r[:-1]) | (value[1:] != value[:-1])
        start = np.maximum.accumulate(np.where(first, np.arange(len(r)), 0))
        few = np.arange(len(r)) - start < k
        r, c, value = r[few], c[few], value[few]
        out = pd.concat([left[keep].iloc[r].reset_index(drop=True), right[[*give, *(x for x in right.columns if x == "_back")]].iloc[c].reset_index(drop=True)], axis=1)
        yield out.assign(_score=np.where(np.isneginf(value) | (value == 9.0), np.nan, value), _nan=value == 9.0)


def near_best(asked: DataFrame, offered: DataFrame, by: Sequence[str], k: int, keep: list[str], give: list[str], alpha: float | None = None, asked_rows: int = 4096, offered_rows: int = 8192) -> DataFrame:
    """(keep, give, score): for each row of ``asked`` (by, _vec, keep) all rows of ``offered`` (by, _vec, give) that can be among its best k of its group by cosine rounded to six places or more, ties by ``give``.

    With ``alpha`` rows of ``offered`` have ``_vecs``, several vectors, and the score is alpha * cosine with their mean + (1 - alpha) * the largest
    with one of them. Pairs with ``_own`` equal to ``_owner``, or whose first ``give`` is in the array ``_without``, don't count; ``_back`` is given back.
    Scores are those of ``evaluate.cosine``, to the last bit. A group is dealt by hash into blocks of about so many rows on either side; every block meets every other in a task of its own, which
    holds one of each and computes ``STRIP`` rows of products at a time. It gives few rows for each asked one, so all pairs are looked at but none is
    moved; what is shuffled is each side once for every block of the other. Rows with a null in ``by`` meet nothing.
    """
    own = [*by, "_a", "_b"]
    sizes = lambda df, rows, name: df.groupBy(*(F.col(c).alias(f"_of_{c}") for c in by)).agg(F.ceil(F.count("*") / rows).cast("int").alias(name))
    same = lambda: [F.col(c) == F.col(f"_of_{c}") for c in by]
    both = sizes(asked, asked_rows, "_as").join(sizes(offered, offered_rows, "_bs").hint("merge"), [f"_of_{c}" for c in by])
    deal = lambda cols, n: F.pmod(F.xxhash64(*cols), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    clean = lambda v: F.when(~F.exists(v, lambda x: x.isNull()), F.col(v))
    names = [f"_of_{c}" for c in by]
    left = asked.join(both.hint("merge"), same()).withColumn("_a", deal(keep, "_as")).withColumn("_b", every("_bs")).withColumn("_vec", clean("_vec")).drop("_as", "_bs", *names)
    right = offered.join(both.hint("merge"), same()).withColumn("_b", deal(give, "_bs")).withColumn("_a", every("_as")).drop("_as", "_bs", *names)
    if alpha is None:
        right = right.withColumn("_vec", clean("_vec"))
    kinds = {f.name: f.dataType for f in [*asked.schema.fields, *offered.schema.fields]}
    given = [*keep, *give, *(c for c in offered.columns if c == "_back")]
    schema = StructType([*(StructField(c, kinds[c]) for c in given), StructField("_score", DoubleType()), StructField("_nan", BooleanType())])

    def run(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({f.name: [] for f in schema.fields})
        return pd.concat([*_best(x, y, k, keep, give, alpha)]) if len(x) and len(y) else none

    left, right = (df.select(*(F.col(c) for c in df.columns if c not in own), *(F.col(c).alias(f"{lead}{i}") for i, c in enumerate(own))) for df, lead in ((left, "_l"), (right, "_r")))
    met = left.groupBy(*(f"_l{i}" for i in range(len(own)))).cogroup(right.groupBy(*(f"_r{i}" for i in range(len(own))))).applyInPandas(run, schema)
    return met.withColumn("_score", F.when(F.col("_nan"), F.lit(float("nan"))).otherwise(F.col("_score"))).drop("_nan").withColumnRenamed("_score", "score")
