"""Running numbers over tables of any size, without a window that one task has to sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provgraph.session import materialize


def numbered(df: DataFrame, order: Sequence[Column | str], by: Sequence[str] = (), name: str = "n") -> DataFrame:
    """``df`` with ``name``: the row's number from 0 in ``order``, within ``by`` if given.

    Rows are dealt by range and written, so that a part's place is fixed; a row's number is its number within its part plus
    the counts of the parts before, of which there is one row a part and group. Nulls in ``by`` are one group; rows equal in
    ``order`` are numbered in some order, so it should end in a key. An empty table gives no row.
    """
    keys = [F.col(c) for c in by]
    placed = materialize(df.repartitionByRange(*keys, *order).withColumn("_in_part", F.spark_partition_id()))
    counts = placed.groupBy("_in_part", *by).agg(F.count("*").alias("_part_rows"))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_in_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("_in_part").alias("_of_part"), *(F.col(c).alias(f"_of_{c}") for c in by), F.coalesce(F.sum("_part_rows").over(earlier), F.lit(0)).alias("_ahead"))
    local = placed.withColumn("_in_place", F.row_number().over(Window.partitionBy("_in_part", *keys).orderBy(*order)) - 1)
    same = F.col("_in_part") == F.col("_of_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return local.join(before.hint("shuffle_hash"), same).select(*df.columns, (F.col("_ahead") + F.col("_in_place")).alias(name))


def running_totals(df: DataFrame, values: Sequence[str], order: str, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``before_{v}``, the sum of each value over the earlier rows in ``order`` within ``by``, and ``next_{order}``, the order of the row that follows (null for the last).

    ``order`` is distinct within ``by`` and not null. Dealt by range as in ``numbered``: a row's total is that within its
    part plus the parts' before it, and what follows a part's last row is the first of the next part.
    """
    keys = [F.col(c) for c in by]
    placed = materialize(df.repartitionByRange(*keys, order).withColumn("_in_part", F.spark_partition_id()))
    parts = placed.groupBy("_in_part", *by).agg(F.min(order).alias("_first"), *(F.sum(v).alias(f"_sum_{v}") for v in values))
    across = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_in_part")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    ahead = parts.select(F.col("_in_part").alias("_of_part"), *(F.col(c).alias(f"_of_{c}") for c in by), F.lead("_first").over(across).alias("_then"), *(F.coalesce(F.sum(f"_sum_{v}").over(earlier), F.lit(0)).alias(f"_ahead_{v}") for v in values))
    within = Window.partitionBy("_in_part", *keys).orderBy(order)
    local = placed.select("*", F.lead(order).over(within).alias("_next"), *(F.coalesce(F.sum(v).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_here_{v}") for v in values))
    same = F.col("_in_part") == F.col("_of_part")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return local.join(ahead.hint("shuffle_hash"), same).select(*df.columns, F.coalesce("_next", "_then").alias(f"next_{order}"), *((F.col(f"_here_{v}") + F.col(f"_ahead_{v}")).alias(f"before_{v}") for v in values))


def exact_quantile(df: DataFrame, value: str, share: float = 0.5, by: Sequence[str] = (), name: str = "quantile") -> DataFrame:
    """(by, name): the exact quantile of ``value`` within ``by``, between two values by their distance from its place, as Spark's ``percentile`` gives it.

    Equal values are counted first, then dealt by range: running totals tell which values hold the two places around share * (n - 1), so a large
    group is many tasks and a common value one row. Null values and nulls in ``by`` don't count; a group without values has no row.
    """
    keys = list(by)
    held = df.where(" and ".join(f"{c} is not null" for c in [*keys, value])).groupBy(*keys, F.col(value).alias("_value")).agg(F.count("*").alias("_rows"))
    placed = running_totals(held, ["_rows"], "_value", keys)
    total = held.groupBy(*(F.col(c).alias(f"_of_{c}") for c in keys)).agg(F.sum("_rows").alias("_total"))
    same = F.lit(True)
    for c in keys:
        same = same & (F.col(c) == F.col(f"_of_{c}"))
    at = share * (F.col("_total") - 1)
    here = lambda place: (F.col("before__rows") <= place) & (F.col("before__rows") + F.col("_rows") > place)
    found = placed.join(total.hint("merge") if keys else F.broadcast(total), same).where(here(F.floor(at)) | here(F.ceil(at)))
    double = F.col("_value").cast("double")
    low, high, part = F.max(F.when(here(F.floor(at)), double)), F.max(F.when(here(F.ceil(at)), double)), F.max(at - F.floor(at))
    return found.groupBy(*keys).agg(F.when(low == high, low).otherwise((1 - part) * low + part * high).alias(name))
