"""Longest-processing-time sharding: groups that must stay together go, largest first, to the least-loaded shard of a heap."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provgraph.session import materialize


def longest_first(groups: Iterable[tuple[bytes, int]], loads: list[float]) -> tuple[dict[bytes, int], list[float]]:
    """key -> shard for (key, size), by size downwards (ties by key), each to the shard with the least load so far (ties to the smallest)."""
    heap = [(load, shard) for shard, load in enumerate(loads)]
    heapq.heapify(heap)
    put: dict[bytes, int] = {}
    for key, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        load, shard = heap[0]
        put[key] = shard
        heapq.heapreplace(heap, (load + size, shard))
    return put, [load for load, _ in sorted(heap, key=lambda x: x[1])]


def assign_groups(groups: DataFrame, shards: int, fine: int = 1000, block: int = 65_536) -> DataFrame:
    """(gkey, shard) for (gkey binary, bytes).

    A group above 1/``fine`` of a mean shard is large: there are at most ``shards * fine`` of those whatever the input, and
    one heap places them exactly. The rest is dealt by hash into blocks of about ``block`` groups; every block runs the same
    rule on its own heap, which starts with the block's share of the large groups' loads, so that all blocks together fill
    the shards evenly. Within a block the loads end apart by at most its largest small group, which is at most 1/``fine`` of a
    mean shard (in practice by about its smallest), so two shards' loads differ by at most that sum over the blocks.
    """
    spark = groups.sparkSession
    total, count = groups.agg(F.sum("bytes"), F.count("*")).first()
    if not count:
        return groups.select("gkey", F.lit(0).alias("shard"))
    limit = total / (shards * fine)
    large, loads = longest_first([(bytes(r.gkey), r.bytes) for r in groups.where(F.col("bytes") > limit).select("gkey", "bytes").collect()], [0.0] * shards)
    rest = groups.where(F.col("bytes") <= limit)
    small = total - sum(loads)
    blocks = max(1, -(-(count - len(large)) // block))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        share = float(pdf["bytes"].sum()) / small
        put, _ = longest_first(zip(pdf["gkey"], pdf["bytes"].tolist()), [x * share for x in loads])
        return pd.DataFrame({"gkey": list(put), "shard": list(put.values())})

    placed = rest.select("gkey", "bytes", F.pmod(F.xxhash64("gkey"), F.lit(blocks)).alias("_block")).groupBy("_block").applyInPandas(place, "gkey binary, shard int")
    if not large:
        return placed
    return placed.unionByName(spark.createDataFrame([(bytearray(k), s) for k, s in large.items()], "gkey binary, shard int"))


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", slot_rows: int = 20_000) -> DataFrame:
    """One row a document: id, size (UTF-8 bytes and 16), text_crc32, shard, and slot, gapless from 0 within its shard.

    Equal texts are one group and share a shard (a null text counts as empty and goes with the empty ones), even a group
    larger than a mean shard; apart from such groups the shards' bytes are near equal. Texts are compared by SHA-256.
    Slots come from row numbers within small parts of a shard plus the sizes of the parts before, so no task holds a shard.
    Repeated rows each get a slot; an empty table gives none.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(
        docs.select(F.col(id_col), (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("gkey"))
    )
    groups = materialize(rows.groupBy("gkey").agg(F.sum("size").alias("bytes")))
    where = materialize(assign_groups(groups, shards))
    parts = max(1, -(-rows.count() // (shards * slot_rows)))
    put = materialize(
        rows.join(where.hint("merge"), "gkey").select(id_col, "size", "text_crc32", "shard", F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(parts)).cast("int").alias("_part"))
    )
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = put.groupBy("shard", "_part").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy("shard", "_part").orderBy(id_col, "text_crc32")
    numbered = put.withColumn("_row", F.row_number().over(within) - 1)
    return numbered.join(starts.hint("shuffle_hash"), ["shard", "_part"]).select(id_col, "size", "text_crc32", "shard", (F.col("_start") + F.col("_row")).cast("bigint").alias("slot"))
