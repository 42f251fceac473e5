"""The prefix trie of conversations by the Euler-tour technique: nodes from running hashes, subtree figures from a ranked tour."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provgraph.operators.ranking import numbered, running_totals
from provgraph.operators.tours import subtree_sums
from provgraph.session import Scratch

#: Four 32-bit words, as 64-bit sums, stand for a sequence of turns.
WORDS = ["_h0", "_h1", "_h2", "_h3"]
#: Ids of one node are joined by ranges of so many, so that no task gathers the ids of a large node.
SPAN = 4096


def rebuilt(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: (conv_id, depth, mark, size) of the rebuilt turns, and (conv_id, n_turns) of all conversations.

    ``turns`` are numbered turns (conv_id, pos from 1, mark, size). Conversation c is the first h turns of c - c % family (all
    if it has fewer, none if there is none) and then its own turns after its first h, with h = crc32(decimal c) % most.
    """
    c = F.col("conv_id")
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("_own"))
    taken = (F.crc32(c.cast("string")) % most).alias("_h")
    source = counts.where(c % family == 0).select(c.alias("_source"), F.col("_own").alias("_of_source"))
    plan = counts.select("conv_id", "_own", taken, (c - c % family).alias("_from")).join(source.hint("merge"), F.col("_from") == F.col("_source"), "left")
    lent = F.least("_h", F.coalesce("_of_source", F.lit(0)))
    plan = plan.select("conv_id", "_h", "_from", lent.alias("_lent"), (lent + F.greatest(F.lit(0), F.col("_own") - F.col("_h"))).alias("n_turns"))
    heads = turns.where((c % family == 0) & (F.col("pos") < most)).select(c.alias("_from"), "pos", "mark", "size")
    borrowed = heads.join(plan.where("_lent > 0").hint("merge"), "_from").where("pos <= _lent").select("conv_id", F.col("pos").alias("depth"), "mark", "size")
    kept = turns.join(plan.hint("merge"), "conv_id").where("pos > _h").select("conv_id", (F.col("pos") - F.col("_h") + F.col("_lent")).alias("depth"), "mark", "size")
    return borrowed.unionByName(kept), plan.select("conv_id", "n_turns")


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, mark, size): a conversation's turns from 1 on by turn (null first), ties by role and text; ``mark`` is a digest of role and text, ``size`` the text's UTF-8 bytes. Rows without a conversation are left out."""
    said = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint"), F.col("turn").alias("_turn"), F.coalesce("role", F.lit("")).alias("_role"), F.coalesce("text", F.lit("")).alias("_text"))
    placed = numbered(said, [F.asc_nulls_first("_turn"), "_role", "_text"], ["conv_id"], "_p")
    mark = F.md5(F.concat_ws(":", F.length("_role").cast("string"), "_role", "_text"))
    return placed.select("conv_id", (F.col("_p") + 1).alias("pos"), mark.alias("mark"), F.octet_length("_text").cast("bigint").alias("size"))


def _words(at: Column, mark: Column) -> list[Column]:
    """The four words that a turn adds to the hash of every prefix that holds it at ``at``."""
    pair = [F.xxhash64(mark, at, F.lit(seed)) for seed in (17, 71)]
    return [part.alias(w) for w, part in zip(WORDS, [f(x) for x in pair for f in (lambda x: F.shiftrightunsigned(x, 32), lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)))])]


def _digests(ends: DataFrame, parts: int) -> DataFrame:
    """(depth, words, ends_sha256) of (depth, words, _bucket, _ids): SHA-256 of a node's joined ids, taken in as they stream by in order of buckets."""
    keys = ["depth", *WORDS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, digest = None, None
        for pdf in batches:
            out = []
            for *key, ids in zip(*(pdf[k].tolist() for k in keys), pdf["_ids"].tolist()):
                if key != now:
                    if now is not None:
                        out.append((*now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=[*keys, "ends_sha256"])
        if now is not None:
            yield pd.DataFrame([(*now, digest.hexdigest())], columns=[*keys, "ends_sha256"])

    ddl = ", ".join([*(f"{k} bigint" for k in keys), "ends_sha256 string"])
    return ends.repartition(parts, *keys).sortWithinPartitions(*keys, "_bucket").select(*keys, "_ids").mapInPandas(run, ddl)


def prefix_trie(turns: DataFrame, counts: DataFrame) -> DataFrame:
    """One row a node of the prefix trie of conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256; and enter_behind, the number of chains that the tour enters from the node's chain on.

    ``turns`` are (conv_id, depth from 1 without gaps, mark, size), ``counts`` (conv_id, n_turns), one row a conversation and
    one of 0 turns for one without any. A node is a distinct sequence of the first d marks: the sums of hashes of (place,
    mark) over the first d turns tell it, which running totals give for conversations of any length. The root has depth 0 and no mark.

    Nodes with the same members form a chain, and its arcs are consecutive in the Euler tour, so a chain (the smallest member
    and the number of members name it) is one pair of arcs that carries its savings, and each node of it then takes off
    what lies above it. The tour is ranked by ``list_sums``; leaves and savings of a subtree are differences of its sums at the
    two arcs. Chains are numbered by smallest member, near which most of a subtree lies, so that most of the
    ranking happens inside tasks. A node's leaf count and savings include itself. No conversation: no row.

    The ids of those that end at a node are joined by ranges of ``SPAN`` ids and hashed as they stream by; SHA-256 of one node takes its ids in
    order, so one task reads the (joined) ids of a node, but never holds them.
    """
    scratch = Scratch(turns.sparkSession)
    parts = max(2, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = scratch.table(counts)
    hashed = turns.select("conv_id", "depth", "size", *_words(F.col("depth"), F.col("mark")))
    rows = running_totals(hashed, [*WORDS, "size"], "depth", ["conv_id"])
    upper = [F.col(f"before_{w}").alias(f"_up{w}") for w in WORDS]
    rows = scratch.table(rows.select("conv_id", "depth", "size", F.col("before_size").alias("above"), *upper, *((F.col(w) + F.col(f"before_{w}")).alias(w) for w in WORDS), F.col("next_depth").isNull().alias("_last")))
    keys = ["depth", *WORDS]
    held = rows.groupBy(*keys).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *(F.first(c).alias(c) for c in ("size", "above", *(f"_up{w}" for w in WORDS))))
    zero = [F.lit(0).cast("bigint").alias(w) for w in WORDS]
    none = [F.lit(None).cast("bigint").alias(f"_up{w}") for w in WORDS]
    root = counts.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(0).cast("bigint").alias("depth"), *zero, "conv_id", "n_convs", F.lit(0).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("above"), *none)
    nodes = scratch.table(held.select(root.columns).unionByName(root))

    top = lambda c: F.min_by(c, "depth")
    end = lambda c: F.max_by(c, "depth")
    chain = nodes.groupBy("conv_id", "n_convs").agg(
        F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.min("above").alias("above"), F.max(F.col("above") + F.col("size")).alias("total"), *(top(f"_up{w}").alias(f"_up{w}") for w in WORDS), *(end(w).alias(w) for w in WORDS)
    )
    chains = scratch.table(numbered(chain, ["conv_id", "top"], name="node"))
    over = chains.select(F.col("bottom").alias("_bottom"), *(F.col(w).alias(f"_of{w}") for w in WORDS), F.col("node").alias("parent"), F.col("conv_id").alias("_over"))
    meets = F.col("top") == F.col("_bottom") + 1
    for w in WORDS:
        meets = meets & (F.col(f"_up{w}") == F.col(f"_of{w}"))
    placed = chains.where("top > 0").join(over.hint("merge"), meets).select("node", "parent", "_over")
    saved = ((F.col("n_convs") - 1) * (F.col("total") - F.col("above"))).alias("saved")
    tree = chains.select(F.col("node").alias("_node"), saved).join(placed.hint("merge"), F.col("_node") == F.col("node"), "left").select(F.col("_node").alias("node"), "parent", "saved", "_over")
    tree = scratch.table(tree)
    fan = tree.where("parent is not null").groupBy(F.col("parent").alias("_of")).agg(F.count("*").alias("_fan"))
    below = subtree_sums(tree, ["saved"])
    figures = tree.select("node", "_over").join(below.hint("merge"), "node").join(fan.hint("merge"), F.col("node") == F.col("_of"), "left")
    named = chains.select("node", F.col("conv_id").alias("_conv"), F.col("n_convs").alias("_n"), "top", "bottom", F.col("above").alias("_above")).join(figures.hint("merge"), "node")

    lasts = rows.where("_last").select("conv_id", *keys).unionByName(counts.where("n_turns = 0").select("conv_id", F.lit(0).cast("bigint").alias("depth"), *zero))
    bucket = F.floor(F.col("conv_id") / SPAN).alias("_bucket")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("_ids")
    ends = _digests(lasts.groupBy(*keys, bucket).agg(joined), parts)

    inner = F.col("depth") > F.col("top")
    told = nodes.join(named.hint("merge"), (F.col("conv_id") == F.col("_conv")) & (F.col("n_convs") == F.col("_n"))).join(ends.hint("merge"), keys, "left")
    out = told.select(
        "conv_id", "depth", F.when(inner, F.col("conv_id")).otherwise(F.col("_over")).alias("parent_conv_id"), "n_convs",
        F.when(F.col("depth") < F.col("bottom"), 1).otherwise(F.coalesce("_fan", F.lit(0))).cast("bigint").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("n_convs") - 1) * (F.col("above") - F.col("_above"))).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        F.col("behind").alias("enter_behind"),
    )
    result = scratch.table(out)
    scratch.drop_others(result)
    return result


def shared_prefixes(conversations: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """``prefix_trie`` of conversations (conv_id, turn, role, text) that ``rebuilt`` gives a shared beginning.

    Null roles and texts are empty, rows that repeat are turns of their own, rows without conv_id are left out, other columns
    don't matter. An empty table gives no row.
    """
    turns, counts = rebuilt(numbered_turns(conversations), family, most)
    return prefix_trie(turns, counts)
