"""Ordered chains of techniques and ordered-pattern rules.

A chain is a table (chain_id, pos, item); vectors are (id, vec); contexts are (id, sets, privilege, impact) where ``sets`` is
an array of string arrays. Rows with a null key match nothing and empty tables give no rows, unless an operator says otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from provgraph.functions.names import TACTICS, bridge_hint, tactic_rank
from provgraph.operators.evaluate import cosine
from provgraph.operators.nearest import near_best
from provgraph.session import Scratch, materialize


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; null where both are empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def context_similarity(a_sets: Column, b_sets: Column, a_privilege: Column, b_privilege: Column, a_impact: Column, b_impact: Column) -> Column:
    """Mean of the sets' Jaccard similarities (empty pairs are passed over), 1 - |difference of privilege| and equality of impact."""
    parts = F.filter(F.zip_with(a_sets, b_sets, jaccard), lambda x: x.isNotNull())
    parts = F.concat(parts, F.array((1 - F.abs(a_privilege - b_privilege)).cast("double"), (a_impact == b_impact).cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(parts)


def hybrid_similarity(pairs: DataFrame, vectors: DataFrame, contexts: DataFrame, alpha: float = 0.65) -> DataFrame:
    """Pairs (src, dst, ...) with ``similarity``: alpha * cosine + (1 - alpha) * context similarity.

    A pair with an end that has no vector or context has a null similarity.
    """
    known = vectors.select("id", "vec").join(contexts.select("id", "sets", "privilege", "impact"), "id")
    side = lambda c: known.select(F.col("id").alias(c), *(F.col(x).alias(f"_{c}_{x}") for x in ("vec", "sets", "privilege", "impact")))
    both = pairs.join(side("src"), "src", "left").join(side("dst"), "dst", "left")
    context = context_similarity(*(F.col(f"_{c}_{x}") for x in ("sets", "privilege", "impact") for c in ("src", "dst")))
    score = alpha * cosine(F.col("_src_vec"), F.col("_dst_vec")) + (1 - alpha) * context
    known_both = F.col("_src_vec").isNotNull() & F.col("_dst_vec").isNotNull()
    return both.select(*pairs.columns, F.round(F.when(known_both, score), 6).alias("similarity"))


def consecutive(chain: DataFrame) -> DataFrame:
    """(chain_id, pos, src, dst): every two neighbours of a chain."""
    by = Window.partitionBy("chain_id").orderBy("pos")
    return chain.select("chain_id", "pos", F.col("item").alias("src"), F.lead("item").over(by).alias("dst")).where("dst is not null")


def score_transitions(chain: DataFrame, vectors: DataFrame, contexts: DataFrame, external: DataFrame | None = None, alpha: float = 0.55, threshold: float = 0.8) -> DataFrame:
    """(chain_id, pos, src, dst, score, kept): neighbours' hybrid similarity, blended with an external score (src, dst, external) where there is one; halves round up (by 1e-9)."""
    scored = hybrid_similarity(consecutive(chain), vectors, contexts)
    if external is None:
        blended = scored.withColumn("score", F.col("similarity"))
    else:
        outside = external.select("src", "dst", "external")
        blended = scored.join(outside, ["src", "dst"], "left").withColumn("score", F.coalesce(F.round(alpha * F.col("external") + (1 - alpha) * F.col("similarity") + 1e-9, 6), "similarity"))
    return blended.select("chain_id", "pos", "src", "dst", "score", (F.col("score") >= threshold).alias("kept"))


def hint_bridges(transitions: DataFrame, contexts: DataFrame) -> DataFrame:
    """Transitions (chain_id, pos, src, dst, ...) with ``bridge_hint``, the entity that joins the ends' first tactics (contexts: id, tactics, capabilities)."""
    side = lambda c: contexts.select(F.col("id").alias(c), F.get("tactics", F.lit(0)).alias(f"_{c}_t"), F.col("capabilities").alias(f"_{c}_c")).hint("merge")
    both = transitions.join(side("src"), "src", "left").join(side("dst"), "dst", "left")
    caps = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    return both.select(*transitions.columns, bridge_hint(F.col("_src_t"), F.col("_dst_t"), caps("_src_c"), caps("_dst_c")).alias("bridge_hint"))


def order_chain(items: DataFrame, max_len: int = 8, order: list[str] = TACTICS) -> DataFrame:
    """(actor, pos, item): an actor's items (actor, item, tactics, kb_pos) by tactic, then by their place in the table; ``max_len`` at most."""
    by = Window.partitionBy("actor").orderBy(tactic_rank(F.col("tactics"), order), "kb_pos")
    return items.withColumn("pos", F.row_number().over(by)).where(F.col("pos") <= max_len).select("actor", "pos", "item")


def one_per_tactic(chain: DataFrame) -> DataFrame:
    """Chain rows (chain_id, pos, item, tactic, ...) that are the first of their tactic."""
    first = Window.partitionBy("chain_id", "tactic").orderBy("pos")
    return chain.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def fill_missing_tactics(chain: DataFrame, candidates: DataFrame, essential: Sequence[str], max_len: int = 10, block_rows: int = 4096) -> DataFrame:
    """Chain (chain_id, pos, item, tactic, vec) with, for each essential tactic that it lacks, the candidate (item, tactic, vec) nearest to its last item.

    Tactics are filled in the given order; each time the item just added is the new last one. A chain of ``max_len`` takes
    no more. Nearness is the cosine to 9 places, ties go to the smaller item; a chain whose last item has no vector takes the
    smallest item. Candidates without an item or vector are not offered, and a chain without any offered stays as it is.

    One round a tactic. Its candidates and the open chains meet in blocks (``near_best``), each in a task of its own, which gives
    a few candidates a chain; so what meets by chain is a few rows a block and no task holds all candidates of a tactic. Each round's chains are written.
    """
    scratch = Scratch(chain.sparkSession)
    chain = scratch.table(chain.select("chain_id", "pos", "item", "tactic", "vec"))
    offers = scratch.table(candidates.where("item is not null and vec is not null").where(F.col("tactic").isin(list(essential))).select(F.col("item").alias("_item"), F.col("tactic").alias("_of"), F.col("vec").alias("_back")))
    for tactic in dict.fromkeys(essential):
        state = chain.groupBy("chain_id").agg(F.count("*").alias("_n"), F.max_by("vec", "pos").alias("_vec"), F.max("pos").alias("_last"), F.count_if(F.col("tactic") == tactic).alias("_has"))
        open_chains = state.where((F.col("_has") == 0) & (F.col("_n") < max_len)).select("chain_id", "_vec", "_last", F.lit(0).alias("_all"))
        offered = offers.where(F.col("_of") == tactic).select("_item", F.col("_back").alias("_vec"), "_back", F.lit(0).alias("_all"))
        near = near_best(open_chains, offered, ["_all"], 1, ["chain_id", "_last"], ["_item"], offered_rows=block_rows)
        nearest = F.struct((-F.round("score", 9)).alias("_far"), "_item")
        best = near.groupBy("chain_id").agg(F.min_by(F.struct("_item", F.col("_back").alias("_cvec"), "_last"), nearest).alias("_b"))
        added = best.select("chain_id", (F.col("_b._last") + 1).alias("pos"), F.col("_b._item").alias("item"), F.lit(tactic).alias("tactic"), F.col("_b._cvec").alias("vec"))
        step = scratch.table(chain.unionByName(added))
        scratch.drop(chain)
        chain = step
    scratch.drop(offers)
    return chain


def drop_weak_stages(chain: DataFrame, pair_scores: DataFrame, threshold: float = 0.8, min_len: int = 4) -> DataFrame:
    """(chain_id, kept, removed): a left-to-right fold over each chain (chain_id, pos, item).

    A middle item goes if the score from the item before it is under the threshold, the score that skips it is no less, and
    at least ``min_len`` items stay; the ends stay. Scores are (chain_id, src, dst, score); a missing one is 0.
    """
    key = lambda a, b: F.concat_ws("\x1f", a, b)
    scores = pair_scores.groupBy("chain_id").agg(F.map_from_entries(F.collect_set(F.struct(key("src", "dst").alias("k"), F.col("score").cast("double").alias("v")))).alias("_s"))
    items = chain.groupBy("chain_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias("_i"))
    joined = items.join(scores, "chain_id", "left").withColumn("_s", F.coalesce("_s", F.create_map().cast("map<string,double>")))
    score = lambda a, b: F.coalesce(F.element_at(F.col("_s"), key(a, b)), F.lit(0.0))
    size = F.size("_i")

    def step(state: Column, at: Column) -> Column:
        kept, removed = state["kept"], state["removed"]
        item, following, last = F.element_at(F.col("_i"), at), F.element_at(F.col("_i"), at + 1), F.element_at(kept, -1)
        weak = (score(last, item) < threshold) & (score(last, following) >= score(last, item)) & (size - F.size(removed) - 1 >= min_len)
        return F.struct(F.when(weak, kept).otherwise(F.concat(kept, F.array(item))).alias("kept"), F.when(weak, F.concat(removed, F.array(item))).otherwise(removed).alias("removed"))

    middle = F.when(size > 2, F.sequence(F.lit(2), size - 1)).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.slice("_i", 1, 1).alias("kept"), F.slice("_i", 1, 0).alias("removed"))
    folded = joined.withColumn("_f", F.aggregate(middle, start, step))
    end = F.when(size > 1, F.slice("_i", -1, 1)).otherwise(F.slice("_i", 1, 0))
    return folded.select("chain_id", F.concat("_f.kept", end).alias("kept"), F.col("_f.removed").alias("removed"))


def check_precedence(sequence: DataFrame, a: str, b: str) -> DataFrame:
    """(graph_id, ok) of (graph_id, pos, tactic): the first ``a`` isn't after the first ``b``; true where either is absent."""
    first = lambda x: F.min(F.when(F.col("tactic") == x, F.col("pos")))
    return sequence.groupBy("graph_id").agg(F.coalesce(first(a) <= first(b), F.lit(True)).alias("ok"))


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ordered edges (graph_id, stage, rule, _want, edge_id, triple, _block): those that hit, and a last row a run (``_end``).

    ``_step`` and ``_no`` have a place for every state that the run may start from: the step hit (0 for none) and the passes
    completed before it, or for the last row the state reached and all passes.
    """
    run, now, done, lead, schema = None, [], [], None, None

    def rows(cells: list[tuple]) -> pa.RecordBatch:
        keys = [pa.array([c[i] for c in cells], schema.field(name).type) for i, name in enumerate(("graph_id", "stage", "rule", "_block", "edge_id"))]
        kinds = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.bool_())
        return pa.RecordBatch.from_arrays([*keys, *(pa.array([c[5 + i] for c in cells], t) for i, t in enumerate(kinds))], names=["graph_id", "stage", "rule", "_block", "edge_id", "_no", "_step", "_end"])

    for batch in batches:
        schema, out = batch.schema, []
        for graph, stage, rule, want, edge, triple, block in zip(*(c.to_pylist() for c in batch.columns)):
            if run != (graph, stage, rule):
                if run is not None:
                    out.append((*run, lead, None, done, now, True))
                run, now, done, lead = (graph, stage, rule), list(range(len(want))), [0] * len(want), block
            steps = [at + 1 if want[at] == triple else 0 for at in now]
            if any(steps):
                out.append((*run, block, edge, list(done), steps, False))
                for i, step in enumerate(steps):
                    if step == len(want):
                        now[i], done[i] = 0, done[i] + 1
                    elif step:
                        now[i] = step
        yield rows(out)
    if run is not None:
        yield rows([(*run, lead, None, done, now, True)])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the runs of each (graph, stage, rule) in order (``_r``): the state and the passes that each starts from, as ``_starts``."""
    for batch in batches:
        out = []
        for runs in batch.column(3).to_pylist():
            state, base, starts = 0, 0, []
            for r in runs:
                starts.append({"_block": r["_block"], "_from": state, "_base": base})
                state, base = r["_step"][state], base + r["_no"][state]
            out.append(starts)
        kind = pa.list_(pa.struct([("_block", pa.int32()), ("_from", pa.int32()), ("_base", pa.int64())]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, kind)], names=["graph_id", "stage", "rule", "_starts"])


def match_sequences(edges: DataFrame, rules: DataFrame, blocks: int | None = None) -> DataFrame:
    """(graph_id, stage, rule, match_no, edge_ids): greedy left-to-right matches of ordered triples.

    Edges are (graph_id, stage, edge_id, triple), rules (rule, step from 1, triple). The state waits for a step's triple,
    takes the first edge that has it, emits the edges of a full pass and starts again; a partial tail is dropped. Edges of a
    rule's own triples are dealt by range into ``blocks`` (the shuffle partitions by default), so that a large graph spans
    several; each block is followed from every state, and only its end states are chained by (graph, stage, rule).
    """
    wants = rules.groupBy("rule").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "triple"))), lambda x: x["triple"]).alias("_want"))
    of_rule = rules.select("rule", "triple").distinct().join(wants.hint("merge"), "rule")
    taken = edges.select("graph_id", "stage", F.col("edge_id").cast("bigint").alias("edge_id"), "triple").join(F.broadcast(of_rule), "triple").select("graph_id", "stage", "rule", "_want", "edge_id", "triple")
    order = ["graph_id", "stage", "rule", "edge_id", "triple"]
    dealt = taken.repartitionByRange(blocks, *order) if blocks else taken.repartitionByRange(*order)
    placed = dealt.withColumn("_block", F.spark_partition_id()).sortWithinPartitions(*order)
    kinds = {f.name: f for f in placed.schema.fields}
    fields = StructType([*(StructField(n, kinds[n].dataType) for n in ("graph_id", "stage", "rule", "_block", "edge_id")), *StructType.fromDDL("_no array<bigint>, _step array<int>, _end boolean").fields])
    traced = materialize(placed.mapInArrow(_traced, fields))  # a block's number holds for one run only
    runs = traced.where("_end").groupBy("graph_id", "stage", "rule").agg(F.array_sort(F.collect_list(F.struct("_block", "_step", "_no"))).alias("_r"))
    starts = runs.mapInArrow(_chained, StructType([*fields.fields[:3], *StructType.fromDDL("_starts array<struct<_block:int,_from:int,_base:bigint>>").fields]))
    each = starts.select(*(F.col(c).alias(f"_{c}") for c in order[:3]), F.explode("_starts").alias("_s")).select("_graph_id", "_stage", "_rule", F.col("_s._block").alias("_at"), "_s._from", "_s._base")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in order[:3]]
    hits = traced.where("not _end").join(each.hint("merge"), [*same, F.col("_block") == F.col("_at")])
    step, number = F.get("_step", F.col("_from")), F.get("_no", F.col("_from")) + F.col("_base") + 1
    passes = hits.select(*order[:3], number.alias("match_no"), step.alias("_hit"), "edge_id", F.size("_step").alias("_len")).where("_hit > 0")
    full = passes.groupBy(*order[:3], "match_no").agg(F.array_sort(F.collect_list(F.struct("_hit", "edge_id"))).alias("_e"), F.first("_len").alias("_len")).where(F.size("_e") == F.col("_len"))
    return full.select(*order[:3], "match_no", F.transform("_e", lambda x: x["edge_id"]).alias("edge_ids"))


def rule_coverage(matches: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, stage, coverage): share of a stage's nodes that matched edges touch; edges have (graph_id, stage, edge_id, src, dst)."""
    hit = matches.select("graph_id", "stage", F.explode("edge_ids").alias("edge_id")).distinct().withColumn("_hit", F.lit(1))
    ends = edges.join(hit.hint("merge"), ["graph_id", "stage", "edge_id"], "left").select("graph_id", "stage", F.explode(F.array("src", "dst")).alias("node"), F.coalesce("_hit", F.lit(0)).alias("_hit"))
    nodes = ends.groupBy("graph_id", "stage", "node").agg(F.max("_hit").alias("_hit"))
    return nodes.groupBy("graph_id", "stage").agg(F.round(F.avg("_hit"), 6).alias("coverage"))


def similar_subsequences(items: DataFrame, chains: DataFrame, max_len: int = 3, k: int = 1, alpha: float = 0.65, contexts: DataFrame | None = None, blocks: int = 16) -> DataFrame:
    """(item, actor, seq, sim, rank): runs of 2 to ``max_len`` neighbours in other actors' chains that hold an item's tactic, nearest first.

    Items are (item, actor, tactic, vec), chains (actor, pos, item, tactic, vec). ``sim`` is alpha * cosine with the run's mean
    vector + (1 - alpha) * the largest similarity with one of its members: the hybrid one with ``contexts`` (id, sets, privilege,
    impact), else and where an end has none the cosine. Without contexts items and runs of a tactic meet as matrices (``near_best``); with them a tactic's runs are dealt into ``blocks``, each gives its best k, and these meet
    by item, so a common tactic is many tasks. Nulls in tactic or vec match nothing; empty tables give no row.
    """
    if contexts is not None:
        known = contexts.select(F.col("id").alias("item"), F.struct("sets", "privilege", "impact").alias("_ctx"))
        items, chains = items.join(known.hint("merge"), "item", "left"), chains.join(known.hint("merge"), "item", "left")
    own = [F.col("_ctx")] if contexts is not None else []
    by = Window.partitionBy("actor").orderBy("pos")
    ahead = F.collect_list(F.struct("item", "tactic", "vec", *own)).over(by.rowsBetween(0, max_len - 1))
    runs = chains.where("vec is not null").select("actor", "pos", ahead.alias("_a")).withColumn("_n", F.explode(F.sequence(F.lit(2), F.lit(max_len)))).where(F.size("_a") >= F.col("_n"))
    runs = runs.select(F.col("actor").alias("other"), F.slice("_a", F.lit(1), F.col("_n")).alias("_r"), F.pmod(F.xxhash64("actor", "pos", "_n"), F.lit(blocks)).cast("int").alias("_block"))
    seq = F.array_join(F.transform("_r", lambda x: x["item"].cast("string")), ">")
    if contexts is None:
        met = runs.select("other", seq.alias("seq"), F.transform("_r", lambda x: x["vec"]).alias("_vecs"), F.col("other").alias("_owner"), F.explode(F.array_distinct(F.transform("_r", lambda x: x["tactic"]))).alias("tactic"))
        asked = items.where("actor is not null and vec is not null").select("item", "tactic", F.col("vec").alias("_vec"), F.col("actor").alias("_own"))
        near = near_best(asked, met.where("other is not null"), ["tactic"], k, ["item"], ["other", "seq"], alpha, 32_768, 4096)
        ranked = near.select("item", F.col("other").alias("actor"), "seq", F.round("score", 6).alias("sim"))
        return ranked.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("sim"), "actor", "seq"))).where(F.col("rank") <= k)
    zeros = F.transform(F.get("_r", F.lit(0))["vec"], lambda x: F.lit(0.0))
    total = F.aggregate("_r", zeros, lambda s, x: F.zip_with(s, x["vec"], lambda p, q: p + q.cast("double")))
    runs = runs.withColumn("_mean", F.transform(total, lambda x: x / F.size("_r"))).withColumn("tactic", F.explode(F.array_distinct(F.transform("_r", lambda x: x["tactic"]))))
    asked = items.select("item", "actor", "tactic", "vec", *(c.alias("_own") for c in own), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    pairs = asked.join(runs.hint("shuffle_hash"), ["tactic", "_block"]).where("actor != other")

    def alike(x: Column) -> Column:
        near = cosine(F.col("vec"), x["vec"])
        if contexts is None:
            return near
        a, b = F.col("_own"), x["_ctx"]
        context = context_similarity(a["sets"], b["sets"], a["privilege"], b["privilege"], a["impact"], b["impact"])
        return F.coalesce(0.65 * near + 0.35 * context, near)

    nearest = F.array_max(F.transform("_r", alike))
    scored = pairs.select("item", F.col("other").alias("actor"), seq.alias("seq"), "_block", F.round(alpha * cosine(F.col("vec"), F.col("_mean")) + (1 - alpha) * nearest, 6).alias("sim"))
    best = lambda *keys: F.row_number().over(Window.partitionBy("item", *keys).orderBy(F.desc("sim"), "actor", "seq"))
    top = scored.withColumn("rank", best("_block")).where(F.col("rank") <= k).drop("_block")
    return top.withColumn("rank", best()).where(F.col("rank") <= k).select("item", "actor", "seq", "sim", "rank")
