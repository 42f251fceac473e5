"""Ordered patterns against a plain loop."""

import random

from provgraph.operators import chains as T


def matched(edges, want):
    out, now = [], []
    for edge, triple in sorted(edges):
        if triple == want[len(now)]:
            now = [*now, edge]
        if len(now) == len(want):
            out, now = [*out, now], []
    return out


def test_matches_over_blocks(spark):
    """One graph spans several blocks, and so do passes of its rules."""
    r = random.Random(7)
    edges = [("hot", 1, i, r.choice("abcd")) for i in range(3000)] + [(f"g{g}", 1, i, r.choice("abcd")) for g in range(20) for i in range(g)] + [(None, 1, i, "ab"[i % 2]) for i in range(7)]
    rules = {"one": "a", "two": "ab", "again": "aab", "long": "abcda"}
    table = spark.createDataFrame(edges, "graph_id string, stage int, edge_id bigint, triple string").repartition(5)
    steps = spark.createDataFrame([(name, i + 1, t) for name, want in rules.items() for i, t in enumerate(want)], "rule string, step int, triple string")
    expected = {(g, 1, name, no + 1, tuple(m)) for g in {e[0] for e in edges} for name, want in rules.items() for no, m in enumerate(matched([(e[2], e[3]) for e in edges if e[0] == g], want))}
    for blocks in (16, None):
        found = [(*x[:4], tuple(x.edge_ids)) for x in T.match_sequences(table, steps, blocks).collect()]
        assert len(found) == len(expected) and set(found) == expected


def test_similar_subsequences(spark):
    """Against a plain loop, with and without contexts."""
    r = random.Random(31)
    rows = [(f"a{i % 4}", i, f"i{i}", r.choice("xyz"), [r.gauss(0, 1) for _ in range(3)]) for i in range(60)]
    table = spark.createDataFrame(rows, "actor string, pos int, item string, tactic string, vec array<double>")
    told = {f"i{i}": ([[r.choice("pq")], [r.choice("st")]], r.choice([0.0, 0.5]), r.random() < 0.5) for i in range(0, 60, 2)}
    contexts = spark.createDataFrame([(i, *c) for i, c in told.items()], "id string, sets array<array<string>>, privilege double, impact boolean")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    cos = lambda a, b: dot(a, b) / (dot(a, a) ** 0.5 * dot(b, b) ** 0.5)

    def hybrid(i, j, a, b, use):
        if not use or i not in told or j not in told:
            return cos(a, b)
        (s, p, m), (t, q, n) = told[i], told[j]
        parts = [len(set(x) & set(y)) / len(set(x) | set(y)) for x, y in zip(s, t)] + [1 - abs(p - q), float(m == n)]
        return 0.65 * cos(a, b) + 0.35 * sum(parts) / len(parts)

    for use in (False, True):
        expected = {}
        for actor, _, item, tactic, vec in rows:
            found = []
            for other in {x[0] for x in rows} - {actor}:
                chain = [x for x in rows if x[0] == other]
                for n in (2, 3):
                    for run in (chain[k : k + n] for k in range(len(chain) - n + 1)):
                        if tactic in {x[3] for x in run}:
                            mean = [sum(x[4][d] for x in run) / n for d in range(3)]
                            sim = round(0.65 * cos(vec, mean) + 0.35 * max(hybrid(item, x[2], vec, x[4], use) for x in run), 6)
                            found.append((-sim, other, ">".join(x[2] for x in run)))
            expected[item] = [(a, s, -sim) for sim, a, s in sorted(found)[:2]]
        got = {}
        for x in T.similar_subsequences(table.select("item", "actor", "tactic", "vec"), table, k=2, contexts=contexts if use else None).orderBy("item", "rank").collect():
            got.setdefault(x.item, []).append((x.actor, x.seq, x.sim))
        assert {i: [(a, s) for a, s, _ in v] for i, v in got.items()} == {i: [(a, s) for a, s, _ in v] for i, v in expected.items()}
        assert all(abs(p[2] - q[2]) < 2e-6 for i in got for p, q in zip(got[i], expected[i]))


def test_fill_missing_tactics(spark):
    """10,000 candidates of one tactic over many blocks, ties, chains without a vector and full chains, against a plain loop with its moving anchor."""
    r = random.Random(13)
    point = lambda: [round(r.gauss(0, 1), 2) for _ in range(3)]
    offered = [(f"c{i:05}", "x", point()) for i in range(10_000)] + [(f"t{i}", "x", [1.0, 0.0, 0.0]) for i in range(20)] + [(f"y{i}", "y", point()) for i in range(30)] + [("null", "y", None), (None, "y", [1.0, 1.0, 1.0])]
    chains = {"one": [("a", "w", [2.0, 0.0, 0.0])], "full": [(f"f{i}", "w", point()) for i in range(4)], "has": [("h", "x", point()), ("i", "w", point())], "blank": [("b", "w", None)]} | {f"k{i}": [(f"k{i}", "w", point())] for i in range(25)}
    rows = [(c, p, *item) for c, items in chains.items() for p, item in enumerate(items)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    near = lambda a, b: 0.0 if a is None else -round(dot(a, b) / (dot(a, a) ** 0.5 * dot(b, b) ** 0.5), 9)
    for essential in (["x", "y", "z"], ["y", "x"]):
        expected = {c: list(items) for c, items in chains.items()}
        for tactic in essential:
            for items in expected.values():
                found = [x for x in offered if x[1] == tactic and x[0] is not None and x[2] is not None]
                if len(items) < 4 and found and tactic not in {x[1] for x in items}:
                    items.append(min(found, key=lambda x: (near(items[-1][2], x[2]), x[0])))
        table = spark.createDataFrame(rows, "chain_id string, pos int, item string, tactic string, vec array<double>")
        got = T.fill_missing_tactics(table, spark.createDataFrame(offered, "item string, tactic string, vec array<double>"), essential, 4, 700)
        told = {}
        for x in got.orderBy("chain_id", "pos").collect():
            told.setdefault(x.chain_id, []).append((x["item"], x.tactic))
        assert told == {c: [x[:2] for x in items] for c, items in expected.items()}
