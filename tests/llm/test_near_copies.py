"""Near copies of one template that mostly don't link: the pairs that are compared grow with the rows, and no link is lost."""

from __future__ import annotations

import random

import pytest

from provgraph.llm import neardup


def brute(texts: list[tuple[int, str]], words: int, percent: int) -> dict[int, int]:
    """The smallest id of each text's class by all pairs."""
    sets = {doc: {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} for doc, text in texts for w in [text.split()]}
    above = {doc: doc for doc in sets}

    def root(x: int) -> int:
        while above[x] != x:
            x = above[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                above[y] = x
    return {doc: root(doc) for doc in sets}


@pytest.fixture(scope="module")
def copies() -> list[tuple[int, str]]:
    """One text of 150 words with up to 8 of them changed, some cut short."""
    draw = random.Random(7)
    template, texts = [f"w{i}" for i in range(150)], []
    for doc in range(500):
        held = list(template)
        for k in draw.sample(range(150), draw.randint(0, 8)):
            held[k] = f"x{doc}_{k}"
        texts.append((doc, " ".join(held[: draw.choice((150, 150, 125, 100))])))
    return texts


def test_pairs_of_near_copies(spark, copies, monkeypatch):
    counts, own = [], neardup.likely_pairs

    def counted(pairs, *rest, **named):
        counts.append(pairs.count())
        return own(pairs, *rest, **named)

    monkeypatch.setattr(neardup, "likely_pairs", counted)
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(spark.createDataFrame(copies, "doc_id bigint, text string"), 4, 80).collect()}
    assert got == brute(copies, 4, 80)
    assert sum(counts) <= 16 * len(copies), counts


def test_linkable_keeps_every_link(spark, copies):
    """Where each set is a component of its own, every pair that links passes the bounds."""
    shingle = neardup.Shingler(4)
    sets = [shingle(text) for _, text in copies[:120]]
    full = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "node bigint, shingles binary")
    sizes = spark.createDataFrame([(i, len(x)) for i, x in enumerate(sets)], "node bigint, n bigint")
    able = neardup.linkable(full, sizes, sizes.selectExpr("node", "node as component"), 80, neardup.Scratch(spark))
    both = able.alias("x").crossJoin(able.alias("y")).where(f"x.node < y.node and {neardup.may_link('x.', 'y.', 80)}").selectExpr("x.node as a", "y.node as b")
    passed = {(r.a, r.b) for r in both.collect()}
    common = {(a, b): len(set(sets[a]) & set(sets[b])) for a in range(120) for b in range(a + 1, 120)}
    links = {(a, b) for (a, b), c in common.items() if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c)}
    assert links and links <= passed and len(passed) < 1.5 * len(links) + 120
