"""The prefix trie of conversations against plain Python and SQL."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import oracle
import pytest

from provgraph.llm import queries as Q
from provgraph.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, _p int"


def plain(rows):
    """{(conv_id, depth): the other columns} by sets of members."""
    convs, new, members, kids, leaves, saved, out = defaultdict(list), {}, defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int), {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(said)] for c, said in convs.items()}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        new[c] = convs.get(c - c % 5, [])[:h] + own[h:]
        for d in range(len(new[c]) + 1):
            members[tuple(new[c][:d])].append(c)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    for path, found in members.items():
        for d in range(len(path) + 1):
            saved[path[:d]] += (len(found) - 1) * (len(path[-1][1].encode()) if path else 0)
            leaves[path[:d]] += path not in kids
    for path, found in members.items():
        ends = ",".join(str(c) for c in sorted(found) if len(new[c]) == len(path))
        out[min(found), len(path)] = (min(members[path[:-1]]) if path else None, len(found), kids[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest())
    return out


def told(df):
    rows = df.collect()
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(got) == len(rows)
    return got


def odd_rows():
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None, "longer text"])) for c in range(60) for t in range(rng.randrange(1, 14))]
    rows += [(c, None, "user", "no turn") for c in range(0, 60, 7)] + [(None, 1, "user", "nobody")] * 3 + rows[:40]
    rows += [(1000 + c, t, "user", "hot") for c in range(80) for t in range(3)]  # one beginning that many share
    rows += [(2000, t, "assistant", f"turn {t % 3}") for t in range(400)] + [(2003, t, "assistant", f"turn {t % 3}") for t in range(300)]
    rows += [(5000 + 4 * k, 0, "user", "x") for k in range(9)]  # families without a source: some are turnless
    rng.shuffle(rows)
    return [(*r, "other", 1) for r in rows]


def test_against_sets_of_members(spark):
    rows = odd_rows()
    want = plain(rows)
    assert any(d == 0 for _, d in want) and told(trie.shared_prefixes(spark.createDataFrame(rows, SCHEMA))) == want


def test_long_list_of_ends(spark, monkeypatch):
    """Ids that end at one node come together from many ranges."""
    monkeypatch.setattr(trie, "SPAN", 3)
    rows = [(c, 0, "user", "same") for c in range(0, 400, 5)]
    assert told(trie.shared_prefixes(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))) == plain(rows)


def test_empty(spark):
    assert trie.shared_prefixes(spark.createDataFrame([], SCHEMA)).count() == 0
    one = told(trie.shared_prefixes(spark.createDataFrame([(7, None, None, None, None, None)], SCHEMA)))
    assert one == plain([(7, None, None, None)])


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_op11_equals_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    assert oracle.difference(Q.op11_euler_tour(spark, path), oracle.connect(path), Q.OP11_SQL) == ""
