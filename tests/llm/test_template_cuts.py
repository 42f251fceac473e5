"""Near duplicates where many texts are cut from one: everything is alike, little is a copy. The work has to stay in proportion."""

from __future__ import annotations

import random

import pytest
from test_operators import classes

from provgraph.llm import neardup


def cuts(rows, gaps=6, words=14, seed=1):
    """A text of 300 words, and the text with ``gaps`` runs of words missing at random places."""
    r = random.Random(seed)
    base = [f"w{i}" for i in range(300)]
    out = [(0, " ".join(base))]
    for i in range(1, rows):
        gone = {j for at in (r.randrange(301 - words) for _ in range(gaps)) for j in range(at, at + words)}
        out.append((i, " ".join(w for j, w in enumerate(base) if j not in gone)))
    return out


@pytest.fixture
def compared(monkeypatch):
    """The numbers of pairs that rounds compare."""
    counts, own = [], neardup.likely_pairs

    def counted(pairs, *more):
        counts.append(pairs.count())
        return own(pairs, *more)

    monkeypatch.setattr(neardup, "likely_pairs", counted)
    return counts


@pytest.mark.parametrize(("rows", "gaps", "words"), [(40, 6, 14), (500, 6, 14), (250, 3, 9)])
def test_cuts_of_a_template(spark, compared, rows, gaps, words):
    """Classes as by all pairs; no more than about two comparisons for each of a set's 32 keys, and few rounds."""
    texts = cuts(rows, gaps, words)
    got = neardup.near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string"), 4, 80).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == classes(texts, 4, 80) and len(got) == rows
    assert sum(compared) <= 64 * rows and len(compared) <= 2 + rows.bit_length()


def test_many_rows_of_one_id(spark, compared):
    """Different texts and copies under one id: a text is only read again for its own set."""
    texts = [(7, t) for _, t in cuts(150, 6, 14, 2)] + [(7, cuts(2)[1][1])] * 100 + [(8, cuts(2)[1][1]), (None, "a b c d e f")]
    got = neardup.near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string"), 4, 80).collect()
    assert len(got) == len(texts) and {x.component_id for x in got if x.doc_id is not None} == {7} and sum(compared) <= 64 * 150
    assert [x.component_id for x in got if x.doc_id == 8] == [7] and not any(x.kept for x in got if x.doc_id == 8)
