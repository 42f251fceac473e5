"""The corpus of a query is built once."""

from provgraph.operators import corpora as K
from provgraph.plans.registry import QUERIES


def test_corpus_is_built_once(spark, monkeypatch):
    calls, own = [], K.corpus_builder
    monkeypatch.setattr(K, "corpus_builder", lambda *a, **k: (calls.append(1), own(*a, **k))[1])
    assert QUERIES["c16_corpus_builder"](spark, "/root/testdata/sf0.001").count() > 0 and len(calls) == 1
