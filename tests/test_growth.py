"""Work in proportion to the input where keys are common: hubs, copies and large groups."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from provgraph.operators import corpora as K
from provgraph.operators import evaluate as M


def shuffled(spark):
    """Bytes that the session has written to shuffles."""
    held = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(held.apply(i).totalShuffleWrite() for i in range(held.size()))


def test_sample_bfs_at_a_hub(spark):
    """2,000 seeds near one node of 20,000 edges: what is shuffled goes with edges and samples, not with their product."""
    edges = spark.range(20_000).selectExpr("id as edge_id", "-1L as src", "id % 2000 as dst").unionByName(spark.range(20_000, 22_000).selectExpr("id as edge_id", "id as src", "id % 2000 as dst"))
    seeds = spark.range(20_000, 22_000).selectExpr("id as sample_id", "id as node")
    before = shuffled(spark)
    got = K.sample_bfs(edges, seeds, 62, 30).groupBy("sample_id").agg(F.count_distinct("edge_id").alias("n"), F.max("hop").alias("hop")).collect()
    assert len(got) == 2000 and {(x.n, x.hop) for x in got} == {(62, 3)}
    assert shuffled(spark) - before < 100e6


def test_nearest_of_a_large_group(spark):
    """30,000 candidates of one group, 20 copies of each vector: as by Spark's own cosine on a few items, and each of 30,000 items is answered in one go."""
    r = np.random.default_rng(3)
    distinct = r.normal(size=(1500, 16)).astype("f4").tolist()
    rows = [(i, distinct[i % 1500], 0) for i in range(30_000)] + [(30_000, None, 0), (30_001, [float("nan")] * 16, 0), (30_002, [0.0] * 16, 0), (30_003, [1.0], 0), (30_004, [1.0, None], 0)]
    table = spark.createDataFrame(rows, "id int, vec array<float>, grp int").repartition(4)
    few = table.where("id % 7500 = 3 or id >= 30000")
    not_these = few.selectExpr("id", "id + 1500 as candidate")
    pairs = few.selectExpr("id", "vec as a").crossJoin(table.selectExpr("id as candidate", "vec as b")).where("id != candidate").join(not_these, ["id", "candidate"], "left_anti")
    scored = pairs.select("id", "candidate", F.round(M.cosine(F.col("a"), F.col("b")), 6).alias("sim"))
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("sim"), "candidate"))
    want = scored.withColumn("rank", best).where("rank <= 3")
    before = shuffled(spark)
    got = M.nearest_in_group(few, table, 3, not_these)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    every = M.nearest_in_group(table.where("id < 30000"), table, 2)
    assert every.groupBy("rank").count().collect() and every.where("id % 1500 != candidate % 1500 and candidate < 30000").count() == 0
    assert shuffled(spark) - before < 200e6


def test_bands_use_every_label(spark):
    """30,000 labelled texts of one length: the bands are those of all of them (before, 20,000 were looked at)."""
    import zstandard

    from provgraph.llm import quality

    r = np.random.default_rng(4)
    words = [f"w{n:x}" for n in r.permutation(4000)]
    texts = [" ".join(words[i] for i in r.integers(0, 40 + n % 400, 60)) for n in range(30_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    labels = spark.range(30_000).selectExpr("id as doc_id", "case when id % 10 < 9 then 1 else 0 end as quality")
    bands = quality.fit_bands(docs, labels)
    ratios = {}
    for n, text in enumerate(texts):
        raw = text.encode()
        if n % 10 < 9 and not quality.base_rules(raw, text)[-1]:
            ratios.setdefault(int(2 * np.log2(len(raw))), []).append(len(zstandard.ZstdCompressor(level=3, write_content_size=False).compress(raw)) / len(raw))
    c, held = max(ratios.items(), key=lambda x: len(x[1]))
    held.sort()
    _, low, high = next(b for b in bands if b[0] == int(np.ceil(2 ** (c / 2))))
    at = lambda x, bound: abs(np.searchsorted(held, x) - bound * len(held)) <= 2e-4 * len(held) + held.count(x) + 3
    assert len(held) > 20_000 and at(low / 0.97, 0.002) and at(high / 1.03, 0.998)


def test_components_of_near_nodes_take_few_rounds(spark, monkeypatch):
    """50 paths of 100 nodes: tasks join up most links before the rounds, of which few are left."""
    from provgraph.operators import components

    written, table = [], components.Scratch.table
    monkeypatch.setattr(components.Scratch, "table", lambda self, df: written.append(1) or table(self, df))
    links = spark.range(5000).where("id % 100 > 0").selectExpr("struct(id div 100 as g, id % 100 as n) as src", "struct(id div 100 as g, id % 100 - 1 as n) as dst")
    got = components.connected_components(links).selectExpr("node.g = component.g and component.n = 0 as ok").groupBy("ok").count().collect()
    assert [tuple(x) for x in got] == [(True, 5000)] and len(written) <= 4
