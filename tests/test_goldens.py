"""Fixed values that the operators must give: names, rules, metrics and quality parts."""

import pytest
from pyspark.sql import functions as F

from provgraph.functions import names as N
from provgraph.operators import evaluate as M
from provgraph.operators import features as G
from provgraph.operators import results as R
from provgraph.operators import sampling as C
from provgraph.operators import validate as V

# Input and output of the name functions, one pair a line.
TYPES = """MP MP
MP* MP
*MP MP
TP TP
SO SO
SF SF
0_MP* MP
11_TP*-masscan TP
MP*-cat MP
3_SF-1.zip SF"""
TOOLS = """cat cat
bash* bash
0_MP*-find find
11_TP*-masscan masscan
4_TP-less less
MP-cat cat
/usr/bin/grep grep
cmd.exe cmd
9_TP*-tac tac
12_MP*-cat cat
10_TP-paste paste
3_TP*-dnsdomainname dnsdomainname
7_TP-chmod chmod
5_TP-dd dd"""
EXTENSIONS = """1.zip .zip
flag3.txt .txt
3_SF-1.zip .zip
6_MF-cron.m .m
10_SF-victim-shred.txt .txt
T1574.006.c .c
5_TF-da-ks.cfg .cfg
http://192.168.1.1
8_SF-ufw.log .log
14_SF-e2.c .c
7_MF-backsup.java .java
11_TF-ufw.h .h"""
# Type triples, + for those that pass.
TRIPLES = """+ MP FR TP
+ MP WR SF
+ MP ST SO
+ SO RF TP
+ MP RD SF
- SO WR SF
- SF EX MP
- MP EX SO
- MP IJ SF
- MP ST SF
- MP FR SF
- MP RF TP
- SF RD MP
- SO EX MP
+ MP* FR TP
+ MP* ST SO
+ SO RF TP*
- SF EX MP*
- MP* IJ SF"""
# Tool, verb and target, + for those that pass.
USES = """+ bash FR anything
+ sh FR anything
+ sudo FR anything
+ perl IJ target
- cat FR anything
- rev FR anything
- tee FR anything
- paste IJ perl
- logname IJ anything
- curl FR anything
- chmod FR anything
- halt FR anything
- vim FR anything
+ bash EX script.sh
+ sh EX run.pl
- sudo EX binary
+ perl EX shell.cgi
- bash EX e2.c
- bash EX s.c
- bash EX data.zip
- cat EX file.txt
- rev EX anything
- tee EX script.sh
+ curl ST 192.168.1.1
+ wget ST example.com
+ bash ST socket
+ nc RF socket
+ sh ST socket
+ perl ST socket
+ nmap ST target
- paste ST socket
- rev ST socket
- logname ST socket
- cat ST socket
- tee ST socket
- dd ST socket
- cat RF socket
+ cat RD readme.txt
+ tee WR file.log
+ paste RD data.csv
+ rev WR file.txt
+ curl WR output.html
+ tar WR backup.tar
+ 0_MP*-bash FR 1_TP-id
+ 4_TP*-sh ST 2_SO-http://192.168.1.1
+ 12_MP*-cat RD 8_SF-ufw.log
- 0_MP-cat FR 1_TP-id
- 0_MP-ls FR 1_TP-id
- 0_MP-curl FR 1_TP-id
- 0_MP-curl EX file.sh
- 0_MP-dd ST 2_SO-socket
- 0_MP-cat RF 2_SO-socket
- 0_MP-halt FR 1_TP-rev
- 0_MP-teehee FR 1_TP-rev
- 1_TP-rev FR anything
- 3_MP-sudo EX 5_TF-s.c
- 10_TP-paste ST 1_SO-socket
- 10_TP-paste IJ 11_TP-perl
- 11_TP-perl EX 14_SF-e2.c
- 16_MP-cat RF 6_SO-socket
- 9_TP-chmod FR anything"""
# A graph of 12 nodes and its 14 edges by stage; four of them break a rule.
NODES = "MP MP SO SF TP SF MF MF SF TP SF TP".split()
EDGES = [(1, "0 1 FR"), (1, "0 2 ST"), (1, "2 1 RF"), (1, "0 3 EX"), (1, "1 3 CD"), (1, "5 0 RD"), (2, "0 4 IJ"), (2, "4 2 ST"), (2, "4 3 WR"), (2, "3 4 EX"), (3, "0 1 FR"), (3, "0 5 IJ"), (4, "2 1 RF"), (4, "1 2 RF")]


@pytest.mark.parametrize("function, pairs", [(N.clean_entity_type, TYPES), (N.normalize_tool, TOOLS), (N.name_extension, EXTENSIONS)])
def test_names(spark, function, pairs):
    rows = [(line.split(" ") + [""])[:2] for line in pairs.split("\n")]
    got = spark.createDataFrame(rows, "raw string, expected string").withColumn("got", function(F.col("raw")))
    assert [tuple(r) for r in got.where("got is distinct from expected").collect()] == []


def test_rules(spark):
    triples = spark.createDataFrame([line.split() for line in TRIPLES.split("\n")], "sign string, s string, v string, d string")
    assert triples.where((F.col("sign") == "+") != V.type_rule_ok(F.col("s"), F.col("v"), F.col("d"))).count() == 0
    uses = spark.createDataFrame([line.split() for line in USES.split("\n")], "sign string, s string, v string, d string")
    assert uses.count() == 61 and [tuple(r) for r in uses.where((F.col("sign") == "+") != V.tool_rule_ok(F.col("s"), F.col("v"), F.col("d"))).collect()] == []


def test_graph_filter_and_dangling_nodes(spark):
    nodes = spark.createDataFrame([("g", i, t) for i, t in enumerate(NODES)], "graph_id string, node_idx int, type string")
    rows = [("g", stage, int(s), int(d), v) for stage, line in EDGES for s, d, v in [line.split()]]
    edges = spark.createDataFrame(rows, "graph_id string, stage int, src int, dst int, verb string")
    kept, stats, violations = V.validate_graphs(nodes, edges)
    assert [(r.total, r.removed, r.remaining, r.rate, r.graph_valid) for r in stats.collect()] == [(14, 4, 10, 0.285714, True)]
    assert sorted((r.kind, r.n) for r in violations.collect()) == [("MP-IJ->SF", 1), ("MP-RF->SO", 1), ("SF-EX->TP", 1), ("SF-RD->MP", 1)]
    left, _, mapping = V.drop_dangling_nodes(nodes, kept)
    assert sorted((r.node_idx, r.type) for r in left.collect()) == list(enumerate(NODES[:5])) and mapping.count() == 5
    lost = edges.unionByName(spark.createDataFrame([("g", 1, 0, 99, "FR")], edges.schema))
    assert [r.n for r in V.validate_graphs(nodes, lost)[2].where("kind = 'out_of_bounds'").collect()] == [1]


@pytest.mark.parametrize("mode, counts, expected", [("eps", (33, 2, 3, 28), (0.92424, 0.94286, 0.91667, 0.92958)), ("zero", (22, 0, 5, 125), (0.9671, 1.0, 0.8148, 0.8980))])
def test_metrics(spark, mode, counts, expected):
    row = M.binary_metrics(spark.createDataFrame([counts], "tp int, fp int, fn int, tn int"), mode).first()
    assert [row.accuracy, row.precision, row.recall, row.f1] == pytest.approx(expected, abs=6e-5)


def test_recovery_and_retention(spark):
    rows = [(1, 0, 1)] * 9 + [(1, 0, 0)] * 3 + [(1, 1, 1), (0, 0, 0)] * 5
    runs = spark.createDataFrame(rows, "label int, pred_base int, pred_after int")
    assert (M.recovery_rate(runs).first().value, M.retention(runs).first().value) == (0.75, 1.0)


def test_seed_summary_takes_the_population_deviation(spark):
    rows = [("q", "c", seed, {"recall": v, "none": None}) for seed, v in enumerate((0.6389, 0.8056, 0.8889))]
    got = {r.metric: (r["mean"], r["std"], r.n_seeds) for r in R.seed_summary(R.melt_metrics(spark.createDataFrame(rows, "rq string, condition string, seed int, metrics map<string,double>"))).collect()}
    assert got["recall"] == pytest.approx((0.778, 0.104, 3), abs=6e-4) and "none" not in got


def test_quality_score(spark):
    parts = spark.createDataFrame([(1 / 3, 1.0, 1.0, 0.5, 0.8333333, 0.694557, 1.0)], "coverage double, connectivity double, validity double, novelty double, depth double, transition double, stage_validity double")
    row = G.graph_quality_score(parts).first()
    assert (row.total, row.macro, row.micro) == pytest.approx((0.761122, 0.518095, 0.966667), abs=2e-6)


def test_defaults(spark):
    one = spark.createDataFrame([("ZZ", '{"n": 1, "u": "x"}', '{"n": 1}')], "kind string, ref string, none string")
    row = one.select(N.fallback_name(F.col("kind")).alias("name"), N.ref_uuid(F.col("ref")).alias("ref"), N.ref_uuid(F.col("none")).alias("none")).first()
    assert tuple(row) == ("unknown_entity", "x", None)
    zero = spark.createDataFrame([("a", i, 0.0) for i in range(5)] + [("b", 9, 2.0), ("b", 10, 0.0), ("c", 11, None)], "g string, k int, w double")
    got = [(r.g, r.k) for r in C.sample_weighted(zero, "g", "k", "w", 3).collect()]
    assert sorted(g for g, _ in got) == ["a", "a", "a", "b", "c"] and ("b", 9) in got
