"""Small cases with results worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import ctfidf as C
from strandloom.operators import deconvolve as D
from strandloom.operators import intervals as I
from strandloom.operators import metrics as M
from strandloom.operators import pipelines as PL
from strandloom.operators import preprocess as P
from strandloom.operators.topics.guided import pseudo_counts
from strandloom.operators.topics.tree import ward


def rows(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_library_size(spark):
    df = spark.createDataFrame([("c1", "x", 700.0), ("c1", "y", 700.0), ("c2", "x", 650.0), ("c2", "y", 1950.0), ("c3", "x", 1000.0), ("c3", "y", 3000.0)], "cell_id string, gene string, value double")
    got = {(r.cell_id, r.gene): r.value for r in P.log2p1(P.library_norm(df)).collect()}
    assert got["c1", "x"] == pytest.approx(10.551708, abs=1e-6) and got["c2", "x"] == pytest.approx(9.552669, abs=1e-6) and got["c3", "x"] == pytest.approx(9.552669, abs=1e-6)
    small = df.withColumn("value", F.col("value") / 10)
    assert {r.value for r in P.library_norm(small).collect()} == {0.0}
    assert all(r.value > 0 for r in P.library_norm(small, guard=True).collect())


@pytest.mark.parametrize("median, ref", [(False, [2, 3, 14 / 3, 17 / 3]), (True, [2, 3, 4, 5])])
def test_quantile_norm(spark, median, ref):
    m = [[5, 4, 3], [2, 1, 4], [3, 4, 6], [4, 2, 8]]
    df = spark.createDataFrame([(f"s{j}", f"g{i}", float(m[i][j])) for i in range(4) for j in range(3)], "s string, g string, value double")
    got = {(r.s, r.g): r.value for r in P.quantile_norm(df, "s", "g", 3, 4, median=median).collect()}
    rank = [[4, 3, 1], [1, 1, 2], [2, 3, 3], [3, 2, 4]]
    for i in range(4):
        for j in range(3):
            assert got[f"s{j}", f"g{i}"] == pytest.approx(ref[rank[i][j] - 1])


def test_dispersion_counts_zeros(spark):
    df = spark.createDataFrame([("c", "a", 6.0), ("a", "b", 2.0), ("b", "b", 2.0), ("c", "b", 2.0), ("a", "d", 1.0), ("b", "d", 3.0), ("c", "d", 5.0)], "cell_id string, gene string, value double")
    got = {r.gene: (r.mean, r.variance, r.dispersion) for r in P.dispersion(df, 3).collect()}
    assert got["a"] == pytest.approx((2, 12, 6)) and got["b"] == pytest.approx((2, 0, 0)) and got["d"] == pytest.approx((3, 4, 4 / 3))


def test_subsample(spark):
    df = spark.createDataFrame([(f"{k}{i:04d}", k) for k, n in (("A", 100), ("B", 50), ("C", 850)) for i in range(n)], "cell_id string, kind string")
    for f, n in ((0.01, 10), (1.0, 50), (0.0, 0)):
        assert P.subsample(df, "kind", {"B": f}, "cell_id").where("kind = 'B'").count() == n


def test_uniquify(spark):
    df = spark.createDataFrame(list(enumerate("ABAAB")), "o int, s string")
    assert [r.u for r in P.uniquify(df, "s", [F.col("o")], "u").orderBy("o").collect()] == ["A", "B", "A-2", "A-3", "B-2"]


def test_max_abs(spark):
    df = spark.createDataFrame([("c", "b", 1.9), ("c", "d", 4.2), ("c", "e", 0.5)], "cell_id string, gene string, value double")
    assert rows(P.max_abs_scale(df), "gene", "value") == {("b", 2.5), ("d", 10.0)}


def test_anchors(spark):
    anchors = spark.createDataFrame([(0, "a"), (0, "b"), (1, "b"), (1, "c"), (2, "z"), (5, "a")], "topic_id int, gene string")
    reg = P.registered_anchors(anchors, spark.createDataFrame([("a",), ("b",), ("c",)], "gene string"))
    assert rows(reg, "topic_id", "seed_topic", "gene") == {(0, 0, "a"), (0, 0, "b"), (1, 1, "b"), (1, 1, "c"), (5, 2, "a")}
    assert rows(P.specific_anchors(reg), "seed_topic", "gene") == {(1, "c")}


GENES = [("chr1", 200000, 210000, "A", "+"), ("chr1", 400000, 402000, "B", "-")]
PEAKS = [("p0", 196000, 10.0), ("p1", 150000, 20.0), ("p2", 215000, 30.0), ("p3", 405000, 40.0), ("p4", 410000, 50.0), ("p5", 395000, 60.0)]


def gene_tables(spark):
    g = spark.createDataFrame(GENES, "chr string, start bigint, end bigint, gene string, strand string")
    p = spark.createDataFrame([(i, "chr1", s, s + 500) for i, s, _ in PEAKS], "peak_id string, chr string, start bigint, end bigint")
    c = spark.createDataFrame([("s", i, v) for i, _, v in PEAKS], "sample_id string, peak_id string, value double")
    return g, p, c


def test_extensions_and_links(spark):
    g, p, c = gene_tables(spark)
    assert rows(I.extend_tss(g), "gene", "tss_start", "tss_end") == {("A", 100000, 210000), ("B", 302000, 502000)}
    assert rows(I.extend_body(g), "gene", "body_start", "body_end") == {("A", 195000, 210000), ("B", 400000, 407000)}
    got = {(r.peak_id, r.gene): (r.dist, round(r.weight, 9)) for r in I.gene_peaks(g, p).collect()}
    assert got == {("p0", "A"): (0, 1), ("p1", "A"): (44500, 0.000136389), ("p3", "B"): (0, 1), ("p4", "B"): (3000, 0.548811636), ("p5", "B"): (4500, 0.40656966)}
    assert rows(I.length_weight(g), "gene", "gene_weight") == {("A", 1.0), ("B", 5.0)}
    full = {r.gene: r.score for r in I.gene_activity(g, p, c).collect()}
    assert full["A"] == pytest.approx(10.002728, abs=1e-6) and full["B"] == pytest.approx(459.173807, abs=1e-6)
    assert {r.gene: r.score for r in I.gene_activity(g, p, c, cutoff=1.0, whole=True).collect()} == {"A": 10, "B": 200}


def test_feature_counts(spark):
    p = spark.createDataFrame([("chr1", 100, 200), ("chr1", 200, 300), ("chr1", 500, 600)], "chr string, start bigint, end bigint")
    f = spark.createDataFrame([("chr1", 150, 180, 2.0), ("chr1", 190, 210, 3.0), ("chr1", 550, 560, 4.0)], "chr string, start bigint, end bigint, score double")
    assert rows(I.feature_counts(p, f), "start", "end", "count") == {(100, 300, 8.0), (500, 600, 4.0)}


@pytest.mark.parametrize("width", [7, 100_000])
def test_overlap_join_equals_brute_force(spark, width):
    rng = np.random.default_rng(1)
    a = [("x" if i % 3 else "y", int(s), int(s + w)) for i, (s, w) in enumerate(zip(rng.integers(0, 200, 60), rng.integers(1, 40, 60)))]
    b = [("x", int(s), int(s + w)) for s, w in zip(rng.integers(0, 200, 60), rng.integers(1, 5, 60))]
    da, db = spark.createDataFrame(a, "chr string, start bigint, end bigint"), spark.createDataFrame(b, "chr string, start_b bigint, end_b bigint")
    for closed in (False, True):
        got = sorted(tuple(r) for r in I.overlap_join(da, db, ["chr"], width, closed).select("chr", "start", "end", "start_b", "end_b").collect())
        meet = (lambda p, q: p[1] <= q[2] and q[1] <= p[2]) if closed else (lambda p, q: p[1] < q[2] and q[1] < p[2])
        assert got == sorted((*p, q[1], q[2]) for p in a for q in b if p[0] == q[0] and meet(p, q))


def test_enhancer_cutoff(spark):
    df = spark.createDataFrame([(f"r{i}", float(y)) for i, y in enumerate([0, 1, 2, 3, 4, 10, 50, 100])], "region_id string, signal double")
    out = I.enhancers(df).collect()
    assert {r.cutoff for r in out} == {10.0} and {r.region_id for r in out if r.is_super} == {"r6", "r7"}
    assert {r.region_id: r["rank"] for r in out}["r7"] == 1


def test_stitch(spark):
    df = spark.createDataFrame([("c", 1, 100), ("c", 5000, 5100), ("c", 20000, 20100)], "chr string, start bigint, end bigint")
    assert rows(I.stitch(df), "start", "end") == {(1, 5100), (20000, 20100)}


def test_bayes_and_rules(spark):
    tt = spark.createDataFrame([(0, "A", 0.6), (0, "B", 0.2), (1, "A", 0.4), (1, "B", 0.8)], "topic_id int, main_cell_type string, weight double")
    sh = D.type_shares(spark.createDataFrame([("a",), ("b",), ("c",)], "cell_id string").withColumn("main_cell_type", F.lit("A")).unionAll(spark.createDataFrame([("d", "B")], "cell_id string, main_cell_type string")))
    got = {(r.topic_id, r.main_cell_type): r.p for r in D.bayes(tt, sh).collect()}
    assert got == pytest.approx({(0, "A"): 1.125, (1, "A"): 0.5, (0, "B"): 0.125, (1, "B"): 1 / 3})
    theta = spark.createDataFrame([("s", 0, 0.5), ("s", 1, 0.5)], "sample_id string, topic_id int, weight double")
    for rule, a in {"raw": 0.5, "norm": 0.541667, "norm_sd": 0.5, "bayes": 0.78, "bayes_norm": 0.75}.items():
        f = {r.main_cell_type: r.fraction for r in D.fractions(theta, D.rule_weights(rule, tt, sh)).collect()}
        assert f["A"] == pytest.approx(a, abs=1e-6) and sum(f.values()) == pytest.approx(1)


def test_peak_prediction(spark):
    w = D.peak_weights(spark.createDataFrame([("A", "g", 2.0), ("B", "g", 6.0)], "main_cell_type string, gene string, value double"), spark.createDataFrame([("g", "p0", 1.0)], "gene string, peak_id string, weight double"))
    frac = spark.createDataFrame([("s", "A", 0.75), ("s", "B", 0.25)], "sample_id string, main_cell_type string, fraction double")
    peaks = spark.createDataFrame([("s", "p0", 8.0), ("s", "p1", 4.0)], "sample_id string, peak_id string, value double")
    assert rows(D.predict_peaks(frac, peaks, w), "main_cell_type", "peak_id", "value") == {("A", "p0", 3.0), ("B", "p0", 3.0)}


def test_nnls_meets_its_conditions():
    rng = np.random.default_rng(0)
    for _ in range(30):
        g, x = rng.random((12, 6)), rng.normal(size=12)
        w = D._active_set(g.T @ g, g.T @ x)
        grad = g.T @ (g @ w - x)
        assert (w >= 0).all() and (grad > -1e-8).all() and abs(w @ grad) < 1e-7


def test_ctfidf(spark):
    n = spark.createDataFrame([(0, "a", 3), (0, "b", 1), (1, "a", 1), (1, "c", 3)], "k int, term string, n bigint")
    plain = {(r.k, r.term): r.weight for r in C.ctfidf(n, "k").collect()}
    assert plain == pytest.approx({(0, "a"): 0.519860, (0, "b"): 0.402359, (1, "a"): 0.173287, (1, "c"): 0.635473}, abs=1e-6)
    bm = {(r.k, r.term): r.weight for r in C.ctfidf(n, "k", True, True).collect()}
    assert bm == pytest.approx({(0, "a"): 0.091245, (0, "b"): 0.601986, (1, "a"): 0.052680, (1, "c"): 0.308890}, abs=1e-6)


def test_umass_depends_on_order(spark):
    docs = spark.createDataFrame([(0, "x"), (0, "y"), (1, "x"), (2, "x"), (2, "y")], "doc_id int, term string")
    for order, want in ((("y", "x"), math.log(2 / 2)), (("x", "y"), math.log(2 / 3))):  # ascending weight
        tops = spark.createDataFrame([(0, t, len(order) - i) for i, t in enumerate(order)], "k int, term string, rank int")
        assert C.umass(tops, docs, "k").head().coherence == pytest.approx(want, abs=1e-9)


def test_decay_and_ldac(spark):
    n = spark.createDataFrame([(0, "a", 10), (2, "a", 5)], "b int, t string, n bigint")
    assert C.decayed(n, "b", "t", 0.1, 2).head().value == pytest.approx(13.1)
    c = spark.createDataFrame([("d", 3, 2), ("d", 0, 1), ("e", 1, 4)], "doc string, number int, n bigint")
    lines = C.to_ldac(c, "doc", "number", offset=1)
    assert rows(lines, "doc", "line") == {("d", "2 1:1 4:2"), ("e", "1 2:4")}
    assert rows(C.from_ldac(lines, "doc", 1), "doc", "number", "n") == {("d", 3, 2), ("d", 0, 1), ("e", 1, 4)}
    for bad in ("3 1:1", "1 0:1"):
        with pytest.raises(Exception, match="term"):
            C.from_ldac(spark.createDataFrame([("d", bad)], "doc string, line string"), "doc", 1).collect()


def test_pseudo_counts():
    phi = np.array([[0.7, 0.2, 0.1], [0.1, 0.3, 0.6]])
    assert pseudo_counts(phi, np.array([0, 2]), np.array([2, 1]), 0.1) == pytest.approx([0.859305, 0.140695], abs=1e-6)


def test_rank_sum_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    cells = [(f"c{i}", "A" if i < 12 else "B") for i in range(40)]
    vals = {c: int(v) for (c, _), v in zip(cells, rng.integers(0, 4, 40))}
    df = spark.createDataFrame([(c, "g", float(v)) for c, v in vals.items() if v], "cell_id string, gene string, value double")
    got = {r.main_cell_type: (r.rank_sum, r.z) for r in P.rank_sum(df, spark.createDataFrame(cells, "cell_id string, main_cell_type string")).collect()}
    order = sorted(vals.values())
    rank = {v: np.mean([i + 1 for i, x in enumerate(order) if x == v]) for v in set(order)}
    for kind in "AB":
        mine = [rank[vals[c]] for c, k in cells if k == kind]
        n1, n = len(mine), 40
        ties = sum(t**3 - t for t in np.unique(order, return_counts=True)[1])
        z = (sum(mine) - n1 * (n + 1) / 2) / math.sqrt((1 - ties / (n**3 - n)) * n1 * (n - n1) * (n + 1) / 12)
        assert got[kind] == pytest.approx((sum(mine), z))


def test_statistics(spark):
    assert M._tail(2, 10, 4, 3) == pytest.approx((6 * 6 + 4) / 120)
    df = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.5,)], "p double").withColumn("k", F.lit(1))
    got = {r.p: r.q for r in M.benjamini_hochberg(df, "p", ["k"], "q").collect()}
    assert got == pytest.approx({0.01: 0.04, 0.03: 0.16 / 3, 0.04: 0.16 / 3, 0.5: 0.5})
    x = spark.createDataFrame([(v,) for v in (0.05, 0.5, 1.0, 3.3, 7.0, 120.0)], "x double")
    for r in x.select("x", M.lgamma(F.col("x")).alias("l"), M.normal_tail(F.col("x")).alias("t")).collect():
        assert r.l == pytest.approx(math.lgamma(r.x), abs=1e-9) and r.t == pytest.approx(math.erfc(r.x / math.sqrt(2)))


def test_ward():
    d = np.array([[0, 1, 5, 6], [1, 0, 5, 6], [5, 5, 0, 1.5], [6, 6, 1.5, 0]], float)
    merges = ward(d)
    assert [m[:2] for m in merges] == [(0, 1), (2, 3), (4, 5)] and merges[0][2] == 1 and merges[1][2] == 1.5


def test_composed_operators(spark):
    x = spark.createDataFrame([(0.5, 10.0), (-0.9, 5.0), (1.0, 4.0), (0.3, 2.0), (0.2, 100.0)], "r double, n double")
    got = [(r.p, r.t) for r in x.select("r", "n", PL.pearson_p(F.col("r"), F.col("n")).alias("p")).select("p", PL.p_text(F.col("p")).alias("t")).collect()]

    def by_integration(r, n):
        df, t = n - 2, abs(r) * math.sqrt((n - 2) / (1 - r * r))
        v = np.linspace(0, t, 200_001)
        y = np.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + v * v / df) ** (-(df + 1) / 2)
        return 1 - 2 * np.trapezoid(y, v)

    for i, (r, n) in {0: (0.5, 10), 1: (-0.9, 5), 4: (0.2, 100)}.items():
        assert got[i][0] == pytest.approx(by_integration(r, n), abs=1e-8)
    assert got[2] == (0.0, "0.00e+00") and got[3][0] is None and got[0][1] == "0.14"
    t = spark.createDataFrame([("3/12", "positive  regulation_of x"), ("1/0", "")], "a string, b string").select(PL.ratio(F.col("a")).alias("a"), PL.term_title(F.col("b")).alias("b")).collect()
    assert [tuple(r) for r in t] == [(0.25, "Positive regulation of x"), (None, "")]
    runs = spark.createDataFrame([(5, 1, 0.9), (4, 2, 0.9), (4, 1, 0.8)], "ntopics int, seed int, acc double")
    assert tuple(PL.select_model(runs, "acc").head()) == (4, 2, 0.9)
    for a, b, want in ((0.5, 0.5, "bayes_norm"), (0.6, 0.5, "bayes"), (None, 0.0, "bayes_norm")):
        assert PL.prefer(spark.createDataFrame([("bayes", a), ("bayes_norm", b)], "rule string, accuracy double")).head().rule == want
    assert PL.topic_grid(3) == [3, 4, 5, 6, 7, 8, 9] and PL.perplexity(-2.0, 1) == pytest.approx(math.e**2)
    found, without = PL.map_ids(spark.createDataFrame([("a",), ("b",)], "gene string"), spark.createDataFrame([("a", 1), ("a", 2)], "gene string, entrez int"))
    assert rows(found, "gene", "entrez") == {("a", 1), ("a", 2)} and rows(without, "gene") == {("b",)}
    s = spark.createDataFrame([("k1", 5.0), ("k2", 3.0), ("k3", 1.0)], "k string, n double")
    assert rows(PL.cumulative_choice(s, "n", 6.0, ["k"]), "k") == {("k1",), ("k2",)}


def test_combat_moves_batches_together(spark):
    rng = np.random.default_rng(0)
    data = [(f"c{i}", f"g{g}", float(rng.normal(5 + g, 1) + (3 if i % 2 else 0)), i % 2) for i in range(60) for g in range(12)]
    out = P.combat(spark.createDataFrame(data, "cell_id string, gene string, value double, batch int"), "batch")
    gap = out.groupBy("gene").agg((F.avg(F.when(F.col("batch") == 1, F.col("value"))) - F.avg(F.when(F.col("batch") == 0, F.col("value")))).alias("d"))
    assert gap.agg(F.max(F.abs("d"))).head()[0] < 0.6


def test_bootstrap_spread(spark):
    df = spark.createDataFrame([(f"t{i}", i / 10, i / 10 + (0.1 if i % 2 else -0.1)) for i in range(20)], "k string, p double, t double")
    r = M.bootstrap(df, "k", "p", "t", 100).head()
    assert r.n == 20 and 0.9 < r.pcc < 1 and 0 < r.pcc_sd < 0.1 and r.rmse == pytest.approx(0.1)
