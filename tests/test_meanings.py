"""Results worked out by hand where the meaning is easily mistaken, and defined results for zero divisors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.operators import ctfidf as C
from strandloom.operators import deconvolve as D
from strandloom.operators import intervals as I
from strandloom.operators import pipelines as PL
from strandloom.operators import preprocess as P
from strandloom.operators.prefix import drawn_ranks, ranks
from strandloom.operators.topics import choose, corex, guided, tree
from strandloom.operators.topics.lda import Fitted
from strandloom.session import cut

COUNTS = "cell_id string, gene string, value double"


def rows(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_scenario_attenuates_all_types_and_thins_the_smallest(spark):
    kinds = spark.createDataFrame([(f"a{i}", "A") for i in range(9)] + [(f"b{i}", "B") for i in range(4)], "cell_id string, main_cell_type string")
    counts = kinds.select("cell_id", F.lit("g").alias("gene"), F.lit(2.0).alias("value"))
    bulk, truth = D.scenario(counts, kinds, 0.5, 0.5)
    assert rows(bulk, "main_cell_type", "value") == {("A", 9.0), ("B", 2.0)} and rows(truth, "main_cell_type", "n_cells") == {("A", 9), ("B", 2)}
    assert rows(D.scenario(counts, kinds, 0.01, rare="A")[1], "main_cell_type", "n_cells") == {("A", 1), ("B", 4)}


def test_truth_is_scaled_by_peak(spark):
    m = spark.createDataFrame([("A", "p", 15_000.0), ("B", "p", 10_000.0), ("A", "q", 4_000.0)], "main_cell_type string, peak_id string, value double")
    assert rows(PL.scaled_truth(m), "main_cell_type", "peak_id", "value") == {("A", "p", 7500.0), ("B", "p", 5000.0), ("A", "q", 4000.0)}


def test_group_norms(spark):
    df = spark.createDataFrame([("s", "a", 1.0), ("s", "b", 3.0), ("s", "c", 8.0), ("s", "out", 5.0)], "sample_id string, gene string, value double")
    g = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("b", 1), ("gone", 1), ("gone2", 1)], "gene string, group_id int")
    # totals 4 and 11: group 0 times 11 / 4
    assert rows(P.group_totals_norm(df, g), "gene", "value") == {("a", 2.75), ("b", (3 * 2.75 + 3) / 2), ("c", 8.0), ("out", 5.0)}
    # the largest group lists four genes, of which two occur
    assert rows(P.group_sizes_norm(df, g), "gene", "group_id", "value") == {("a", 0, 2.0), ("b", 0, 6.0), ("b", 1, 6.0), ("c", 1, 16.0)}


def test_markers_are_screened_and_scaled(spark):
    rng = np.random.default_rng(0)
    data = [(f"c{c}", f"g{g}", float(1 + rng.poisson(9 if g == c % 2 else 1))) for c in range(30) for g in range(6)] + [("poor", "g0", 99.0), ("c1", "rare", 9.0)]
    kinds = spark.createDataFrame([(f"c{c}", "AB"[c % 2]) for c in range(30)] + [("poor", "A")], "cell_id string, main_cell_type string")
    got = P.find_markers(spark.createDataFrame(data, COUNTS), kinds, 3, 2)
    assert {r.gene for r in got.collect()} == {f"g{g}" for g in range(6)}
    assert got.agg(F.sum("rank_sum")).head()[0] == pytest.approx(6 * 30 * 31 / 2)  # thirty ranked cells
    assert rows(P.take_markers(got, 1), "gene") == {("g0",), ("g1",)}


def test_topics_of_types(spark):
    t = spark.createDataFrame([(0, "A", 0.9), (1, "A", 0.1), (0, "B", 0.6), (1, "B", 0.5), (2, "B", 0.1)], "topic_id int, main_cell_type string, weight double")
    assert rows(PL.topics_of_types(t), "topic_id", "main_cell_type") == {(0, "A"), (0, "B"), (1, "unsure"), (2, "unsure")}


def test_zero_divisors(spark):
    flat = spark.createDataFrame([(f"c{i}", g, 1.0, i % 2) for i in range(6) for g in "xyz"], COUNTS + ", batch int")
    assert {r.value for r in P.combat(flat, "batch").collect()} == {1.0}
    one = spark.createDataFrame([("c", "g", 2.0)], COUNTS)
    assert [(r.mean, r.variance) for r in P.dispersion(one, 1).collect()] == [(2.0, None)]
    zero = spark.createDataFrame([("a", 0, 0.0), ("a", 1, 1.0), ("b", 1, 1.0)], "gene string, topic_id int, weight double")
    assert {(r.topic_id, r.other): r.distance for r in tree.cosine_distances(zero).collect()}[0, 1] == 1.0
    assert rows(I.length_weight(spark.createDataFrame([("a", 5, 5), ("b", 0, 10), ("c", 0, 5)], "gene string, start int, end int")), "gene", "gene_weight") == {("a", 1.0), ("b", 1.0), ("c", 5.0)}
    assert P.library_norm(spark.createDataFrame([("c", "a", 1.0), ("c", "b", -1.0)], COUNTS)).where("value IS NOT NULL").isEmpty()
    for df in (P.library_norm(one.limit(0)), P.quantile_norm(one.limit(0), "cell_id", "gene"), I.enhancers(spark.createDataFrame([], "region_id string, signal double")), P.combat(flat.limit(0), "batch")):
        assert df.collect() == []


def test_complete_features(spark):
    inf = float("inf")
    df = spark.createDataFrame([("s1", "ok", 1.0), ("s2", "ok", 2.0), ("s1", "inf", 1.0), ("s2", "inf", inf), ("s1", "nan", math.nan), ("s2", "nan", 1.0), ("s1", "same", 3.0), ("s2", "same", 3.0), ("s1", "half", 3.0)], "s string, gene string, value double")
    assert rows(P.complete_features(df, "gene", 2), "gene", "n", "variance") == {("ok", 2, 0.5)}


def test_combat_equals_a_dense_computation(spark):
    rng = np.random.default_rng(3)
    x, lane = rng.poisson(2, (40, 7)).astype(float) * rng.uniform(0.5, 2, 7), np.arange(40) % 3
    df = spark.createDataFrame([(f"c{i}", f"g{g}", float(x[i, g]), int(lane[i])) for i in range(40) for g in range(7) if x[i, g] or g == 0], COUNTS + ", lane int")
    n = np.bincount(lane).astype(float)
    within = sum(((x[lane == b] - x[lane == b].mean(0)) ** 2).sum(0) for b in range(3)) / 40
    z = (x - x.mean(0)) / np.sqrt(within)
    want, zero = x.copy(), np.zeros((3, 7))
    for b in range(3):
        mine = z[lane == b]
        g0, d0 = mine.mean(0), mine.var(0, ddof=1)
        a, gv = 2 + d0.mean() ** 2 / d0.var(ddof=1), g0.var(ddof=1)
        g, d = g0.copy(), d0.copy()
        for _ in range(30):
            g = (n[b] * gv * g0 + d * g0.mean()) / (n[b] * gv + d)
            d = (d0.mean() * (a - 1) + ((mine - g) ** 2).sum(0) / 2) / (n[b] / 2 + a - 1)
        back = lambda v: np.sqrt(within) * (v - g) / np.sqrt(d) + x.mean(0)  # noqa: B023, E731
        want[lane == b], zero[b] = back(mine), back(-x.mean(0) / np.sqrt(within))
    for r in P.combat(df, "lane").collect():
        i, g = int(r.cell_id[1:]), int(r.gene[1:])
        assert r.value == pytest.approx(want[i, g]) and r.zero_value == pytest.approx(zero[r.lane, g])


def test_signal_scores_equal_a_dense_computation(spark):
    rng = np.random.default_rng(1)
    p = rng.random((3, 8)) * (rng.random((3, 8)) > 0.4)
    p[:, 7] = 0
    t, b = rng.random((3, 8)) * (rng.random((3, 8)) > 0.3), rng.random(8)
    long = lambda m: [(f"t{i}", f"p{j}", float(m[i, j])) for i in range(3) for j in range(8) if m[i, j]]
    got = D.signal_scores(
        spark.createDataFrame([("s", *r) for r in long(p)], "sample_id string, main_cell_type string, peak_id string, value double"),
        spark.createDataFrame(long(t), "main_cell_type string, peak_id string, value double"),
        spark.createDataFrame([("s", f"p{j}", float(b[j])) for j in range(8)], "sample_id string, peak_id string, value double"),
    ).head()
    use = p.sum(0) > 0
    e, eb, y = p.sum(0)[use] - t.sum(0)[use], p.sum(0)[use] - b[use], t.sum(0)[use]
    assert got.n == use.sum() and got.mae == pytest.approx(np.abs(e).mean()) and got.rmse == pytest.approx(np.sqrt((e**2).mean())) and got.r2 == pytest.approx(1 - (e**2).sum() / ((y - y.mean()) ** 2).sum())
    assert got.mae_bulk == pytest.approx(np.abs(eb).mean()) and got.peak_cor == pytest.approx(np.mean([np.corrcoef(p[i, use], t[i, use])[0, 1] for i in range(3)]))


@pytest.mark.parametrize("most", [0, 1_000_000])
def test_scores_without_the_laid_out_prediction_equal_those_with_it(spark, monkeypatch, most):
    monkeypatch.setattr(D, "MOST_SENT", most)
    rng = np.random.default_rng(2)
    drawn = lambda a, b, share: [(f"{a[0]}{i}", f"{b[0]}{j}", float(rng.random())) for i in range(a[1]) for j in range(b[1]) if rng.random() < share]
    frac = spark.createDataFrame(drawn(("s", 4), ("t", 5), 0.8), "sample_id string, main_cell_type string, fraction double").where("main_cell_type <> 't4'")
    peaks = spark.createDataFrame(drawn(("s", 4), ("p", 30), 0.7), "sample_id string, peak_id string, value double")
    weights, truth = (spark.createDataFrame(drawn(("t", 6), ("p", 30), 0.4), "main_cell_type string, peak_id string, value double") for _ in range(2))
    of = lambda df: {r.sample_id: [r[c] for c in ("n", "mae", "mse", "rmse", "r2", "mae_bulk", "mse_bulk", "rmse_bulk", "r2_bulk", "peak_cor")] for r in df.collect()}
    got, want = of(D.predicted_scores(frac, peaks, weights, truth)), of(D.signal_scores(D.predict_peaks(frac, peaks, weights), truth, peaks))
    assert set(got) == set(want) == {"s0", "s1", "s2", "s3"} and all(got[k] == pytest.approx(want[k]) for k in want)
    none = D.predicted_scores(frac.where("false"), peaks, weights, truth)
    assert none.collect() == [] and none.columns == D.signal_scores(D.predict_peaks(frac, peaks, weights), truth, peaks).columns


def test_broadcast_profiles_give_the_same_peak_weights(spark):
    profile = spark.createDataFrame([("a", "g1", 1.0), ("a", "g2", 2.0), ("b", "g1", 3.0)], "main_cell_type string, gene string, value double")
    links = spark.createDataFrame([("g1", "p", 0.5), ("g2", "p", 1.0), ("g2", "q", 0.25), ("g3", "q", 1.0)], "gene string, peak_id string, weight double")
    plain, few = (rows(D.peak_weights(profile, links, x), "main_cell_type", "peak_id", "value") for x in (False, True))
    assert plain == few == {("a", "p", 1.25), ("b", "p", 0.75), ("a", "q", 2.0)}


def test_pruned_bags_forget(spark):
    n = spark.createDataFrame([("a", 0, 10), ("a", 9, 10), ("b", 0, 4), ("c", 0, 5), ("c", 1, 5)], "t string, b int, n bigint")
    # a: 10 has faded below 5 by batch 7 and is forgotten; b is below 5 at once; c: 5 * 0.9 + 5 = 9.5, faded to batch 9: 9.5 * 0.9 ** 8 = 4.09
    assert rows(C.decayed(n, "b", "t", 0.1, 9, min_total=5.0), "t", "value") == {("a", 10.0)}
    assert C.decayed(n, "b", "t", 0.1, 2, min_total=5.0).where("t = 'c'").head().value == pytest.approx(9.5 * 0.9)


def test_ranks_of_a_hot_key(spark):
    df = spark.createDataFrame([("hot", f"u{i:04d}") for i in range(900)] + [("b", "u1"), ("b", "u0")], "k string, u string").repartition(5)
    got = drawn_ranks(df, ["k"], "u", "r")
    assert sorted(r.r for r in got.where("k = 'hot'").collect()) == list(range(1, 901)) and sorted(r.r for r in got.where("k = 'b'").collect()) == [1, 2]
    by_name = {r.u: r.r for r in ranks(df.where("k = 'hot'"), [], F.left("u", F.lit(3)), [F.col("u")], "r").collect()}
    assert all(by_name[f"u{i:04d}"] == i + 1 for i in range(900))
    split = P.stratified_split(df, "k", "u", 0.8)
    assert rows(split.where("train").groupBy("k").count(), "k", "count") == {("hot", 720), ("b", 1)}


def test_salted_overlaps_equal_plain_ones(spark):
    a = spark.createDataFrame([("x", 10 * i, 10 * i + 25) for i in range(20)], "chr string, start bigint, end bigint")
    b = spark.createDataFrame([("x", 7 * i % 200, 7 * i % 200 + 9) for i in range(300)], "chr string, start_b bigint, end_b bigint")
    plain, salted = (sorted(tuple(r) for r in I.overlap_join(a, b, ["chr"], 50, salts=n).collect()) for n in (1, 4))
    assert plain == salted and len(plain) > 300


def test_topic_choice(spark):
    kinds = spark.createDataFrame([(f"c{i}", "AB"[i % 2]) for i in range(20)], "cell_id string, main_cell_type string")
    genes = spark.createDataFrame([("g", t, 1.0) for t in range(3)], "gene string, topic_id int, weight double")
    counts = kinds.select("cell_id", F.lit("g").alias("gene"), F.lit(1.0).alias("value"))

    def fit(k, seed):
        right = seed == 2
        return Fitted(genes, spark.createDataFrame([(f"c{i}", (i if right else i // 2) % 2, 1.0) for i in range(20)], "cell_id string, topic_id int, weight double"), {})

    for name, most in (("accuracy", 1.0), ("nmi", 1.0)):
        got = choose.select_topics(fit, counts, kinds, (2, 3), (1, 2), name).collect()
        assert [(r.ntopics, r.seed) for r in got if r.chosen] == [(2, 2)] and max(r.metric for r in got) == pytest.approx(most)
    assert choose.select_topics(fit, counts, kinds, (2,), (1,), "umass").head().chosen


def test_corex_places_new_samples(spark):
    rng = np.random.default_rng(0)
    data = [(f"c{c:03d}", f"g{g:02d}", 1.0) for c in range(90) for g in range(20) if rng.random() < (0.9 if g // 10 == c % 2 else 0.05)]
    fit = corex.fit_corex(spark.createDataFrame(data, COUNTS), 2, {"g00": 0, "g10": 1}, n_iter=15)
    again = {(r.cell_id, r.topic_id): r.weight for r in corex.infer_corex(fit, spark.createDataFrame(data, COUNTS)).collect()}
    assert all(again[r.cell_id, r.topic_id] == pytest.approx(r.weight) for r in fit.cell_topic.collect())
    new = spark.createDataFrame([("n", f"g{g:02d}", 3.0) for g in range(10)] + [("n", "unknown", 1.0), ("none", "unknown", 1.0)], COUNTS)
    assert {(r.cell_id, r.topic_id): r.weight > 0.5 for r in corex.infer_corex(fit, new).collect()} == {("n", 0): True, ("n", 1): False}


def test_likelihood_has_both_parts():
    x = np.array([0.05, 0.5, 1.0, 3.3, 7.9, 120.0])
    assert guided._lgamma(x) == pytest.approx([math.lgamma(v) for v in x], abs=1e-9)


def test_cut_needs_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Frame:
        sparkSession = type("S", (), {"sparkContext": Context, "conf": {}})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        cut(Frame)
