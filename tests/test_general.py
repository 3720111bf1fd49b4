"""The two general operators against brute force, and their defined results in odd cases."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.operators.prefix import prefix_sums
from strandloom.operators.skew import compress, key_stats, percentiles
from strandloom.operators.sweep import periods_and_gaps


def brute_periods(rows):
    by = defaultdict(list)
    for k, s, e in rows:
        if s is not None and e is not None and s < e:
            by[k].append((s, e))
    out = set()
    for k, spans in by.items():
        merged = []
        for s, e in sorted(spans):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out |= {("period", k, s, e) for s, e in merged}
        out |= {("gap", k, a[1], b[0]) for a, b in zip(merged, merged[1:])}
    return out


def sweep(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "k string, s bigint, e bigint, kind string, start_pos int")
    return {tuple(r) for r in periods_and_gaps(df, ["k"], "s", "e", **kw).collect()}


@pytest.mark.parametrize("per_slice", [500_000, 5])
def test_sweep_equals_brute_force(spark, per_slice):
    rng = random.Random(3)
    rows = []
    for _ in range(400):
        s = rng.randrange(3000)
        rows.append((rng.choice(["a", "a", "a", "a", "b", None]), s, s + rng.choice([0, 1, 5, 5, 20, -3])))
    rows += [("a", None, 5), ("b", 7, None), ("c", 4, 4)] + rows[:50]
    assert sweep(spark, rows, rows_per_slice=per_slice, slices=8) == brute_periods(rows)


def test_sweep_touching_nested_single_and_empty(spark):
    assert sweep(spark, [("a", 1, 5), ("a", 5, 9), ("a", 2, 3), ("a", 12, 13)]) == {("period", "a", 1, 9), ("gap", "a", 9, 12), ("period", "a", 12, 13)}
    assert sweep(spark, []) == set()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 60), st.integers(0, 60)), max_size=40))
def test_sweep_property(spark, rows):
    assert sweep(spark, rows, rows_per_slice=3, slices=4) == brute_periods(rows)


def test_prefix_sums_of_a_hot_key(spark):
    rows = [("hot", i // 10, i, i % 7) for i in range(500)] + [(None, 0, 1, 2), ("b", 0, 1, 5)]
    df = spark.createDataFrame(rows, "k string, sl int, o int, v int")
    got = {(r.k, r.o): r.run for r in prefix_sums(df, ["k"], "sl", [F.col("o")], "v", "run").collect()}
    total = 0
    for k, _, o, v in rows[:500]:
        total += v
        assert got[k, o] == total
    assert got[None, 1] == 2 and got["b", 1] == 5


def skewed(n=3000):
    rng = random.Random(5)
    rows = []
    for _ in range(n):
        k = rng.choice(["hot"] * 8 + ["b", "c", None])
        rows.append((k, rng.choice([None, 1.0, 1.0, 2.5, -3.0, rng.random() * 1e6, float(rng.randrange(50))])))
    return rows + [("only_null", None), ("nan", math.nan), ("nan", 1.0), ("inf", math.inf), ("inf", -math.inf)]


def test_key_stats_equal_plain_aggregation(spark):
    rows = skewed()
    df = spark.createDataFrame([(*r, "x") for r in rows], "key string, v double, weight string")
    got = {r.key: r for r in key_stats(df, ["key"], "v", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    by = defaultdict(list)
    for k, v in rows:
        by[k].append(v)
    assert set(got) == set(by)
    for k in ("hot", "b", "c", None):
        vals = [v for v in by[k] if v is not None]
        r, c = got[k], Counter(vals)
        assert (r.n_rows, r.n_values, r.n_distinct) == (len(by[k]), len(vals), len(set(vals)))
        assert r.mode == min(v for v, n in c.items() if n == max(c.values()))
        assert np.allclose(r.percentiles, np.quantile(vals, [0, 0.25, 0.5, 0.9, 1]), rtol=1e-9)
    assert got["only_null"].n_distinct == 0 and got["only_null"].mode is None and got["only_null"].percentiles is None
    assert got["nan"].n_distinct == 2 and got["nan"].percentiles[0] == 1.0 and math.isnan(got["nan"].percentiles[4])
    assert got["inf"].percentiles[0] == -math.inf


def test_compress_weights_and_empty(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 1, 3), ("a", None, 1)], "k string, v int, w bigint")
    assert {tuple(r) for r in compress(df, ["k"], "v", "w").collect()} == {("a", 1, 5), ("a", None, 1)}
    none = df.where("k = 'z'")
    assert key_stats(none, ["k"], "v", [0.5]).collect() == []
    assert percentiles(compress(none, ["k"], "v"), ["k"], [0.5]).collect() == []


def test_strings_have_modes_and_distinct_counts(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "x"), ("a", "y"), ("a", "")], "k string, v string")
    r = key_stats(df, ["k"], "v").head()
    assert (r.n_rows, r.n_distinct, r.mode) == (5, 3, "x")
