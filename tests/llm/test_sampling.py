"""The cube method: exact category counts, balance, expectations, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from strandloom.llm.sampling import balanced_sample, flight, land

UNITS = "cell_id string, sample_id string, main_cell_type string, prep_batch int, p double"
TARGETS = "sample_id string, main_cell_type string, target_share double, min_cells int, sample_size int"


def units(spark):
    rows = []
    for s, n in (("S1", 900), ("S2", 60)):
        for i in range(n):
            kind = "mono" if i % 3 else ("t4" if i % 2 else "b")
            rows.append((f"{s}_{i}", s, kind, i % 4 if i % 7 else None, 0.5))
    rows += [(None, "S1", "mono", 1, 0.1), ("S1_x", "S1", None, 1, 0.1), ("z", None, "mono", 1, 0.1), rows[0], rows[1]]
    return spark.createDataFrame(rows, UNITS)


def test_counts_are_exact_and_repeatable(spark):
    u = units(spark).cache()
    t = spark.createDataFrame([("S1", "Mono ", 0.5, 0, 100), ("S1", "t4", 0.333, 50, 100), ("S1", "B", 0.0, 3, 100), ("S2", "mono", 0.9, 0, 60), ("S2", "missing", None, 2, 60), ("S3", "mono", 0.5, 1, 10), ("S1", "none", None, None, None), (None, "mono", 1.0, 1, 1), ("S1", "__", 1.0, 1, 1)], TARGETS)
    for size in (20_000, 40):
        d = balanced_sample(u, t, part_rows=size)
        rep = {(r.sample_id, r.main_cell_type): (r.wanted, r.available, r.drawn, r.missing) for r in d.report.collect()}
        assert rep == {("S1", "mono"): (50, 600, 50, 0), ("S1", "t4"): (50, 150, 50, 0), ("S1", "b"): (3, 150, 3, 0), ("S2", "mono"): (54, 40, 40, 14), ("S2", "missing"): (2, 0, 0, 2), ("S3", "mono"): (5, 0, 0, 5), ("S1", "none"): (0, 0, 0, 0)}
        got = {(r.sample_id, r.main_cell_type): r["count"] for r in d.cells.groupBy("sample_id", "main_cell_type").count().collect()}
        assert got == {("S1", "mono"): 50, ("S1", "t4"): 50, ("S1", "b"): 3, ("S2", "mono"): 40}
        assert d.cells.select("cell_id").distinct().count() == d.cells.count() == 143
        assert d.balance.agg(F.max(F.abs("residual"))).head()[0] < 4
        assert abs(d.balance.agg(F.sum("residual")).head()[0]) < 1e-6
        again = balanced_sample(u.repartition(7), t, part_rows=size)
        assert {r.cell_id for r in d.cells.collect()} == {r.cell_id for r in again.cells.collect()}


def test_empty(spark):
    u, t = spark.createDataFrame([], UNITS), spark.createDataFrame([], TARGETS)
    d = balanced_sample(u, t)
    assert d.cells.collect() == [] and d.report.collect() == [] and d.balance.collect() == []
    d = balanced_sample(units(spark), t)
    assert d.cells.collect() == []


def test_flight_keeps_constraints_and_expectations():
    rng = np.random.default_rng(0)
    p = rng.uniform(0.1, 0.9, 12)
    a = np.vstack([np.ones(12), np.arange(12) % 2, np.arange(12) % 3 == 0]).astype(float)
    total = np.zeros(12)
    for _ in range(3000):
        q = flight(p, a, rng)
        assert np.allclose(a @ q, a @ p, atol=1e-6) and ((q > 1e-6) & (q < 1 - 1e-6)).sum() <= 3
        total += land(q, np.zeros((1, 12)), np.zeros((0, 12)), rng)
    assert np.abs(total / 3000 - p).max() < 0.05


def test_land_meets_what_it_must():
    rng = np.random.default_rng(1)
    p = np.full(9, 1 / 3)
    must = np.kron(np.eye(3), np.ones(3))
    for _ in range(50):
        out = land(p, must, (np.arange(9) % 2)[None, :].astype(float), rng)
        assert (must @ out == 1).all()


def test_many_balance_values_land_in_chunks(spark):
    rows = [(f"S1_{i}", "S1", "mono" if i % 3 else "b", i % 300, 0.5) for i in range(1500)] + [(f"S2_{i}", "S2", "b", i % 2, 0.5) for i in range(50)]
    t = spark.createDataFrame([("S1", "mono", 0.5, 0, 300), ("S1", "b", 0.5, 0, 300), ("S2", "b", 1.0, 0, 20)], TARGETS)
    d = balanced_sample(spark.createDataFrame(rows, UNITS), t)
    assert {(r.sample_id, r.main_cell_type): r.drawn for r in d.report.collect()} == {("S1", "mono"): 150, ("S1", "b"): 150, ("S2", "b"): 20}
    assert d.balance.count() == 302 and d.balance.agg(F.max(F.abs("residual"))).head()[0] < 2
