"""Neighbours and clusters against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm.clusters import density_peaks, descriptions, groups
from strandloom.llm.neighbours import mutual_pairs, nearest_above, search
from strandloom.llm.vectors import build_index, codes, fold_copies, lay_out, lowest_common, nearest_pivots, record_type, unit_rows, usable

SCHEMA = "vec_id bigint, embedding array<float>, copies string, extra string"


def world(n=900, dim=64, seed=0):
    """Noise around a few directions, tight groups, copies, and rows that are no vectors."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(5, dim))
    x = base[rng.integers(0, 5, n)] + rng.normal(size=(n, dim)) * 1.2
    at = 0
    for size in (3, 4, 8, 12):
        c = x[at].copy()
        x[at : at + size] = c + rng.normal(size=(size, dim)) * 0.15 * np.linalg.norm(c) / 8
        at += size
    chain = x[at].copy()
    turn = rng.normal(size=dim)
    for i in range(5):  # each near the next only
        x[at + i] = chain / np.linalg.norm(chain) + i * 0.4 * turn / np.linalg.norm(turn)
    at += 5
    x[at : at + 30] = x[at]
    x *= rng.uniform(0.5, 4, (n, 1)) if False else 1
    rows = [(int(i), [float(v) for v in r], "a", "b") for i, r in enumerate(x.astype(np.float32))]
    rows += [(10_000, None, "", ""), (10_001, [0.0] * dim, "", ""), (10_002, [1.0] * (dim - 1), "", ""), (10_003, [float("nan")] + [1.0] * (dim - 1), "", ""), (10_004, [None] + [1.0] * (dim - 1), "", ""), (None, [1.0] * dim, "", "")]
    rows += rows[:3]
    return rows, x.astype(np.float32).astype(np.float64)


def cosines(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return u @ u.T


@pytest.fixture(scope="module")
def data(spark):
    rows, x = world()
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache(), cosines(x)


def true_top(c, k, least):
    c = c.copy()
    np.fill_diagonal(c, -2)
    out = set()
    for i in range(len(c)):
        order = sorted(np.flatnonzero(c[i] >= least), key=lambda j: (-round(c[i, j], 12), j))[:k]
        out |= {(i, int(j)) for j in order}
    return out


@pytest.mark.parametrize("block_rows", [100, 4096])
def test_nearest_above_equals_brute_force(data, block_rows):
    df, c = data
    got = {(r.a, r.b) for r in nearest_above(df, 5, 0.9, block_rows=block_rows).collect()}
    want = true_top(c, 5, 0.9)
    assert len(want) > 100
    assert got == want
    pairs = {tuple(r) for r in mutual_pairs(nearest_above(df, 5, 0.9, block_rows=block_rows)).collect()}
    assert pairs == {(min(p), max(p)) for p in want}


@pytest.mark.parametrize("name, value", [("SLICE_ROWS", 150), ("WHOLE_ROWS", 200)])
def test_large_blocks_in_slices_or_parts_give_the_same(data, monkeypatch, name, value):
    import strandloom.llm.vectors as V

    df, c = data
    monkeypatch.setattr(V, name, value)
    monkeypatch.setattr(V, "PART_ROWS", 100)
    monkeypatch.setattr(V, "GROUP_ROWS", 400)
    assert {(r.a, r.b) for r in nearest_above(df, 5, 0.9, block_rows=300).collect()} == true_top(c, 5, 0.9)
    found = density_peaks(df, block_rows=300)
    assert {tuple(r) for r in groups(found).collect()} == true_groups(c)
    assert {r.a for r in search(df, 5, query_step=10, block_rows=300).collect()} == set(range(0, 900, 10))


def test_search_recall(data):
    df, c = data
    got = {(r.a, r.b) for r in search(df, 5, query_step=10, block_rows=100).collect()}
    full = c.copy()
    np.fill_diagonal(full, -2)
    hits = total = 0
    for q in range(0, len(c), 10):
        kth = np.sort(full[q])[-5]
        mine = [b for a, b in got if a == q]
        assert len(mine) == 5
        hits += sum(full[q, b] >= kth - 1e-6 for b in mine)
        total += 5
    assert hits / total >= 0.9


def true_groups(c):
    near = c >= 0.9
    out = set()
    for i in range(len(c)):
        who = np.flatnonzero(near[i])
        if len(who) >= 3 and all((near[j] == near[i]).all() for j in who):
            mean = {int(j): (c[j, who].sum() - 1) / (len(who) - 1) for j in who}
            top = max(mean.values())
            out.add((min(j for j in mean if mean[j] >= top - 1e-6), i))
    return out


@pytest.mark.parametrize("block_rows", [100, 4096])
def test_groups_equal_brute_force(data, block_rows):
    df, c = data
    want = true_groups(c)
    assert len({t for t, _ in want}) >= 4
    found = density_peaks(df, block_rows=block_rows)
    assert {tuple(r) for r in groups(found).collect()} == want


def test_density_and_descriptions(data):
    df, c = data
    found = density_peaks(df, block_rows=200)
    near = c >= 0.9
    for r in found.nodes.collect():
        assert r.density == near[r.vec_id].sum()
        if r.parent is not None:
            assert near[r.vec_id, r.parent] and (near[r.parent].sum(), -r.parent) > (near[r.vec_id].sum(), -r.vec_id)
    about = descriptions(found).collect()
    assert sum(r["size"] for r in about if r["isolated"] and r["size"] >= 3) == len(true_groups(c))
    assert all(1 <= len(r.typical_ids) <= 3 for r in about)
    assert max(r["size"] for r in about) >= 30


def test_a_third_of_copies(spark):
    rng = np.random.default_rng(4)
    same = [float(v) for v in rng.normal(size=64).astype(np.float32)]
    rows = [(i, same if i % 3 == 0 else [float(v) for v in rng.normal(size=64).astype(np.float32)], "", "") for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    near = nearest_above(df, 5, 0.9).collect()
    assert len(near) == 1000 and all(r.a % 3 == 0 and r.b in (0, 3, 6, 9, 12, 15) for r in near)
    got = groups(density_peaks(df)).collect()
    assert len(got) == 200 and {r.typical_id for r in got} == {0}


def test_empty_and_tiny(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert nearest_above(none, 5, 0.9).collect() == [] and search(none, 5).collect() == []
    assert groups(density_peaks(none)).collect() == [] and descriptions(density_peaks(none)).collect() == []
    one = spark.createDataFrame([(50, [1.0] * 64, "", "")], SCHEMA)
    assert nearest_above(one, 5, 0.9).collect() == [] and search(one, 5).collect() == []


def test_code_bounds():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 64))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    code, scale, err = codes(u)
    approx = code.astype(np.float64) * scale[:, None]
    bound = err[:, None] + err[None, :] + err[:, None] * err[None, :]
    assert (np.abs(approx @ approx.T - u @ u.T) <= bound).all()
    assert err.max() < 0.03


def test_usable(data):
    df, _ = data
    ids = [r.vec_id for r in usable(df, "vec_id", "embedding", 64).collect()]
    assert max(ids) < 10_000 and len(ids) == 903
    inf = df.sparkSession.createDataFrame([(1, [float("inf")] + [1.0] * 63, "", ""), (2, [-float("inf")] + [1.0] * 63, "", ""), (3, [0.0] * 63 + [-1.0], "", ""), (4, [-0.0] * 64, "", "")], SCHEMA)
    assert [r.vec_id for r in usable(inf, "vec_id", "embedding", 64).collect()] == [3]
    f = fold_copies(usable(df, "vec_id", "embedding", 64))
    assert f.reps.count() == 900 - 29 and f.members.count() == 30 and f.reps.agg(F.max("copies")).head()[0] == 30


@pytest.fixture(scope="module")
def cells(spark):
    """The usable vectors of the largest test table: ids, unit vectors, and its pairs of cosine 0.9 or more by brute force."""
    df = spark.read.parquet("/root/testdata/sf0.1/cell_embedding.parquet")
    t = usable(df, "vec_id", "embedding", 64).toArrow()
    ids, unit = t["vec_id"].to_numpy(), unit_rows(t["embedding"], 64)
    pairs = []
    for a in range(0, len(unit), 4096):
        i, j = np.nonzero(unit[a : a + 4096] @ unit.T >= 0.9)
        pairs.append(np.c_[i + a, j][i + a < j])
    return df, ids, unit, np.concatenate(pairs)


@pytest.mark.parametrize("blocks", [20, 80, 320])
def test_visits_and_recall_do_not_depend_on_the_number_of_blocks(cells, blocks):
    df, ids, unit, pairs = cells
    vectors = usable(df, "vec_id", "embedding", 64)
    index = build_index(vectors, len(ids), 64, block_rows=len(ids) // blocks)
    assert len(index.pivots) == pytest.approx(blocks, rel=0.05)
    laid = lay_out(vectors, index, 64, record_type(64, 0))
    assert laid.count() == 6 * len(ids)
    near = nearest_pivots(unit, index.pivots, index.visits)
    met = lowest_common(near[pairs[:, 0]], near[pairs[:, 1]]) < blocks * 2
    assert len(pairs) > 5000 and met.mean() >= 0.9995


def test_joins_of_many_blocks_equal_brute_force(cells):
    df, ids, unit, pairs = cells
    want = {tuple(sorted((int(ids[i]), int(ids[j])))) for i, j in pairs}
    got = {tuple(r) for r in mutual_pairs(nearest_above(df, 1000, 0.9, block_rows=100)).collect()}
    assert got <= want and len(got) >= 0.9995 * len(want)
    hood = {}
    for i, j in pairs:
        hood.setdefault(i, {i}).add(j)
        hood.setdefault(j, {j}).add(i)
    cliques = {frozenset(int(ids[x]) for x in h) for h in hood.values() if len(h) >= 3 and all(hood[x] == h for x in h)}
    found = {}
    for r in groups(density_peaks(df, block_rows=100)).collect():
        found.setdefault(r.typical_id, set()).add(r.vec_id)
    assert len(cliques) > 100 and len({frozenset(x) for x in found.values()} ^ cliques) <= 0.002 * len(cliques)


def test_search_of_many_blocks_recalls_nearly_all(cells):
    df, ids, unit, _ = cells
    got = {}
    for r in search(df, 5, block_rows=100).collect():
        got.setdefault(r.a, set()).add(r.b)
    at = np.flatnonzero(ids % 50 == 0)
    s = unit[at] @ unit.T
    s[np.arange(len(at)), at] = -2
    hits = [len(got[int(ids[q])] & {int(ids[x]) for x in np.flatnonzero(s[n] >= np.sort(s[n])[-5] - 1e-6)}) for n, q in enumerate(at)]
    assert set(got) == {int(ids[q]) for q in at} and sum(hits) / (5 * len(at)) >= 0.93


@pytest.fixture(scope="module")
def bare_pairs(spark):
    """Directions without any order, two rows to each with a cosine barely above 0.9."""
    rng = np.random.default_rng(8)
    a, turn = rng.normal(size=(3000, 64)), rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    turn -= (turn * a).sum(axis=1, keepdims=True) * a
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    x = np.concatenate([a, 0.902 * a + np.sqrt(1 - 0.902**2) * turn]).astype(np.float32)
    return spark.createDataFrame([(i, [float(v) for v in r], "", "") for i, r in enumerate(x)], SCHEMA).repartition(4).cache()


def in_slices(monkeypatch, rows):
    import strandloom.llm.vectors as V

    monkeypatch.setattr(V, "SPREAD_ROWS", rows, raising=False)


@pytest.mark.parametrize("rows", [1000, 100_000])
def test_p5_loses_no_pair_at_any_size(bare_pairs, monkeypatch, rows):
    in_slices(monkeypatch, rows)
    assert {tuple(r) for r in mutual_pairs(nearest_above(bare_pairs, 5, 0.9, block_rows=100)).collect()} == {(i, i + 3000) for i in range(3000)}


@pytest.mark.parametrize("rows", [1000, 100_000])
def test_p2_loses_no_pair_at_any_size(bare_pairs, monkeypatch, rows):
    in_slices(monkeypatch, rows)
    found = density_peaks(bare_pairs, block_rows=100).nodes.select("vec_id", "density", "label", "isolated").collect()
    assert len(found) == 6000 and all((r.density, r.label, r.isolated) == (2, r.vec_id % 3000, True) for r in found)


@pytest.mark.parametrize("block_rows", [400, None])
def test_p5_search_loses_no_neighbour_at_any_size(cells, block_rows):
    """As many equals in cosine as brute force, to the last one, with 50 blocks and with one."""
    df, ids, unit, _ = cells
    rows = search(df, 5, block_rows=block_rows).collect()
    at = np.flatnonzero(ids % 50 == 0)
    s = unit[at] @ unit.T
    s[np.arange(len(at)), at] = -2
    best = {int(ids[q]): np.sort(s[n])[:-6:-1] for n, q in enumerate(at)}
    got = {}
    for r in rows:
        got.setdefault(r.a, []).append(r.cosine)
    assert set(got) == set(best)
    assert all(np.allclose(sorted(got[q], reverse=True), best[q], atol=1e-6) for q in best)
