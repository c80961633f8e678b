"""The pair queries over all halos, against all pairs."""

import numpy as np
import pytest

from halogrid.operators import neighbors
from halogrid.queries import QUERIES
from halogrid.sources.adapters import BOX, halos

SF = "/root/testdata/sf0.001"
EDGES = np.array([5.0, 20.0, 40.0, 80.0])


@pytest.fixture(scope="module")
def all_pairs(spark):
    rows = halos(spark, SF).select("id", "n", "x", "y", "z").toPandas()
    x = rows[["x", "y", "z"]].to_numpy()
    d = abs(x[:, None] - x[None])
    d = np.minimum(d, BOX - d)
    d2 = (d**2).sum(2)
    np.fill_diagonal(d2, -1)  # a halo with itself is no pair
    return rows["id"].to_numpy(), rows["n"].to_numpy(), d, d2


def counts(d2, edges=EDGES):
    return [int(((d2 >= a * a) & (d2 < b * b)).sum()) for a, b in zip(edges, edges[1:])]


def test_pair_counts(spark, all_pairs):
    ids, _, _, d2 = all_pairs
    got = {r.bin: r.npairs for r in QUERIES["pair_counts_s"](spark, SF).collect()}
    assert got == dict(enumerate(counts(d2)))
    cross = counts(d2[ids % 2 == 0][:, ids % 2 == 1])
    got = {(r.t1, r.t2, r.bin): r.npairs for r in QUERIES["xi_cross_tracer"](spark, SF).collect()}
    assert got == {(*t, i): n for t in (("even", "odd"), ("odd", "even")) for i, n in enumerate(cross)}


@pytest.mark.parametrize("box,crowd", [(1000.0, 20_000), (200.0, 20_000), (100.0, 20_000), (1000.0, 3)])
def test_pairs_of_few_cells_and_of_crowded_ones(spark, monkeypatch, box, crowd):
    """Boxes of one and two cells a side wrap displacements; crowded cells are dealt out; both ways of counting agree, empty bins included."""
    monkeypatch.setattr(neighbors, "CROWD", crowd)
    r = np.random.default_rng(3)
    x = np.concatenate((r.random((150, 3)) * box, np.full((30, 3), box / 3) + r.random((30, 3))))
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(x.tolist())], "id long, x double, y double, z double")
    d = abs(x[:, None] - x[None])
    d2 = (np.minimum(d, box - d) ** 2).sum(2)
    np.fill_diagonal(d2, -1)
    edges = [0.001, 0.002, 1.0, 30.0, 49.0]
    want = dict(enumerate(counts(d2, edges)))
    assert want[0] == 0
    assert {r.bin: r.npairs for r in neighbors.pair_counts(df, df, edges, box, True).collect()} == want
    assert {r.bin: r.npairs for r in neighbors.pair_counts(df, df, edges, box, False).collect()} == want


def test_environment(spark, all_pairs):
    ids, n, _, d2 = all_pairs
    near = (d2 > 900) & (d2 <= 6400)
    want = {int(i): int(m) if c > 1000 else 0 for i, c, m in zip(ids, n, near @ n)}
    assert {r.id: r.menv for r in QUERIES["menv_two_apertures"](spark, SF).collect()} == want


def test_projected(spark, all_pairs):
    ids, _, d, d2 = all_pairs
    rp2, pi = (d[:, :, :2] ** 2).sum(2), np.floor(d[:, :, 2] / 5)
    want, wp = {}, {}
    for i, (a, b) in enumerate(zip(EDGES, EDGES[1:])):
        for j in range(8):
            k = int(((d2 >= 0) & (rp2 >= a * a) & (rp2 < b * b) & (pi == j)).sum())
            want[i, j] = k, k / (len(ids) ** 2 * np.pi * (b * b - a * a) * 10 / BOX**3) - 1
            wp[i] = wp.get(i, 0) + 10 * want[i, j][1]
    got = {(r.rp_bin, r.pi_bin): (r.npairs, r.xi) for r in QUERIES["xi_rppi"](spark, SF).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(v[1], abs=1e-6) for k, v in want.items())
    assert {r.rp_bin: r.wp for r in QUERIES["wp_rp"](spark, SF).collect()} == pytest.approx(wp, abs=1e-4)


def test_multipoles(spark, all_pairs):
    ids, _, d, d2 = all_pairs
    want = {}
    for i, (a, b) in enumerate(zip(EDGES, EDGES[1:])):
        at = (d2 >= a * a) & (d2 < b * b)
        mu = np.minimum(np.floor(d[:, :, 2][at] / np.sqrt(d2[at]) * 10), 9)
        for j in range(10):
            xi = (mu == j).sum() / (len(ids) ** 2 * 4 / 3 * np.pi * (b**3 - a**3) / 10 / BOX**3) - 1
            m = want.setdefault(i, [0, 0])
            m[0] += xi / 10
            m[1] += xi / 2 * (1.5 * ((j + 0.5) / 10) ** 2 - 0.5)
    got = {r.s_bin: (r.xi_0, r.xi_2) for r in QUERIES["xi_multipoles"](spark, SF).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(v, abs=1e-5) for k, v in want.items())
