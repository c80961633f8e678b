"""The transform of cell tables against numpy's of the whole mesh."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from halogrid.operators import power, transform


def cells(spark, m, keep):
    n = len(m)
    rows = [(i, j, k, float(m[i, j, k])) for i in range(n) for j in range(n) for k in range(n) if keep[i, j, k]]
    return spark.createDataFrame(rows, "ix int, iy int, iz int, v double").repartition(3)


@pytest.mark.parametrize("n", [4, 7])
def test_lines_and_back(spark, n):
    g = np.random.default_rng(n)
    m, keep = g.normal(size=(n, n, n)), g.random((n, n, n)) < 0.5
    keep[2], m[~keep] = False, -1.0  # a plane without cells
    m[2] = -1.0
    lines = transform.fourier_lines(cells(spark, m, keep), n, "v", -1.0)
    got = np.zeros((n, n, n // 2 + 1), complex)
    for r in transform.modes(lines, n).collect():
        got[r.ix, r.iy, r.iz] = r.re + 1j * r.im
    assert np.abs(got - np.fft.rfftn(m) / n**3).max() < 1e-14
    back = np.zeros((n, n, n))
    for r in transform.real_cells(lines, n, "v").collect():
        back[r.ix, r.iy, r.iz] = r.v
    assert np.abs(back - m).max() < 1e-13
    assert transform.fourier_lines(cells(spark, m, keep).limit(0), n, "v").collect() == []


@pytest.mark.parametrize("interlaced", [False, True])
def test_field_modes(spark, interlaced):
    g = np.random.default_rng(9)
    df = spark.createDataFrame([tuple(map(float, r)) for r in g.uniform(0, 100, (300, 3))], "x double, y double, z double")
    want = power.field_fft(df, 8, 100.0, interlaced=interlaced)
    m = power.field_modes(df, 8, 100.0, interlaced=interlaced)
    assert max(abs(complex(r.re, r.im) - want[r.ix, r.iy, r.iz]) for r in m.collect()) < 1e-12
    k, mu = power.k_mu_edges(8, 100.0, np.pi * 8 / 100, 5, 2, False)
    b = power.bin_modes(abs(want) ** 2 * 1e6, 8, 100.0, k, mu, (0, 2))
    for r in power.power_spectrum(df, 100.0, 8, 5, 2, poles=(0, 2), interlaced=interlaced).collect():
        assert r.n_modes == b["n_modes"][r.k_bin, r.mu_bin]
        if r.n_modes:
            assert abs(r.power - b["power"][r.k_bin, r.mu_bin]) < 1e-6 and abs(r.pole_2 - b["poles"][1, r.k_bin]) < 1e-6


def test_plan_holds_no_mesh(spark):
    df = spark.range(1).select(*[F.lit(1.0).alias(c) for c in "xyz"])
    plan = power.power_spectrum(df, 100.0, 8, 5)._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" in plan and "LogicalRDD" not in plan
