"""Control variates, fields on meshes and mode tables against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from halogrid.operators import fields, modes, power, ranks, variates

BOX = 100.0


def mesh(n=8, seed=1):
    return np.random.default_rng(seed).normal(size=(n, n, n))


def test_smoothing_series_and_covariance():
    x = np.linspace(0, 1, 60)
    np.testing.assert_allclose(variates.smooth(x**3 - x), x**3 - x, atol=1e-9)
    assert not variates.smooth(x[:10]).any()
    assert variates.multipole_cov(1.0, 0.0, 0.0, 0) == pytest.approx(1.0)


def series(seed=2, n=60):
    r = np.random.default_rng(seed)
    k = np.linspace(0.01, 0.6, n)
    pairs = {}
    for i, a in enumerate(variates.FIELDS):
        for b in variates.FIELDS[: i + 1]:
            pairs[a, b] = 1000 * np.exp(-k * (3 + r.random())) + r.random() * 50
    return k, pairs


def test_combination_against_the_square_of_a_sum():
    """Fields of one mode: the spectrum of the sum is the square of the sum, less nabla2's own square."""
    f = dict(zip(variates.FIELDS, (2.0, -1.0, 0.5, 3.0, 0.25), strict=True))
    b1, b2, bs, bn = 1.5, 0.8, -0.3, 0.2
    pairs = {(a, b): np.array([f[a] * f[b]]) for a in f for b in f}
    total = f["1cb"] + b1 * f["delta"] + b2 / 2 * f["delta2"] + bs * f["tidal2"] + bn * f["nabla2"]
    got = variates.combine_spectra(np.zeros(1), pairs, [b1, b2, bs, bn], 7.0, measured_nabla=True)
    assert got[0] == pytest.approx(total**2 - (bn * f["nabla2"]) ** 2 + 7)
    assert variates.combine_cross_spectra({a: np.array([f[a] * 2]) for a in f}, [b1, b2, bs, bn])[0] == pytest.approx(2 * total)
    k = np.array([0.3])
    got = variates.combine_spectra(k, pairs, [0, 0, 0, bn])[0]
    assert got == pytest.approx(f["1cb"] ** 2 * (1 - 2 * bn * 0.09))


def test_bias_is_recovered():
    k, pairs = series()
    true = np.array([1.2, 0.4, -0.5, 0.0])
    p = variates.combine_spectra(k, pairs, true, 80.0)
    got = variates.measure_bias(k, pairs, p, 4, 0.5)
    np.testing.assert_allclose(variates.combine_spectra(k, pairs, got[:-1], got[-1]), p, rtol=1e-4)
    lin = {key: np.stack([pairs["delta", "delta"] * (i + 1 + j) for i in range(3)]) for j, key in enumerate((("delta", "delta"), ("deltamu2", "delta"), ("deltamu2", "deltamu2")))}
    p = variates.combine_kaiser(k, lin, 0.8, 1.7, 0.5, "reciso", 10.0)
    assert variates.measure_bias_linear(k, lin, p, 0.8, 0.5, 0.3, "reciso", 10.0) == pytest.approx(1.7, abs=1e-5)
    with pytest.raises(ValueError):
        variates.effective_growth_rate(k, 0.5, "other")


def test_reduction_removes_shared_noise():
    """A surrogate that has all of the noise takes it away where beta is 1, and less of it where beta is damped."""
    k = np.linspace(0.01, 1.2, 80)
    mean = np.stack([1000 * np.exp(-k), 400 * np.exp(-k), 100 * np.exp(-k)])
    noise = 0.02 * mean * np.sin(60 * k)
    got = variates.reduced(k, mean + noise, mean + noise, mean + noise, mean)
    low = (k > 0.05) & (k < 0.2)
    assert abs(got["reduced"] - mean)[:, low].max() < 0.05 * abs(noise)[:, low].max()
    assert got["beta"][0, 2] == pytest.approx(1, abs=0.01) and got["beta"][0, -1] < 0.01
    assert np.allclose(got["rho"], 1) and got["reduced"].shape == (3, 80)
    short = variates.reduced(k[:10], mean[0, :10], mean[0, :10], mean[0, :10], mean[0, :10])
    assert not short["beta"].any()  # too few k to smooth


def test_variates_end_to_end_and_mode_by_mode():
    n, edges = 16, fields.default_edges(16, BOX, 8)
    k = (edges[1:] + edges[:-1]) / 2
    delta = mesh(n)
    initial = {"1cb": delta, **fields.initial_fields(delta, BOX)}
    ffts = {a: np.fft.rfftn(f) / n**3 for a, f in initial.items()}
    pairs = {key: r["poles"] for key, r in fields.pair_spectra(ffts, BOX, 1.0, edges).items()}
    cross = {a: pairs.get((a, "delta"), pairs.get(("delta", a))) for a in fields.FIELDS}
    out = variates.zeldovich_variate(k, (pairs, cross, pairs["delta", "delta"]), (pairs, cross, pairs["delta", "delta"]), pairs, 5, 2.0, one_below=0.1)
    np.testing.assert_allclose(out["reduced"], pairs["delta", "delta"])  # the surrogate equals its mean
    p = (ffts["delta"] * ffts["delta"].conj()).real * BOX**3
    flat = pairs["delta", "delta"]
    got = variates.reduce_modes(p, p, p, flat, n, BOX, edges, window=5)
    beta = variates.expand(k, got["beta"][:1], n, BOX, (0,))
    np.testing.assert_allclose(got["modes"], p - beta * (p - variates.expand(k, flat, n, BOX, (0, 2, 4))))


def test_fields_against_direct_sums():
    n = 8
    f = mesh(n)
    np.testing.assert_allclose(fields.gaussian_filter(f, BOX, 1e9), f, atol=1e-9)
    x = np.arange(n) * BOX / n
    wave = np.cos(2 * np.pi * 2 * x / BOX)[:, None, None] * np.ones((n, n, n))
    q = 2 * np.pi * 2 / BOX
    np.testing.assert_allclose(fields.laplacian(wave, BOX), -q * q * wave, atol=1e-9)
    np.testing.assert_allclose(fields.gaussian_filter(wave, BOX, 0.2), np.exp(-q * q / 0.08) * wave, atol=1e-9)
    # One wave along x: s_xx = 2/3, s_yy = s_zz = -1/3 of it.
    np.testing.assert_allclose(fields.tidal_square(wave, BOX), wave**2 * (4 / 9 + 2 / 9), atol=1e-9)
    got = fields.initial_fields(f, BOX)
    assert all(abs(got[a].mean()) < 1e-12 for a in ("delta", "delta2", "tidal2"))


def test_shear_against_eigenvalues():
    n = 8
    f = mesh(n)
    t = power.tidal_field(np.fft.rfftn(f), BOX)
    got = power.shear(t, n)
    real = {key: np.fft.irfftn(x, s=(n, n, n), axes=(0, 1, 2)) for key, x in t.items()}
    m = np.array([[real[min(i, j), max(i, j)] for j in range(3)] for i in range(3)]).transpose(2, 3, 4, 0, 1)
    e = np.linalg.eigvalsh(m)
    want = np.sqrt(0.5 * ((e[..., 0] - e[..., 1]) ** 2 + (e[..., 1] - e[..., 2]) ** 2 + (e[..., 2] - e[..., 0]) ** 2))
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_lattice_at_rest_has_the_initial_spectrum(spark):
    """Without displacement and with weights of a field, the deposit is the field smoothed by the window, which is taken out again."""
    n, edges = 4, fields.default_edges(4, BOX, 2)
    f = mesh(n)
    f -= f.mean()
    cells = power.cells_frame(spark, f, "value")
    still = cells.select("ix", "iy", "iz", *[F.lit(0.0).alias(f"d{a}") for a in "xyz"])
    lattice = fields.displaced_lattice(spark, n, BOX, still, 0.7, 0.5)
    got = fields.advected_spectra(lattice, {"delta": cells}, n, BOX, 0.5, edges, kind="cic")
    assert np.allclose(got["1cb", "1cb"]["poles"][0], 0, atol=1e-9)
    fk = np.fft.rfftn(f) / n**3
    w = power.compensation(n, "cic", False)
    w = w[:, None, None] * w[None, :, None] * w[None, None, : n // 2 + 1]
    want = power.bin_modes(abs(fk / w) ** 2 * BOX**3 * 0.25, n, BOX, edges, np.array([0.0, 1.0]), (0, 2, 4))
    np.testing.assert_allclose(got["delta", "delta"]["poles"], want["poles"], rtol=1e-6)


def test_window_of_one_input_bin_conserves_the_monopole(spark):
    m = modes.window_matrix(spark, 8, BOX, [0.0, 0.1, 0.2], [0.05, 0.15]).toPandas()
    own = m[(m.l == 0) & (m.lp == 0)]
    assert sorted(zip(own.k_bin, own.i_in, own.window.round(9), strict=True)) == [(0, 0, 1.0), (1, 1, 1.0)]


def test_perihelion_against_a_loop(spark):
    r = np.random.default_rng(4)
    rows = [tuple(map(float, x)) for x in r.uniform(0.05, 2, (40, 5))] + [(0.0, 1.0, 0.5, 0.2, 1.0), (0.0, 0.0, 0.5, 0.2, 1.0)]
    df = spark.createDataFrame(rows, "t double, v double, r0 double, rs double, al double")
    got = df.select("*", ranks.perihelion(*[F.col(c) for c in ("t", "v", "r0", "rs", "al")]).alias("x")).collect()
    for row in got:
        with np.errstate(all="ignore"):
            x2 = np.float64(row.t) / (row.t + row.v)
            for _ in range(20):
                x2 = row.t / (row.t + row.v + row.al * (np.log(1 + np.sqrt(x2) * row.r0 / row.rs) / np.sqrt(x2) - np.log(1 + row.r0 / row.rs)))
        assert row.x == pytest.approx(1.0 if np.isnan(x2) else x2, rel=1e-9)
