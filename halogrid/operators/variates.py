"""Control variates: a measured spectrum minus a fitted multiple of a correlated one whose mean is known.  Small arrays, numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def multipole_cov(p0, p2, p4, ell: int):
    """Gaussian diagonal covariance of a multipole, up to the number of modes, from its even multipoles (numbers, arrays or columns).

    Exact integrals of (2l + 1)**2 P_l**2 (sum of p_m P_m)**2 over mu from 0 to 1, by Gauss-Legendre weights.
    """
    x, w = np.polynomial.legendre.leggauss(12)
    x, w = (x + 1) / 2, w / 2
    basis = [np.polynomial.legendre.Legendre.basis(m)(x) for m in (0, 2, 4)]
    weight = w * (2 * ell + 1) ** 2 * np.polynomial.legendre.Legendre.basis(ell)(x) ** 2
    out = None
    ps = (p0, p2, p4)
    for i in range(3):
        for j in range(i, 3):
            c = round(float((weight * basis[i] * basis[j]).sum()) * (1 if i == j else 2), 12)
            term = (F.lit(c) if isinstance(p0, Column) else c) * ps[i] * ps[j]
            out = term if out is None else out + term
    return out


def kaiser_poles(b, f: float) -> tuple:
    """Monopole, quadrupole and hexadecapole factors."""
    return b * b + b * (2 / 3 * f) + f * f / 5, b * (4 / 3 * f) + 4 / 7 * f * f, 8 / 35 * f * f + b * 0


def smooth(x: np.ndarray, window: int = 21, order: int = 3) -> np.ndarray:
    """Savitzky-Golay filter: a polynomial fitted to each window, at its centre (at the ends: the end window's); zeros for short series."""
    if len(x) < window:
        return np.zeros_like(x, dtype=float)
    h = window // 2
    t = np.arange(-h, h + 1)
    a = np.vander(t, order + 1, increasing=True)
    fit = np.linalg.pinv(a)
    out = np.convolve(x, fit[0][::-1], "same")
    out[:h] = a[:h] @ (fit @ x[:window])
    out[-h:] = a[-h:] @ (fit @ x[-window:])
    return out


#: Fields of the bias expansion, in the order of their parameters after the first, which has none.
FIELDS = ("1cb", "delta", "delta2", "tidal2", "nabla2")
#: Where the damping of beta sets in and how wide it is, and up to which wave number beta is 1.
K0, WIDTH, ONE_BELOW = 0.618, 0.167, 0.05

Spectra = dict[tuple[str, str], np.ndarray]


def _coefficients(bias: np.ndarray) -> dict[str, float]:
    """What each field counts in the model: 1, b1, b2 / 2, bs, bn; parameters that are not given are 0."""
    b = [1.0, *np.asarray(bias, float)[:4], *[0.0] * 4][:5]
    return dict(zip(FIELDS, (b[0], b[1], b[2] / 2, b[3], b[4]), strict=True))


def combine_spectra(k: np.ndarray, spectra: Spectra, bias: np.ndarray, noise: float = 0.0, redshift_space: bool = False, measured_nabla: bool = False) -> np.ndarray:
    """Model spectrum from those of pairs of fields (later field first): products of the coefficients, twice off the diagonal.

    In real space, pairs with nabla2 are -k**2 times those with 1cb (unless measured_nabla) and the noise is added; in
    redshift space spectra have a row for each multipole, pairs with nabla2 do not count and there is no noise.
    nabla2 with itself never counts.
    """
    c, out = _coefficients(bias), 0.0
    for i, x in enumerate(FIELDS):
        for y in FIELDS[: i + 1]:
            if (x, y) == ("nabla2", "nabla2") or x == "nabla2" and redshift_space or not c[x] * c[y]:
                continue
            p = -(k**2) * spectra[y, "1cb"] if x == "nabla2" and not measured_nabla else spectra[x, y]
            out = out + (1 if x == y else 2) * c[x] * c[y] * p
    return out if redshift_space else out + noise


def combine_cross_spectra(spectra: dict[str, np.ndarray], bias: np.ndarray) -> np.ndarray:
    """Spectrum of the model with the tracers, from those of the fields with the tracers."""
    c = _coefficients(bias)
    return sum(c[x] * spectra[x] for x in FIELDS if x in spectra)


def effective_growth_rate(k: np.ndarray, f: float, algorithm: str, radius: float | None = None) -> np.ndarray:
    """f for a symmetric reconstruction, f times (1 - smoothing) for an isotropic one."""
    if algorithm == "recsym":
        return np.full_like(np.asarray(k, float), f)
    if algorithm != "reciso" or radius is None:
        raise ValueError("recsym, or reciso with a smoothing radius")
    return f * (1 - np.exp(-(np.asarray(k) ** 2) * radius**2 / 2))


def combine_kaiser(k: np.ndarray, spectra: Spectra, growth: float, bias: float, f: float, algorithm: str = "recsym", radius: float | None = None) -> np.ndarray:
    """Linear model: the spectrum of growth * (bias * delta + f * mu**2 delta)."""
    e = effective_growth_rate(k, f, algorithm, radius)
    return growth**2 * (bias**2 * spectra["delta", "delta"] + 2 * bias * e * spectra["deltamu2", "delta"] + e**2 * spectra["deltamu2", "deltamu2"])


def combine_cross_kaiser(k: np.ndarray, spectra: dict[str, np.ndarray], growth: float, bias: float, f: float, algorithm: str = "recsym", radius: float | None = None) -> np.ndarray:
    return growth * (bias * spectra["delta"] + effective_growth_rate(k, f, algorithm, radius) * spectra["deltamu2"])


def linear_poles(power: np.ndarray, growth: float, bias: float, f: np.ndarray | float, poles: tuple[int, ...] = (0, 2, 4)) -> np.ndarray:
    """Kaiser multipoles of a linear spectrum."""
    factors = dict(zip((0, 2, 4), kaiser_poles(bias, f), strict=True))
    return np.stack([factors[ell] * power * growth**2 for ell in poles])


def power_tables(frame: DataFrame, tracer: str = "tr") -> tuple[np.ndarray, Spectra, dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """k, pairs of fields, fields with tracers, tracers and numbers of modes, from rows (a, b, k_bin, k, n_modes, poles array)."""
    by: dict[tuple[str, str], list] = {}
    for r in frame.orderBy("k_bin").collect():  # bins of the spectra
        by.setdefault((r.a, r.b), []).append((r.k, r.n_modes, r.poles))
    tables = {key: np.array([x[2] for x in rows], float).T for key, rows in by.items()}
    some = by[tracer, tracer]
    pairs = {key: p for key, p in tables.items() if tracer not in key}
    cross = {a: p for (a, b), p in tables.items() if b == tracer and a != tracer}
    return np.array([x[0] for x in some]), pairs, cross, tables[tracer, tracer], np.array([x[1] for x in some])


def _least_squares(residual, start: np.ndarray, steps: int = 200) -> np.ndarray:
    """Minimum of the sum of squared residuals, by damped Gauss-Newton steps with numerical derivatives."""
    x, damp = np.array(start, float), 1e-3
    r = residual(x)
    for _ in range(steps):
        j = np.stack([(residual(x + h) - residual(x - h)) / 2e-6 for h in np.eye(len(x)) * 1e-6], 1)
        a, g = j.T @ j, j.T @ r
        step = np.linalg.lstsq(a + damp * np.diag(np.diag(a) + 1e-12), -g, rcond=None)[0]
        new = residual(x + step)
        if new @ new <= r @ r:
            done = r @ r - new @ new <= 1e-15 * (r @ r) + 1e-300
            x, r, damp = x + step, new, damp / 10
            if done:
                break
        else:
            damp *= 10
            if damp > 1e12:
                break
    return x


def measure_bias(k: np.ndarray, pairs: Spectra, measured: np.ndarray, n_fields: int, k_max: float, k_min: float = 0.0) -> np.ndarray:
    """b1, b2, bs, bn (as far as there are fields) and the noise that fit a real-space spectrum, each k weighing by its relative error; the first k never counts."""
    lo, hi = max(1, int(np.searchsorted(k, k_min))), int(np.searchsorted(k, k_max))
    kk, p = k[lo:hi], measured[lo:hi]
    cut = {key: x[lo:hi] for key, x in pairs.items()}
    got = _least_squares(lambda b: (p - combine_spectra(kk, cut, b[:-1], b[-1])) / (np.sqrt(2) * p), np.zeros(n_fields))
    return np.concatenate((got[:-1], np.zeros(5 - n_fields), got[-1:]))


def measure_bias_linear(k: np.ndarray, pairs: Spectra, measured: np.ndarray, growth: float, f: float, k_max: float, algorithm: str = "recsym", radius: float | None = None, ell_max: int = 2, k_min: float = 0.0) -> float:
    """The one bias of the linear model that fits the first ell_max multipoles."""
    lo, hi = int(np.searchsorted(k, k_min)), int(np.searchsorted(k, k_max))
    p = measured[:ell_max, lo:hi]
    cut = {key: x[:, lo:hi] for key, x in pairs.items()}
    model = lambda b: combine_kaiser(k[lo:hi], cut, growth, b[0], f, algorithm, radius)[:ell_max]
    return float(_least_squares(lambda b: ((p - model(b)) / (np.sqrt(2) * p)).ravel(), np.ones(1))[0])


def covariances(p: np.ndarray, poles: tuple[int, ...]) -> np.ndarray:
    """Disconnected covariance, up to the number of modes, of multipoles or of a lone real-space spectrum."""
    p = np.atleast_2d(p)
    return 2 * p**2 if len(p) == 1 else np.stack([multipole_cov(*p, ell) for ell in poles])


def damped_beta(k: np.ndarray, cross: np.ndarray, surrogate: np.ndarray, poles: tuple[int, ...], k0: float = K0, width: float = WIDTH, one_below: float = ONE_BELOW, window: int = 21) -> np.ndarray:
    """Covariance over variance, damped at large k, 1 at small k, 0 where undefined, smoothed; zeros if there are too few k to smooth."""
    with np.errstate(divide="ignore", invalid="ignore"):
        beta = covariances(cross, poles) / covariances(surrogate, poles)
        beta = 0.5 * (1 - np.tanh((k - k0) / width)) * beta
    beta = np.nan_to_num(beta, nan=0.0, posinf=np.inf, neginf=-np.inf)
    beta[:, : int(np.searchsorted(k, one_below))] = 1.0
    return np.stack([smooth(b, window) for b in beta])


def reduced(k: np.ndarray, measured: np.ndarray, surrogate: np.ndarray, cross: np.ndarray, mean: np.ndarray, poles: tuple[int, ...] = (0, 2, 4), **damping) -> dict[str, np.ndarray]:
    """Measured multipoles (or a lone spectrum) less beta times the surrogate's deviation from its known mean, with correlations and their limit by noise."""
    beta = damped_beta(k, cross, surrogate, poles, **damping)
    one = np.ndim(measured) == 1
    p, z, c, m = (np.atleast_2d(x) for x in (measured, surrogate, cross, mean))
    noiseless = p.copy()
    noiseless[0] -= p[0] - 2 * c[0] + z[0]
    var_p, var_z = covariances(p, poles), covariances(z, poles)
    with np.errstate(divide="ignore", invalid="ignore"):
        rho = np.nan_to_num(covariances(c, poles) / np.sqrt(var_z * var_p), nan=0.0)
        limit = covariances(noiseless, poles) / np.sqrt(var_p * covariances(noiseless, poles))
    out = {"reduced": p - beta * (z - m), "beta": beta, "rho": rho, "rho_limit": limit}
    return {key: x[0] if one else x for key, x in out.items()}


def convolve(window: np.ndarray, poles: np.ndarray) -> np.ndarray:
    """Multipoles after the mode coupling of the mesh: window has a row for each output (pole, bin) and a column for each input."""
    return (window.T @ np.hstack(poles)).reshape(len(poles), -1)


def zeldovich_variate(k: np.ndarray, real: tuple, redshift: tuple | None, theory: Spectra, n_fields: int, k_max: float = 0.15, window: np.ndarray | None = None, poles: tuple[int, ...] = (0, 2, 4), **damping) -> dict[str, np.ndarray]:
    """Reduce tracer spectra by advected fields.  real and redshift are (pairs, cross, measured); theory has the pairs' ensemble means.

    The bias is fitted in real space; with redshift, its multipoles are reduced, and the theory's go through the window.
    """
    pairs, cross, measured = real
    first = lambda x: x[0] if np.ndim(x) == 2 else x
    bias = measure_bias(k, {key: first(p) for key, p in pairs.items()}, first(measured), n_fields, k_max)
    rsd = redshift is not None
    if rsd:
        pairs, cross, measured = redshift
    z = combine_spectra(k, pairs, bias[:-1], bias[-1], rsd)
    mean = combine_spectra(k, theory, bias[:-1], bias[-1], rsd)
    if rsd and window is not None:
        mean = convolve(window, mean)
    c = combine_cross_spectra(cross, bias[:-1])
    return {"bias": bias, "surrogate": z, "cross": c, "mean": mean} | reduced(k, measured, z, c, mean, poles, **damping)


def linear_variate(k: np.ndarray, pairs: Spectra, cross: dict[str, np.ndarray], measured: np.ndarray, k_theory: np.ndarray, theory: np.ndarray, growth: float, f: float, k_max: float = 0.08, algorithm: str = "recsym", radius: float | None = None, window: np.ndarray | None = None, poles: tuple[int, ...] = (0, 2, 4), **damping) -> dict[str, np.ndarray]:
    """Reduce the multipoles of a reconstructed catalog by the linear density, in the Kaiser approximation."""
    bias = measure_bias_linear(k, pairs, measured, growth, f, k_max, algorithm, radius, ell_max=1)
    mean = linear_poles(theory, growth, bias, effective_growth_rate(k_theory, f, algorithm, radius), poles)
    mean = np.stack([_line(k, k_theory, m) for m in mean])
    if window is not None:
        mean = convolve(window, mean)
    z = combine_kaiser(k, pairs, growth, bias, f, algorithm, radius)
    c = combine_cross_kaiser(k, cross, growth, bias, f, algorithm, radius)
    return {"bias": bias, "surrogate": z, "cross": c, "mean": mean} | reduced(k, measured, z, c, mean, poles, **damping)


def _line(x: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Linear interpolation, continued by the end pieces."""
    i = np.clip(np.searchsorted(xs, x) - 1, 0, len(xs) - 2)
    return ys[i] + (x - xs[i]) * (ys[i + 1] - ys[i]) / (xs[i + 1] - xs[i])


def reduce_modes(measured: np.ndarray, surrogate: np.ndarray, cross: np.ndarray, mean: np.ndarray, n: int, box: float, k_edges: np.ndarray, poles: tuple[int, ...] = (0, 2, 4), **damping) -> dict[str, np.ndarray]:
    """The same mode by mode: half meshes of spectra and the mean's multipoles (poles x k); beta is that of the monopole.

    Multipoles of the meshes give beta; the reduced mesh and its multipoles are returned.
    """
    from .power import bin_modes

    one = np.array([0.0, 1.0])
    project = lambda p: bin_modes(p, n, box, k_edges, one, poles)["poles"]
    k = (k_edges[1:] + k_edges[:-1]) / 2
    beta = damped_beta(k, project(cross), project(surrogate), poles, **damping)
    out = measured - expand(k, beta[:1], n, box, (0,)) * (surrogate - expand(k, mean, n, box, poles))
    return {"modes": out, "reduced": project(out), "beta": beta}


def expand(k: np.ndarray, p: np.ndarray, n: int, box: float, poles: tuple[int, ...]) -> np.ndarray:
    """Half mesh of the sum of multipoles at equal steps of k times their Legendre polynomials; the ends' values beyond the table."""
    m = np.fft.fftfreq(n, 1 / n)
    iz = np.arange(n // 2 + 1)
    i2 = m[:, None, None] ** 2 + m[None, :, None] ** 2 + iz[None, None, :] ** 2
    mu = np.sqrt(iz[None, None, :] ** 2 / np.where(i2 > 0, i2, 1))
    at = np.sqrt(i2) * 2 * np.pi / box
    return sum(np.interp(at, k, row) * np.polynomial.legendre.Legendre.basis(ell)(mu) for ell, row in zip(poles, p, strict=True))
