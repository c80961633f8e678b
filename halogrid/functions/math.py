"""Scalar functions as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abramowitz and Stegun 7.1.26, fixed values.
ERF_P, ERF_A = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def erf(x: Column) -> Column:
    """Error function to 1.5e-7."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * F.abs(x))
    poly = F.lit(ERF_A[4])
    for a in ERF_A[3::-1]:
        poly = poly * t + F.lit(a)
    y = F.lit(1.0) - poly * t * F.exp(-x * x)
    return F.when(x >= 0, y).otherwise(-y)


def wrap_dx(d: Column, box: float) -> Column:
    """Displacement to the nearest periodic image."""
    return d - F.lit(box) * F.rint(d / F.lit(box))


def wrap(x: Column, box: float) -> Column:
    """Into [-box/2, box/2)."""
    return F.pmod(x + F.lit(box / 2), F.lit(box)) - F.lit(box / 2)


def legendre(x2: Column, n: int) -> Column:
    """Legendre polynomial of even or odd order n up to 10; odd orders are given divided by x, as a function of x squared."""
    if not 0 <= n <= 10:
        raise ValueError("order must be from 0 to 10")
    out = F.lit(0.0)
    for k in range(n // 2, -1, -1):
        m = n - 2 * k
        c = (-1) ** k * math.comb(n, k) * math.comb(2 * n - 2 * k, n) / 2**n
        out = out + F.lit(c) * F.pow(x2, F.lit(float(m // 2)))
    return out


def uniform(key: Column, stream: int) -> Column:
    """Counter-based uniform number in [0, 1) that does not depend on partitioning."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(stream)), 11) * F.lit(2.0**-53)


def normal(key: Column, stream: int) -> Column:
    """Standard normal number by Box and Muller."""
    u = F.lit(1.0) - uniform(key, stream)
    return F.sqrt(-2.0 * F.log(u)) * F.cos(F.lit(2 * math.pi) * uniform(key, stream + 1_000_003))


# Mean occupations; m is the mass, other arguments numbers.


def n_cen_lrg(m: Column, logm_cut: float | Column, sigma: float) -> Column:
    cut = logm_cut if isinstance(logm_cut, Column) else F.lit(logm_cut)
    return F.lit(0.5) * (F.lit(1.0) - erf((cut - F.log10(m)) / F.lit(1.41421356 * sigma)))


def n_sat(m: Column, m_cut: Column | float, kappa: float, m1: Column | float, alpha: float, amplitude: float = 1.0) -> Column:
    """Power law above kappa * m_cut."""
    low = F.lit(kappa) * (m_cut if isinstance(m_cut, Column) else F.lit(m_cut))
    scale = m1 if isinstance(m1, Column) else F.lit(m1)
    return F.when(m > low, F.lit(amplitude) * F.pow((m - low) / scale, F.lit(alpha))).otherwise(F.lit(0.0))


def gaussian(x: Column, mean: float | Column, sigma: float) -> Column:
    d = x - (mean if isinstance(mean, Column) else F.lit(mean))
    return F.lit(0.3989422804014327 / sigma) * F.exp(-d * d / F.lit(2 * sigma * sigma))


def n_cen_elg(m: Column, p_max: float, q: float, logm_cut: float | Column, sigma: float, gamma: float, norm: float = 1.0) -> Column:
    """Skewed peak around logm_cut."""
    x = F.log10(m) - (logm_cut if isinstance(logm_cut, Column) else F.lit(logm_cut))
    big = F.lit(0.5) * (F.lit(1.0) + erf(x * F.lit(gamma / sigma / math.sqrt(2))))
    return F.lit(2 * (p_max - 1 / q) / norm) * gaussian(x, 0.0, sigma) * big


def n_cen_elg_power(m: Column, p_max: float, logm_cut: float, sigma: float, gamma: float) -> Column:
    """Peak below the cut, power law above it."""
    x = F.log10(m)
    return F.when(x <= logm_cut, F.lit(p_max) * gaussian(x, logm_cut, sigma)).otherwise(F.lit(p_max / (2.5066283 * sigma)) * F.pow(m / F.lit(10**logm_cut), F.lit(gamma)))


def n_cen_qso(m: Column, logm_cut: float | Column, sigma: float) -> Column:
    cut = logm_cut if isinstance(logm_cut, Column) else F.lit(logm_cut)
    return F.lit(0.5) * (F.lit(1.0) + erf((F.log10(m) - cut) / F.lit(1.41421356 * sigma)))


def top_hat(kr: Column) -> Column:
    return F.when(kr == 0, 1.0).otherwise(3.0 * (F.sin(kr) - kr * F.cos(kr)) / F.pow(kr, F.lit(3.0)))


def gaussian_window(kr: Column) -> Column:
    return F.exp(-kr * kr / 2)
