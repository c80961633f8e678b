"""Fields on a mesh: filters, second-order fields of the initial conditions, advected and tracer spectra.

Points are reduced to cell tables by Spark; the transforms of one dense mesh are numpy on the driver (n**3 cells, a
size that the caller chooses).
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mesh import deposit
from .power import bin_modes, compensation, dense, field_fft, k_mu_edges

#: Fields of the bias expansion in their fixed order, and the power of the growth factor that each takes.
FIELDS, GROWTH = ("1cb", "delta", "delta2", "tidal2", "nabla2"), {"1cb": 0, "delta": 1, "delta2": 2, "tidal2": 2, "nabla2": 1}


def _wave(n: int, box: float) -> tuple[np.ndarray, ...]:
    k = np.fft.fftfreq(n, 1 / n) * 2 * np.pi / box
    return k[:, None, None], k[None, :, None], (np.arange(n // 2 + 1) * 2 * np.pi / box)[None, None, :]


def _k2(n: int, box: float) -> np.ndarray:
    return sum(x**2 for x in _wave(n, box))


def gaussian_filter(field: np.ndarray, box: float, k_cut: float) -> np.ndarray:
    """The field without structure beyond k_cut: times exp(-k**2 / (2 k_cut**2))."""
    n = len(field)
    return np.fft.irfftn(np.fft.rfftn(field) * np.exp(-_k2(n, box) / (2 * k_cut**2)), s=(n, n, n), axes=(0, 1, 2))


def laplacian(field: np.ndarray, box: float) -> np.ndarray:
    n = len(field)
    return np.fft.irfftn(-_k2(n, box) * np.fft.rfftn(field), s=(n, n, n), axes=(0, 1, 2))


def tidal_square(field: np.ndarray, box: float) -> np.ndarray:
    """Sum of the squares of (k_i k_j / k**2 - 1/3 on the diagonal) times the field, both orders of i and j."""
    n = len(field)
    k, k2, fk = _wave(n, box), _k2(n, box), np.fft.rfftn(field)
    fk[0, 0, 0] = 0
    k2[0, 0, 0] = 1
    out = np.zeros((n, n, n))
    for i, j in itertools.combinations_with_replacement(range(3), 2):
        s = np.fft.irfftn((k[i] * k[j] / k2 - (1 / 3 if i == j else 0)) * fk, s=(n, n, n), axes=(0, 1, 2))
        out += s**2 * (1 if i == j else 2)
    return out


def initial_fields(delta: np.ndarray, box: float, k_cut: float | None = None) -> dict[str, np.ndarray]:
    """delta, delta2, tidal2 without their means, and nabla2, of a linear density (filtered at k_cut if given)."""
    if k_cut is not None:
        delta = gaussian_filter(delta, box, k_cut)
    out = {"delta": delta, "delta2": delta**2, "tidal2": tidal_square(delta, box)}
    return {name: f - f.mean() for name, f in out.items()} | {"nabla2": laplacian(delta, box)}


def displaced_lattice(spark: SparkSession, n: int, box: float, displacement: DataFrame, growth: float, f_growth: float = 0.0) -> DataFrame:
    """ix, iy, iz and x, y, z of a lattice moved by growth times displacement (ix, iy, iz, dx, dy, dz), z also by the growth rate in redshift space."""
    d = {a: F.col(f"d{a}") * growth * ((1 + f_growth) if a == "z" else 1.0) for a in "xyz"}
    return displacement.select("ix", "iy", "iz", *[F.pmod(F.col(f"i{a}") * (box / n) + d[a], F.lit(box)).alias(a) for a in "xyz"])


def advected_spectra(lattice: DataFrame, weights: dict[str, DataFrame], n: int, box: float, growth: float, k_edges: np.ndarray, poles: tuple[int, ...] = (0, 2, 4), kind: str = "tsc") -> dict[tuple[str, str], dict]:
    """Spectra of all pairs of fields carried by the moved lattice: weights are cell tables (ix, iy, iz, value) at the lattice's start; '1cb' has weight 1.

    Each field is the deposit of its weights over the mean number of lattice points in a cell, to the growth power of the field.
    """
    ffts = {}
    for name in ["1cb", *weights]:
        if name == "1cb":
            cells = deposit(lattice, n, box, kind)
            mesh = dense(cells, n, "density", 0.0) - 1.0
        else:
            cells = deposit(lattice.join(weights[name], ["ix", "iy", "iz"]), n, box, kind, F.col("value"), decimals=18)
            mesh = dense(cells, n, "density", 0.0)
        w = compensation(n, kind, False)
        ffts[name] = np.fft.rfftn(mesh) / n**3 / (w[:, None, None] * w[None, :, None] * w[None, None, : n // 2 + 1])
    return pair_spectra(ffts, box, growth, k_edges, poles)


def pair_spectra(ffts: dict[str, np.ndarray], box: float, growth: float, k_edges: np.ndarray, poles: tuple[int, ...] = (0, 2, 4)) -> dict[tuple[str, str], dict]:
    """Binned cross spectra of all pairs (later field first), times the powers of growth that their fields take."""
    out, names = {}, list(ffts)
    n = len(next(iter(ffts.values())))
    for i, a in enumerate(names):
        for b in names[: i + 1]:
            p = (ffts[a] * ffts[b].conj()).real * box**3 * growth ** (GROWTH.get(a, 0) + GROWTH.get(b, 0))
            out[a, b] = bin_modes(p, n, box, k_edges, np.array([0.0, 1.0]), poles)
    return out


def linear_spectra(delta: np.ndarray, box: float, k_edges: np.ndarray, poles: tuple[int, ...] = (0, 2, 4)) -> dict[tuple[str, str], dict]:
    """The three spectra of a linear density and the same times mu**2."""
    n = len(delta)
    fk = np.fft.rfftn(delta) / n**3
    return pair_spectra({"delta": fk, "deltamu2": times_mu2(fk)}, box, 1.0, k_edges, poles)


def times_mu2(fk: np.ndarray) -> np.ndarray:
    n = len(fk)
    k, k2 = _wave(n, 1.0), _k2(n, 1.0)
    return fk * (k[2] ** 2 / np.where(k2 > 0, k2, 1))


def tracer_spectra(tracers: DataFrame, templates: dict[str, np.ndarray], n: int, box: float, growth: float, k_edges: np.ndarray, poles: tuple[int, ...] = (0, 2, 4), randoms: DataFrame | None = None, kind: str = "tsc") -> dict[tuple[str, str], dict]:
    """Spectra of tracers (positions around 0 are shifted by half a box) with themselves ('tr') and with the templates' transforms.

    With randoms, the tracers' field is their difference, as for reconstructed catalogs.
    """
    half = lambda d: d.select(*[F.pmod(F.col(a) + box / 2, F.lit(box)).alias(a) for a in "xyz"])
    tr = field_fft(half(tracers), n, box, kind)
    if randoms is not None:
        tr = tr - field_fft(half(randoms), n, box, kind)
    out = {("tr", "tr"): tr, **{(name, "tr"): f for name, f in templates.items()}}
    return {key: bin_modes((f * tr.conj()).real * box**3 * growth ** GROWTH.get(key[0], 0), n, box, k_edges, np.array([0.0, 1.0]), poles) for key, f in out.items()}


def default_edges(n: int, box: float, n_k: int) -> np.ndarray:
    return k_mu_edges(n, box, np.pi * n / box, n_k, 1, False)[0]
