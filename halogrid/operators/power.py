"""Power spectra over transformed meshes; fields that need whole meshes in one process are numpy on the cells that Spark sums."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.math import legendre
from . import transform
from .mesh import deposit, overdensity


def dense(cells: DataFrame, n: int, value: str, fill: float, dtype=np.float64) -> np.ndarray:
    """The mesh of a cell table: at most n**3 cells, a size that the caller has chosen, in Arrow batches."""
    out = np.full((n, n, n), fill, dtype)
    t = cells.select("ix", "iy", "iz", value).toArrow()
    out[t.column(0).to_numpy(), t.column(1).to_numpy(), t.column(2).to_numpy()] = t.column(3).to_numpy()
    return out


def k_mu_edges(n: int, box: float, k_max: float, n_k: int, n_mu: int, log: bool) -> tuple[np.ndarray, np.ndarray]:
    k = np.geomspace((1 - 1e-4) * 2 * math.pi / box, k_max, n_k + 1) if log else np.linspace(0, k_max, n_k + 1)
    return k, np.linspace(0, 1, n_mu + 1)


def compensation(n: int, kind: str, interlaced: bool) -> np.ndarray:
    """Deconvolution of the assignment window along one axis of wave numbers."""
    x = np.pi * np.fft.fftfreq(n)
    p = 3 if kind == "tsc" else 2
    if interlaced:
        return np.sinc(x / np.pi) ** p
    s = np.sin(x) ** 2
    return np.sqrt(1 - s + 2 / 15 * s**2) if p == 3 else np.sqrt(1 - 2 / 3 * s)


def field_fft(points: DataFrame, n: int, box: float, kind: str = "tsc", compensated: bool = True, interlaced: bool = False, weight=None) -> np.ndarray:
    def one(offset: float) -> np.ndarray:
        cells = overdensity(deposit(points, n, box, kind, weight, offset), n**3)
        return np.fft.rfftn(dense(cells, n, "delta", -1.0)) / n**3

    f = one(0.0)
    if interlaced:
        k = 2 * np.pi * np.fft.fftfreq(n, 1 / n) / n
        kz = 2 * np.pi * np.arange(n // 2 + 1) / n
        phase = np.exp(0.5j * (k[:, None, None] + k[None, :, None] + kz[None, None, :]))
        f = 0.5 * (f + one(0.5 * box / n) * phase)
    if compensated:
        w = compensation(n, kind, interlaced)
        wz = w[: n // 2 + 1]
        f = f / (w[:, None, None] * w[None, :, None] * wz[None, None, :])
    return f


def bin_modes(power: np.ndarray, n: int, box: float, k_edges: np.ndarray, mu_edges: np.ndarray, poles: tuple[int, ...] = (), fourier: bool = True) -> dict[str, np.ndarray]:
    """Means over (k, mu) bins of a half mesh: bins are open below and closed above, the first closed, nothing at or over the last edge.

    Modes off the plane kz = 0 count twice.  poles: Legendre-weighted means over k bins.
    """
    step = 2 * np.pi / box if fourier else box / n
    m = np.fft.fftfreq(n, 1 / n)
    i2 = m[:, None, None] ** 2 + m[None, :, None] ** 2 + np.arange(n // 2 + 1)[None, None, :] ** 2
    twice = np.where(np.arange(n // 2 + 1) == 0, 1.0, 2.0) * np.ones_like(i2)
    mu2 = np.arange(n // 2 + 1)[None, None, :] ** 2 / np.where(i2 > 0, i2, 1)
    ke2 = (k_edges / step) ** 2
    kb = np.searchsorted(ke2, i2, "left") - 1
    kb[i2 == ke2[0]] = 0
    ok = (i2 >= ke2[0]) & (i2 < ke2[-1])
    mb = np.maximum(np.searchsorted(mu_edges**2, mu2, "left") - 1, 0)
    nk, nm = len(k_edges) - 1, len(mu_edges) - 1
    at = (kb * nm + np.minimum(mb, nm - 1))[ok]
    w = twice[ok]
    total = lambda x, key=at, size=nk * nm: np.bincount(key, x, size)
    count = total(w)
    safe = np.where(count > 0, count, np.nan)
    out = {"n_modes": count.reshape(nk, nm), "power": (total(w * power[ok]) / safe).reshape(nk, nm), "k_avg": (total(w * np.sqrt(i2[ok]) * step) / safe).reshape(nk, nm)}
    if poles:
        kk = kb[ok]
        n_k = np.bincount(kk, w, nk)
        mu = np.sqrt(mu2[ok])
        out["poles"] = np.stack([(2 * p + 1) * np.bincount(kk, w * power[ok] * np.polynomial.legendre.Legendre.basis(p)(mu), nk) / np.where(n_k > 0, n_k, np.nan) for p in poles])
        out["n_modes_poles"] = n_k
    return out


def field_modes(points: DataFrame, n: int, box: float, kind: str = "tsc", compensated: bool = True, interlaced: bool = False, weight=None) -> DataFrame:
    """Modes (transform.modes) of the overdensity of points, as rows: field_fft() without a mesh in one process."""

    def one(offset: float) -> DataFrame:
        return transform.fourier_lines(overdensity(deposit(points, n, box, kind, weight, offset), n**3), n, "delta", -1.0)

    m = transform.interlaced(one(0.0), one(0.5 * box / n), n) if interlaced else transform.modes(one(0.0), n)
    return transform.divided(m, ("re", "im"), compensation(n, kind, interlaced)) if compensated else m


def binned_spectrum(modes: DataFrame, value: str, n: int, box: float, k: np.ndarray, mu: np.ndarray, poles: tuple[int, ...]) -> DataFrame:
    """k_bin, mu_bin, k_mid, k_avg, power, n_modes, pole_<l> of every bin; a bin without modes has no means."""
    from .modes import bin_k_mu, mu2

    step = 2 * math.pi / box
    legs = {p: F.lit(1.0) if p == 0 else legendre(mu2(), p) for p in poles}
    sums = {f"_pole_{p}": F.col(value) * (2 * p + 1) * leg for p, leg in legs.items()}
    found = bin_k_mu(modes, value, step, list(map(float, k)), list(map(float, mu)), **sums)  # the modes are read once
    every = modes.sparkSession.range((len(k) - 1) * (len(mu) - 1)).select((F.col("id") / (len(mu) - 1)).cast("int").alias("k_bin"), (F.col("id") % (len(mu) - 1)).cast("int").alias("mu_bin"))
    mids = F.lit([float(a + b) / 2 for a, b in zip(k, k[1:])])
    out = every.join(found.withColumnRenamed("mean", "power"), ["k_bin", "mu_bin"], "left")
    of_k = W.partitionBy("k_bin")  # a row for each mu bin
    means = [(F.sum(F.col("n_modes") * F.col(f"_pole_{p}")).over(of_k) / F.sum("n_modes").over(of_k)).alias(f"pole_{p}") for p in poles]
    return out.select("k_bin", "mu_bin", F.get(mids, F.col("k_bin")).alias("k_mid"), "k_avg", "power", F.coalesce("n_modes", F.lit(0).cast("long")).alias("n_modes"), *means)


def power_spectrum(points: DataFrame, box: float, n: int, n_k: int, n_mu: int = 1, k_max: float | None = None, log: bool = False, poles: tuple[int, ...] = (0, 2, 4), kind: str = "tsc", compensated: bool = True, interlaced: bool = False, other: DataFrame | None = None, weight=None) -> DataFrame:
    """k_bin, mu_bin, k_mid, k_avg, power, n_modes, pole_<l>: auto or, with other, cross spectrum, all of it as a plan over cells, lines and modes."""
    k, mu = k_mu_edges(n, box, k_max or math.pi * n / box, n_k, n_mu, log)
    f = field_modes(points, n, box, kind, compensated, interlaced, weight)
    if other is None:
        m = f.withColumn("p", transform.product(re2="re", im2="im") * box**3)
    else:
        g = field_modes(other, n, box, kind, compensated, interlaced, weight).select("ix", "iy", "iz", F.col("re").alias("re2"), F.col("im").alias("im2"))
        m = f.join(g, ["ix", "iy", "iz"]).withColumn("p", transform.product() * box**3)
    return binned_spectrum(m, "p", n, box, k, mu, poles)


def xi_from_power(power: np.ndarray, n: int, box: float, edges: np.ndarray, poles: tuple[int, ...] = (0, 2)) -> dict[str, np.ndarray]:
    """Correlation function in bins of separation from a half mesh of power."""
    xi = np.fft.irfftn(power, s=(n, n, n), axes=(0, 1, 2)) * n**3 / box**3
    half = xi[:, :, : n // 2 + 1]
    return bin_modes(half, n, box, edges, np.array([0.0, 1.0]), poles, fourier=False)


def smooth_density(field: np.ndarray, radius: float, box: float) -> np.ndarray:
    """Gaussian filter in real space, axis by axis, cut at four deviations; the mesh is mirrored at its faces, not periodic."""
    n = len(field)
    sigma = radius * n / box
    reach = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    at = (np.arange(n)[:, None] + np.arange(-reach, reach + 1)[None, :]) % (2 * n)
    mirror = np.zeros((n, n))
    np.add.at(mirror, (np.repeat(np.arange(n), len(w)), np.minimum(at, 2 * n - 1 - at).ravel()), np.tile(w / w.sum(), n))
    return np.einsum("ai,bj,ck,ijk->abc", mirror, mirror, mirror, field, optimize=True)


def tidal_field(fk: np.ndarray, box: float, radius: float | None = None) -> dict[tuple[int, int], np.ndarray]:
    """k_i k_j / k**2 of a field's half mesh, with a top-hat window of k**2 radius if given; modes with a zero component are left out."""
    n = len(fk)
    step = 2 * np.pi / box
    m = np.fft.fftfreq(n, 1 / n) * step
    k = (m[:, None, None], m[None, :, None], (np.arange(n // 2 + 1) * step)[None, None, :])
    k2 = k[0] ** 2 + k[1] ** 2 + k[2] ** 2
    inside = (k[0] * k[1] * k[2]) != 0
    x = np.where(inside, fk, 0) / np.where(k2 > 0, k2, 1)
    if radius is not None:
        y = k2 * radius
        x = x * np.where(y > 0, 3 * (np.sin(y) - y * np.cos(y)) / np.where(y > 0, y, 1) ** 3, 1.0)
    return {(i, j): x * k[i] * k[j] for i in range(3) for j in range(i, 3)}


def shear(tidal: dict[tuple[int, int], np.ndarray], n: int) -> np.ndarray:
    """Root of half the sum of the squared differences of the tensor's eigenvalues, in each cell: 3 tr(T**2) - (tr T)**2, without eigenvalues."""
    t = {key: np.fft.irfftn(x, s=(n, n, n), axes=(0, 1, 2)) for key, x in tidal.items()}
    apart = (t[0, 0] - t[1, 1]) ** 2 + (t[1, 1] - t[2, 2]) ** 2 + (t[2, 2] - t[0, 0]) ** 2
    return np.sqrt(np.maximum(0.5 * apart + 3 * (t[0, 1] ** 2 + t[0, 2] ** 2 + t[1, 2] ** 2), 0))


def tidal_shear(points: DataFrame, n: int, box: float, radius: float) -> np.ndarray:
    """Shear of the smoothed tidal field of points on the mesh."""
    cells = overdensity(deposit(points, n, box, "tsc"), n**3)
    field = smooth_density(dense(cells, n, "delta", -1.0), radius, box)
    return shear(tidal_field(np.fft.rfftn(field), box), n)


def cells_frame(spark: SparkSession, mesh: np.ndarray, name: str) -> DataFrame:
    """A mesh as a cell table (ix, iy, iz, name)."""
    import pyarrow as pa

    n = mesh.shape
    i = np.indices(n).reshape(3, -1).astype(np.int32)
    return spark.createDataFrame(pa.table({"ix": i[0], "iy": i[1], "iz": i[2], name: mesh.reshape(-1).astype(np.float64)}))
