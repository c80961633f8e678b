"""Fourier transform of a mesh whose cells are rows, plane by plane: no process holds more than one plane.

A first pass groups cells by ix and transforms each plane along z and y; a second groups the lines by iy and transforms
along x.  What comes out are lines, a row for each (ix, iy) with the half axis of iz in two arrays, which become modes,
rows of their own, where they are needed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LINE = "ix int, iy int, re array<double>, im array<double>"


def _lines(ix, iy, f: np.ndarray) -> pa.Table:
    parts = (pa.array(list(np.ascontiguousarray(x)), pa.list_(pa.float64())) for x in (f.real, f.imag))
    return pa.table([pa.array(ix, pa.int32()), pa.array(iy, pa.int32()), *parts], names=["ix", "iy", "re", "im"])


def _complex(t: pa.Table) -> np.ndarray:
    re, im = (t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1) for c in ("re", "im"))
    return re + 1j * im


def _planes(n: int, empty: float) -> Callable:
    def run(t: pa.Table) -> pa.Table:
        plane = np.full((n, n), empty)
        plane[t.column("iy").to_numpy(), t.column("iz").to_numpy()] = t.column("value").to_numpy()
        return _lines([t.column("ix")[0].as_py()] * n, range(n), np.fft.fft(np.fft.rfft(plane, axis=1), axis=0))

    return run


def _across(n: int, empty: float) -> Callable:
    def run(t: pa.Table) -> pa.Table:
        iy = t.column("iy")[0].as_py()
        f = np.zeros((n, n // 2 + 1), np.complex128)
        if iy == 0:
            f[:, 0] = empty * n * n  # what planes without a cell come to
        f[t.column("ix").to_numpy()] = _complex(t)
        return _lines(range(n), [iy] * n, np.fft.fft(f, axis=0) / n**3)

    return run


def fourier_lines(cells: DataFrame, n: int, value: str, empty: float = 0.0) -> DataFrame:
    """ix, iy, re, im: the transform, over n**3, of a mesh of n cells a side; cells that have no row hold `empty`.

    cells: one row for each ix, iy, iz, and the value.  A table without rows has no lines.  A task holds planes of n * n values.
    """
    c = cells.select(*[F.col(a).cast("int").alias(a) for a in ("ix", "iy", "iz")], F.col(value).cast("double").alias("value"))
    return c.groupBy("ix").applyInArrow(_planes(n, empty), _LINE).groupBy("iy").applyInArrow(_across(n, empty), _LINE)


def real_cells(lines: DataFrame, n: int, value: str) -> DataFrame:
    """ix, iy, iz, value of all cells of the mesh whose transform the lines (ix, iy, re, im) hold."""

    def back(t: pa.Table) -> pa.Table:
        f = np.zeros((n, n // 2 + 1), np.complex128)
        f[t.column("ix").to_numpy()] = _complex(t)
        return _lines(range(n), [t.column("iy")[0].as_py()] * n, np.fft.ifft(f, axis=0) * n)

    def plane(t: pa.Table) -> pa.Table:
        f = np.zeros((n, n // 2 + 1), np.complex128)
        f[t.column("iy").to_numpy()] = _complex(t)
        v = np.fft.irfft(np.fft.ifft(f, axis=0) * n, n, axis=1) * n
        return pa.table([pa.array([t.column("ix")[0].as_py()] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(list(v), pa.list_(pa.float64()))], names=["ix", "iy", "v"])

    planes = lines.groupBy("iy").applyInArrow(back, _LINE).groupBy("ix").applyInArrow(plane, "ix int, iy int, v array<double>")
    return planes.select("ix", "iy", F.posexplode("v").alias("iz", value))


def modes(lines: DataFrame, n: int, arrays: tuple[str, ...] = ("re", "im")) -> DataFrame:
    """ix, iy, iz, w (modes that a row stands for), p2 and i2 (squared indices across the line of sight and in all) and the arrays' values, a row for each mode."""
    zipped = F.posexplode(F.arrays_zip(*arrays)).alias("iz", "_v")
    a, b = (F.when(F.col(c) < n // 2, F.col(c)).otherwise(F.col(c) - n) for c in ("ix", "iy"))
    d = lines.select("ix", "iy", zipped).select("ix", "iy", "iz", F.when(F.col("iz") == 0, F.lit(1)).otherwise(F.lit(2)).alias("w"), (a * a + b * b).cast("long").alias("p2"), *[F.col(f"_v.{c}").alias(c) for c in arrays])
    return d.withColumn("i2", F.col("p2") + F.col("iz") * F.col("iz"))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Lines of two meshes side by side: re, im, re2, im2."""
    return a.join(b.select("ix", "iy", F.col("re").alias("re2"), F.col("im").alias("im2")), ["ix", "iy"])


def divided(df: DataFrame, names: tuple[str, ...], window: np.ndarray) -> DataFrame:
    """Values of modes over the product of a window's entries for their three indices."""
    w = F.lit([float(x) for x in window])
    at = F.get(w, F.col("ix")) * F.get(w, F.col("iy")) * F.get(w, F.col("iz"))
    return df.withColumns({c: F.col(c) / at for c in names})


def interlaced(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """Modes (re, im) of the mean of a mesh and of one whose points were moved by half a cell on each axis."""
    d = modes(paired(a, b), n, ("re", "im", "re2", "im2"))
    signed = [F.when(F.col(c) < (n + 1) // 2, F.col(c)).otherwise(F.col(c) - n) for c in ("ix", "iy")]
    phase = (signed[0] + signed[1] + F.col("iz")) * F.lit(np.pi / n)
    re, im = F.col("re2") * F.cos(phase) - F.col("im2") * F.sin(phase), F.col("re2") * F.sin(phase) + F.col("im2") * F.cos(phase)
    return d.withColumns({"re": (F.col("re") + re) / 2, "im": (F.col("im") + im) / 2}).drop("re2", "im2")


def product(re: str = "re", im: str = "im", re2: str = "re2", im2: str = "im2") -> Column:
    """Real part of a mode times the conjugate of another."""
    return F.col(re) * F.col(re2) + F.col(im) * F.col(im2)
