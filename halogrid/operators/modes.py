"""Wave modes of a mesh as rows: bins, pole expansion and mode coupling as joins and aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.math import legendre
from .ranks import bin_index


def mode_table(spark: SparkSession, n: int) -> DataFrame:
    """ix, iy, iz of the half mesh of a real field, w (modes that a row stands for), p2 (squared index across the line of sight) and i2 (squared index)."""
    half = n // 2 + 1
    d = spark.range(n * n * half).select(F.floor(F.col("id") / (n * half)).cast("int").alias("ix"), F.floor(F.col("id") / half % n).cast("int").alias("iy"), (F.col("id") % half).cast("int").alias("iz"))
    a, b = (F.when(F.col(c) < n // 2, F.col(c)).otherwise(F.col(c) - n) for c in ("ix", "iy"))
    d = d.withColumn("w", F.when(F.col("iz") == 0, F.lit(1)).otherwise(F.lit(2))).withColumn("p2", a * a + b * b)
    return d.withColumn("i2", F.col("p2") + F.col("iz") * F.col("iz"))


def mu2() -> Column:
    """Squared cosine with the line of sight; 0 at the origin."""
    return F.when(F.col("i2") > 0, F.col("iz") * F.col("iz") / F.col("i2")).otherwise(F.lit(0.0))


def _squares(edges: list[float], step: float) -> list[float]:
    return [(e / step) ** 2 for e in edges]


def _means(binned: DataFrame, keys: list[str], value: str, **more: Column) -> DataFrame:
    n = F.sum("w")
    return binned.groupBy(*keys).agg(n.cast("long").alias("n_modes"), (F.sum(F.col("w") * F.col(value)) / n).alias("mean"), *[(F.sum(F.col("w") * x) / n).alias(c) for c, x in more.items()])


def bin_k(modes: DataFrame, step: float, k_edges: list[float]) -> DataFrame:
    """modes inside the k edges, with their k_bin: open below and closed above, the first closed; nothing at or over the last edge."""
    return modes.withColumn("k_bin", bin_index(F.col("i2").cast("double"), _squares(k_edges, step), "right")).where("k_bin is not null")


def bin_k_mu(modes: DataFrame, value: str, step: float, k_edges: list[float], mu_edges: list[float], **more: Column) -> DataFrame:
    """k_bin, mu_bin, n_modes, mean, k_avg and the means of more of the bins that have modes; step is the width of a mode.

    Bins are open below and closed above, the first closed; nothing at or over the last k edge.
    """
    m = F.least(F.coalesce(bin_index(mu2(), [e * e for e in mu_edges], "right"), F.lit(len(mu_edges) - 2)), F.lit(len(mu_edges) - 2))
    d = bin_k(modes, step, k_edges).withColumn("mu_bin", m)
    return _means(d, ["k_bin", "mu_bin"], value, k_avg=F.sqrt("i2") * step, **more)


def bin_k_pi(modes: DataFrame, value: str, step: float, k_edges: list[float], pi_max: float, n_pi: int) -> DataFrame:
    """k_bin (across the line of sight), pi_bin (along it, n_pi of them up to pi_max), n_modes, mean of the bins that have modes."""
    k = bin_index(F.col("p2").cast("double"), _squares(k_edges, step), "right")
    p = bin_index((F.col("iz") * F.col("iz")).cast("double"), _squares([pi_max * i / n_pi for i in range(n_pi + 1)], step), "right")
    d = modes.withColumn("k_bin", k).withColumn("pi_bin", p).where("k_bin is not null and pi_bin is not null")
    return _means(d, ["k_bin", "pi_bin"], value)


def linear_interp(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Value at x of a table with equal steps; the ends' values beyond it."""
    if abs((xs[1] - xs[0]) - (xs[-1] - xs[-2])) > 1e-6:
        raise ValueError("the table's steps are not equal")
    f = (x - xs[0]) / (xs[1] - xs[0])
    i = F.floor(f).cast("int")
    table = F.array(*[F.lit(float(y)) for y in ys])
    low, high = F.get(table, i), F.get(table, i + 1)
    return F.when(x <= xs[0], F.lit(float(ys[0]))).when(x >= xs[-1], F.lit(float(ys[-1]))).otherwise(low + (f - i) * (high - low))


def expand_poles(modes: DataFrame, step: float, k: list[float], poles: dict[int, list[float]], out: str = "power") -> DataFrame:
    """Sum over the poles of their value at a mode's k times the Legendre polynomial of its mu."""
    total = F.lit(0.0)
    for ell, p in poles.items():
        total = total + linear_interp(F.sqrt(F.col("i2").cast("double")) * step, k, p) * (legendre(mu2(), ell) if ell else F.lit(1.0))
    return modes.withColumn(out, total)


def delta_mu2(modes: DataFrame, *values: str) -> DataFrame:
    """Values (say, the real and imaginary parts of a field) times mu squared."""
    return modes.withColumns({v: F.col(v) * mu2() for v in values})


def smoothing(step: float, radius: float) -> Column:
    """Gaussian window exp(-k**2 radius**2 / 2)."""
    return F.exp(-F.col("i2") * F.lit(step * step * radius * radius / 2))


def window_matrix(spark: SparkSession, n: int, box: float, k_out: list[float], k_in: list[float], k2_weight: bool = True) -> DataFrame:
    """l, k_bin, lp, i_in, window and k_eff of the mode coupling of a periodic box: what multipole lp at k_in[i_in] adds to multipole l in a bin.

    Legendre products are summed over the modes of an output bin (closed below, open above) and divided by their number
    and by the sum of the weights of the bin's inputs, k**2 dk, or 1 without k2_weight.
    """
    step = 2 * math.pi / box
    modes = mode_table(spark, n).where(f"iz < {n // 2}")
    knorm = F.sqrt(F.col("i2").cast("double")) * step
    modes = modes.withColumn("k_bin", bin_index(knorm, k_out, "left")).where(F.col("k_bin").isNotNull() & (knorm < k_out[-1]))
    legs = {ell: F.lit(1.0) if ell == 0 else legendre(mu2(), ell) for ell in (0, 2, 4)}
    sums = [(F.sum(F.col("w") * (2 * a + 1) * legs[a] * legs[b]) / F.sum("w")).alias(f"s_{a}_{b}") for a in legs for b in legs]
    d = modes.groupBy("k_bin").agg((F.sum(F.col("w") * knorm) / F.sum("w")).alias("k_eff"), *sums)
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("l"), F.lit(b).alias("lp"), F.col(f"s_{a}_{b}").alias("s")) for a in legs for b in legs]))
    d = d.select("k_bin", "k_eff", pairs.alias("e")).select("k_bin", "k_eff", "e.*")
    widths = [b - a for a, b in zip(k_in, k_in[1:])]
    widths.append(widths[-1])
    rows = [(i, float(k), float(k * k * dk) if k2_weight else 1.0) for i, (k, dk) in enumerate(zip(k_in, widths))]
    inputs = spark.createDataFrame(rows, "i_in int, k double, weight double").withColumn("k_bin", bin_index(F.col("k"), k_out, "left")).where(F.col("k_bin").isNotNull() & (F.col("k") < k_out[-1]))
    norm = inputs.groupBy("k_bin").agg(F.sum("weight").alias("norm"))
    inputs = inputs.join(norm, "k_bin").select("k_bin", "i_in", (F.col("weight") / F.col("norm")).alias("share"))
    return d.join(inputs, "k_bin").select("l", "k_bin", "lp", "i_in", (F.col("s") * F.col("share")).alias("window"), "k_eff")
