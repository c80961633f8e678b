"""Subsamples by stored or counter-based uniform numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.math import uniform


def keep_probability(mass: Column, many_tracers: bool) -> Column:
    """Piecewise logistic in log10 mass."""
    x = F.log10(mass)
    if many_tracers:
        low = F.lit(0.2) / (1.0 + 10.0 * F.exp(-(x - 11.2) * 25.0))
        mid = F.lit(0.4) / (1.0 + 10.0 * F.exp(-(x - 11.3) * 25.0))
        return F.when(x < 11.4, low).when(x < 11.6, mid).otherwise(F.lit(1.0) / (1.0 + 0.1 * F.exp(-(x - 11.7) * 10.0)))
    return F.when(x > 13.0, 1.0).otherwise(F.lit(1.0) / (1.0 + 0.1 * F.exp(-(x - 11.8) * 10.0)))


def subsample_halos(halos: DataFrame, u: Column, many_tracers: bool) -> DataFrame:
    """Rows with u under their probability, with multiplicity 1 / p."""
    return halos.withColumn("_p", keep_probability(F.col("mass"), many_tracers)).where(u < F.col("_p")).withColumn("multi", 1.0 / F.col("_p")).drop("_p")


def particle_targets(mass: Column, n: Column, many_tracers: bool) -> Column:
    """How many particles of a halo stay."""
    x = F.log10(mass)
    if many_tracers:
        want = F.least(F.floor(1.0 + 1.5 * F.pow(F.lit(10.0), x - 12.5)), F.lit(100))
        return F.when(mass < 1e11, 0).otherwise(F.least(n, want.cast("long")))
    return F.when(mass < 1e12, 0).otherwise(F.least(n, F.floor(1.0 + 1.5 * F.pow(F.lit(10.0), x - 13.0)).cast("long")))


def sample_particles(particles: DataFrame, target: Column, order: Column, key: str = "id") -> DataFrame:
    """The first `target` particles of each halo in the order of a number."""
    w = W.partitionBy("halo_id").orderBy(order, key)
    return particles.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= target).drop("_n")


def random_shell(spark, n: int, r_min: float, r_max: float, seed: int, octant: bool = False) -> DataFrame:
    """id, x, y, z: n points uniform in a shell (or an octant of it), the same for any partitioning."""
    d = spark.range(n)
    r = F.pow(F.lit(r_min**3) + uniform(F.col("id"), seed) * F.lit(r_max**3 - r_min**3), F.lit(1 / 3))
    c = uniform(F.col("id"), seed + 1) if octant else uniform(F.col("id"), seed + 1) * 2 - 1
    phi = uniform(F.col("id"), seed + 2) * F.lit(1.5707963267948966 if octant else 6.283185307179586)
    s = F.sqrt(1 - c * c)
    return d.select("id", (r * s * F.cos(phi)).alias("x"), (r * s * F.sin(phi)).alias("y"), (r * c).alias("z"))


def in_box(lo: float, hi: float) -> Column:
    """lo < coordinate <= hi on three axes."""
    return F.expr(" and ".join(f"{a} > {lo} and {a} <= {hi}" for a in "xyz"))


def any_box(boxes: list[tuple[float, float]], offsets: list[tuple[float, float, float]]) -> Column:
    """Inside at least one of several boxes: (lo, hi), and where its origin lies."""
    out = F.lit(False)
    for (lo, hi), o in zip(boxes, offsets, strict=True):
        one = F.lit(True)
        for a, s in zip("xyz", o, strict=True):
            one = one & (F.col(a) - F.lit(s) > lo) & (F.col(a) - F.lit(s) <= hi)
        out = out | one
    return out


def cube_vertices(origin: tuple[float, float, float], units: float) -> list[tuple[float, float, float]]:
    """The eight corners of a cube with this lowest corner."""
    return [tuple(o + units * (i >> k & 1) for k, o in enumerate(origin)) for i in range(8)]


def thin(frames: list[DataFrame], key: str, parts: int, seed: int) -> DataFrame:
    """Union of particle tables, of which every parts-th row stays, by a hash of the key."""
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out.where(uniform(F.col(key), seed) < F.lit(1.0 / parts))
