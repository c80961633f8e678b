"""Deposits on meshes: few output rows per particle, one aggregate with map-side combination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _tsc(u: Column, n: int) -> Column:
    """Three (cell, weight) pairs of a coordinate in cells; the nearest cell is rounded half to even."""
    c = F.rint(u)
    d = u - c
    w = [F.lit(0.5) * (F.lit(0.5) - d) * (F.lit(0.5) - d), F.lit(0.75) - d * d, F.lit(0.5) * (F.lit(0.5) + d) * (F.lit(0.5) + d)]
    return F.array(*[F.struct(F.pmod(c.cast("int") + k - 1, F.lit(n)).alias("i"), w[k].alias("w")) for k in range(3)])


def _cic(u: Column, n: int) -> Column:
    c = F.floor(u)
    d = u - c
    return F.array(*[F.struct(F.pmod(c.cast("int") + k, F.lit(n)).alias("i"), w.alias("w")) for k, w in enumerate((F.lit(1.0) - d, d))])


def deposit(points: DataFrame, n: int, box: float, kind: str = "tsc", weight: Column | None = None, offset: float = 0.0, axes: str = "xyz", decimals: int = 12) -> DataFrame:
    """Cell table (ix, iy[, iz], density) of points; kind tsc or cic.

    Weights are summed as decimals, so that the sum does not depend on the order of rows; without a weight, where no product
    exceeds 1, as whole numbers of 2**-40 in two halves that no number of points overflows.
    """
    assign = _tsc if kind == "tsc" else _cic
    per_axis = {f"_{a}": assign((F.col(a) + F.lit(offset)) * F.lit(n / box), n) for a in axes}
    d = points.select((F.lit(1.0) if weight is None else weight.cast("double")).alias("_w"), *[x.alias(c) for c, x in per_axis.items()])
    # One row for each cell that a point reaches, from one generator: the product of the axes' weights.
    number = "cast({w} * 1099511627776D + 0.5D as bigint)" if weight is None else "cast({w} as decimal(28,%d))" % decimals
    if axes == "xyz":
        cells = f"flatten(transform(_x, p -> flatten(transform(_y, q -> transform(_z, r -> named_struct('ix', p.i, 'iy', q.i, 'iz', r.i, 'w', {number.format(w='_w * p.w * q.w * r.w')}))))))"
    else:
        a, b = axes
        cells = f"flatten(transform(_{a}, p -> transform(_{b}, q -> named_struct('i{a}', p.i, 'i{b}', q.i, 'w', {number.format(w='_w * p.w * q.w')}))))"
    d = d.select(F.inline(F.expr(cells))).where("w <> 0").groupBy(*[f"i{a}" for a in axes])
    if weight is not None:
        return d.agg(F.sum("w").cast("double").alias("density"))
    return d.agg((F.sum(F.shiftright("w", 20)) / F.lit(2.0**20) + F.sum(F.col("w").bitwiseAND((1 << 20) - 1)) / F.lit(2.0**40)).alias("density"))


def overdensity(field: DataFrame, n_cells: int) -> DataFrame:
    """density * cells / total - 1 for the cells that hold something; the others are -1."""
    total = field.agg(F.sum("density").alias("_total"))
    return field.crossJoin(F.broadcast(total)).withColumn("delta", F.col("density") * n_cells / F.col("_total") - 1).drop("_total")


def partition_starts(points: DataFrame, n_parts: int, box: float, axis: str = "x") -> DataFrame:
    """part, n, start: rows in each slab of an axis and how many come before."""
    from pyspark.sql import Window as W

    part = F.least(F.floor(F.col(axis) * n_parts / box).cast("int"), F.lit(n_parts - 1))
    c = points.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    every = points.sparkSession.range(n_parts).select(F.col("id").cast("int").alias("part")).join(c, "part", "left").fillna(0, "n")
    return every.withColumn("start", F.sum("n").over(W.orderBy("part")) - F.col("n"))  # as many rows as slabs


def partitioned(points: DataFrame, n_parts: int, box: float, order: list[str], axis: str = "x") -> DataFrame:
    """points with part, their slab of an axis, and place, their number in the table sorted by slab and then by `order`.

    The rows of a slab stand from its start (partition_starts) on; order must be unique for a defined result.
    """
    from .ranks import ordered_index

    part = F.least(F.floor(F.col(axis) * n_parts / box).cast("int"), F.lit(n_parts - 1))
    return ordered_index(points.withColumn("part", part), ["part", *order], out="place")


def pixel_counts(pixels: DataFrame, pixel: str = "pixel") -> DataFrame:
    return pixels.groupBy(F.col(pixel).alias("pixel")).agg(F.count("*").alias("n"))


def degrade(counts: DataFrame, levels: int) -> DataFrame:
    """Sum of nested pixels, 4**levels to one."""
    return counts.groupBy(F.shiftright("pixel", 2 * levels).alias("pixel")).agg(F.sum("n").alias("n"))
