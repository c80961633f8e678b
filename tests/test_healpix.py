"""Pixels against the centres of all pixels and the hierarchy of the nested order; bins against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from halogrid.functions.healpix import nested_pixel, ring_pixel
from halogrid.operators import ranks


def ring_centres(n):
    """(z, longitude) of each pixel's centre in ring order, ring by ring."""
    out = []
    for i in range(1, 4 * n):
        if i < n or i > 3 * n:
            j = min(i, 4 * n - i)
            z = 1 - j * j / (3 * n * n)
            out += [(z if i < n else -z, math.pi / (2 * j) * (k + 0.5)) for k in range(4 * j)]
        else:
            out += [(4 / 3 - 2 * i / (3 * n), math.pi / (2 * n) * (k + ((i - n + 1) % 2) / 2)) for k in range(4 * n)]
    return out


def vectors(spark, zp):
    rows = [(i, math.sqrt(1 - z * z) * math.cos(p) * 7, math.sqrt(1 - z * z) * math.sin(p) * 7, z * 7) for i, (z, p) in enumerate(zp)]
    return spark.createDataFrame(rows, "i int, x double, y double, z double")


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8])
def test_centres(spark, n):
    df = vectors(spark, ring_centres(n))
    xyz = [F.col(c) for c in "xyz"]
    assert [r[1] for r in sorted(df.select("i", ring_pixel(*xyz, n)).collect())] == list(range(12 * n * n))
    if n & (n - 1) == 0:
        assert sorted(r[0] for r in df.select(nested_pixel(*xyz, n)).collect()) == list(range(12 * n * n))


def test_hierarchy_and_area(spark):
    g = np.random.default_rng(3)
    v = g.normal(size=(20_000, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in v], "x double, y double, z double")
    xyz = [F.col(c) for c in "xyz"]
    df = df.select(*[nested_pixel(*xyz, n).alias(f"n{n}") for n in (1, 2, 4, 8, 1 << 20)], ring_pixel(*xyz, 4).alias("r4"))
    assert df.where("n8 >> 2 <> n4 or n4 >> 2 <> n2 or n2 >> 2 <> n1 or n1048576 >> 34 <> n8").count() == 0
    # Ring and nested order name the same pixels.
    pairs = df.select("n4", "r4").distinct().collect()
    assert len(pairs) == 192 == len({r.n4 for r in pairs}) == len({r.r4 for r in pairs})
    counts = [r["count"] for r in df.groupBy("n4").count().collect()]
    assert abs(np.mean(counts) - 20_000 / 192) < 1 and max(counts) < 170 and min(counts) > 55


def test_edges_of_the_sphere(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0), (0.0, 0.0, -1.0), (0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (1.0, -1e-300, 0.0), (None, 0.0, 1.0)], "x double, y double, z double")
    got = df.select(ring_pixel(F.col("x"), F.col("y"), F.col("z"), 4), nested_pixel(F.col("x"), F.col("y"), F.col("z"), 4)).collect()
    assert all(0 <= v < 192 for r in got[:5] for v in r) and got[0] == got[2] and got[3] == got[4]
    with pytest.raises(ValueError):
        nested_pixel(F.col("x"), F.col("y"), F.col("z"), 3)


@pytest.mark.parametrize("n", [2, 5, 64, 65, 10_000])
def test_searchsorted(spark, n):
    g = np.random.default_rng(n)
    edges = sorted(set(g.integers(0, 5 * n, n).astype(float)))
    x = [*g.uniform(-1, 5 * n + 1, 100), *g.choice(edges, 20), edges[0], edges[-1], float("nan")]
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for side in ("left", "right"):
        assert [r[0] for r in df.select(ranks.searchsorted(F.col("x"), edges, side)).collect()] == list(np.searchsorted(edges, x, side))
    assert spark.sql("SELECT CAST(NULL AS double) x").select(ranks.searchsorted(F.col("x"), edges)).first()[0] is None


@pytest.mark.parametrize("n", [4, 100])
def test_bin_rules(spark, n):
    edges = [float(v) for v in range(n)]
    x = [-0.5, 0.0, 0.5, 1.0, 1.5, 2.0, n - 1.5, n - 1.0, n + 1.0, float("nan"), None]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    got = [list(r) for r in zip(*df.select(*[ranks.bin_index(F.col("x"), edges, rule) for rule in ("open", "left", "half", "right")]).collect(), strict=True)]
    assert got == [
        [None, None, 0, None, 1, None, n - 2, None, None, None, None],
        [None, 0, 0, 1, 1, 2, n - 2, n - 2, None, None, None],
        [None, 0, 0, 1, 1, 2, n - 2, None, None, None, None],
        [None, 0, 0, 0, 1, 1, n - 2, None, None, None, None],
    ]
