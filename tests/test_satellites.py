"""Numbers of satellites with large means."""

import numpy as np
from pyspark.sql import functions as F

from halogrid.operators import hod, neighbors
from halogrid.plans.mocks import Mocks


def test_large_means_are_not_cut(spark):
    t = hod.Tracer(12.0, 12.0, 0.3, 1.0, 0.0, ic=1.0)
    for mean in (30.0, 450.0):
        h = spark.range(400).select("id", *[F.lit(1.0).alias(c) for c in "x y z vx vy vz r98 sigma_v".split()], F.lit(5.0).alias("conc"), F.lit(mean * 1e12).alias("mass"))
        n = [r["count"] for r in hod.nfw_satellites(h, "QSO", t, 100.0, 7).groupBy("id").count().collect()]
        assert len(n) == 400 and abs(np.mean(n) - mean) < 5 * (mean / 400) ** 0.5 and 0.7 < np.var(n) / mean < 1.35


def rows(spark, n, mass=2e13, x=50.0):
    return spark.range(n).select("id", *[F.lit(x).alias(a) for a in "xyz"], *[F.lit(0.0).alias(f"v{a}") for a in "xyz"], F.lit(1.0).alias("r98"), F.lit(100.0).alias("sigma_v"), F.lit(5.0).alias("conc"), F.lit(mass).alias("mass"))


def test_profiles(spark):
    t = hod.Tracer(12.0, 12.0, 0.3, 1.0, 0.0, ic=1.0)

    def drawn(**profile):
        s = hod.nfw_satellites(rows(spark, 300), "QSO", t, 100.0, 3, **profile)
        got = np.array([(r.r, r.vx) for r in s.select(F.sqrt(F.expr("(x-50)*(x-50) + (y-50)*(y-50) + (z-50)*(z-50)")).alias("r"), "vx").collect()])
        return got[:, 0] * 5.0, got[:, 1]  # in scale radii

    nfw, v = drawn()
    wide, _ = drawn(nfw_rescale=1.5)
    tail, _ = drawn(exp_frac=1.0, exp_scale=2.0)
    mixed, fast = drawn(exp_frac=0.25, exp_scale=2.0, f_sigv=2.0)
    assert nfw.max() <= 5.0 and len(nfw) == len(wide) == len(tail) == len(mixed)
    np.testing.assert_allclose(np.sort(wide), np.sort(nfw) * 1.5, rtol=1e-9)
    # Mean and deviation of an exponential are its scale; a quarter of the mixture is exponential.
    assert abs(tail.mean() - 2.0) < 5 * 2.0 / len(tail) ** 0.5 and abs(tail.std() - 2.0) < 0.2 and tail.max() > 5.0
    assert abs(mixed.mean() - (0.75 * nfw.mean() + 0.25 * 2.0)) < 5 * 1.5 / len(mixed) ** 0.5
    assert abs(v.std() / 57.7 - 1) < 0.05 and abs(fast.std() / 115.4 - 1) < 0.05


def test_satellites_on_profiles_know_their_central(spark):
    t = hod.Tracer(12.0, 13.0, 0.3, 1.0, 0.0, beside={"LRG": (12.0, 1.0), "ELG": (11.5, 1.0)})
    h = rows(spark, 600).withColumn("central", F.expr("case id % 3 when 0 then 'LRG' when 1 then 'ELG' end"))
    n = {r.k: r["count"] / 200 for r in hod.nfw_satellites(h, "ELG", t, 100.0, 5).groupBy((F.col("id") % 3).alias("k")).count().collect()}
    for k, mean in ((0, 20.0), (1, 2e13 / 10**11.5), (2, 2.0)):
        assert abs(n[k] - mean) < 5 * (mean / 200) ** 0.5, (k, n[k], mean)


def test_mock_on_profiles(spark):
    h = rows(spark, 200).withColumn("u", F.lit(0.0))
    m = Mocks(h, None, 100.0, 100.0, tracers={"ELG": hod.Tracer(12.0, 13.0, 0.3, 1.0, 0.0, beside={"ELG": (12.0, 1.0)})})
    got = {r.is_central: r["count"] for r in m.run(nfw=True, exp_frac=0.5, exp_scale=0.5).groupBy("is_central").count().collect()}
    m.close()
    assert got[True] == 200 and abs(got[False] / 200 - 20.0) < 5 * (20.0 / 200) ** 0.5


def test_stored_draws(spark):
    d = hod.stored_draws(spark.range(20000), F.lit(300.0), 600).toPandas()
    assert d.u.between(0, 1).all() and abs(d.u.mean() - 0.5) < 0.02
    for a in "xyz":
        # Deviations: of a two-sided exponential 2**0.5 times its scale, of the normal the scale itself.
        for name, want in ((f"exp_{a}", (2 / 3) ** 0.5 * 300), (f"gauss_{a}", 300 / 3**0.5)):
            assert abs(d[name].std() / want - 1) < 0.05 and abs(d[name].mean()) < 5 * want / 20000**0.5, name
    assert abs(d[["u", "exp_x", "exp_y", "exp_z", "gauss_x", "gauss_y", "gauss_z"]].corr().to_numpy() - np.eye(7)).max() < 0.04
    again = hod.stored_draws(spark.range(20000).repartition(7), F.lit(300.0), 600).toPandas().sort_values("id", ignore_index=True)
    assert again.equals(d.sort_values("id", ignore_index=True))


def test_statistics_vector(spark):
    wp = spark.createDataFrame([(1, 4.0), (0, 3.0)], "rp_bin int, wp double")
    xi = spark.createDataFrame([(s, m, 2.0 + s) for s in range(2) for m in range(10)], "s_bin int, mu_bin int, xi double")
    got = [(r.place, r.part, r.bin, round(r.value, 6) + 0.0) for r in neighbors.statistics_vector(wp, xi, 10, (0,)).orderBy("place").collect()]
    assert got == [(0, "wp", 0, 3.0), (1, "wp", 1, 4.0), (2, "xi_0", 0, 2.0), (3, "xi_0", 1, 3.0)]
