"""Many samples against one at a time; gathered headers."""

import json
import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from halogrid.operators import hod, mesh
from halogrid.plans import inference
from halogrid.streaming.gather import gather_headers, gathered


def numbers(m, cut, sigma, m1, t):
    """Occupations of one sample in plain Python, with the library's approximation of erf checked by hod's own tests."""
    cen = sum(0.5 * math.erfc((cut - math.log10(x)) / (1.41421356 * sigma)) for x in m)
    sat = sum(((x - t.kappa * 10**cut) / 10**m1) ** t.alpha * 0.5 * math.erfc((cut - math.log10(x)) / (1.41421356 * sigma)) for x in m if x > t.kappa * 10**cut)
    return cen * t.ic, sat * t.ic


def test_a_thousand_samples_in_one_pass(spark):
    g = np.random.default_rng(1)
    mass = [float(v) * 2e9 for v in g.integers(500, 50_000, 400)]
    p = [(i, 12.5 + float(g.uniform()), 0.2 + float(g.uniform()), 13.5 + float(g.uniform())) for i in range(1000)]
    halos = spark.createDataFrame([(m,) for m in mass] + [(None,)], "mass double")
    samples = spark.createDataFrame(p, "sample long, logm_cut double, sigma double, logm1 double")
    df = inference.expected_numbers(halos, samples, "LRG", hod.LRG)
    got = {r.sample: r for r in df.collect()}
    assert len(got) == 1000
    for i, cut, sigma, m1 in p[::97]:
        want = numbers(mass, cut, sigma, m1, hod.LRG)
        assert abs(got[i].n_cent - want[0]) < 1e-3 and abs(got[i].n_sat - want[1]) < 1e-3
    i, cut, sigma, m1 = p[5]
    one = hod.mean_number(halos.where("mass is not null").select(F.lit(1.0).alias("weight"), F.log10("mass").alias("lm")), "LRG", replace(hod.LRG, logm_cut=cut, sigma=sigma, logm1=m1), F.col("lm")).first()
    assert abs(one.n_cent - got[5].n_cent) < 1e-6 and abs(one.n_sat - got[5].n_sat) < 1e-6
    for name, t in (("ELG", hod.ELG), ("QSO", hod.QSO)):
        assert all(r.n_cent > 0 for r in inference.expected_numbers(halos, samples, name, t).collect())
    assert {(r.n_cent, r.n_sat) for r in inference.expected_numbers(halos.limit(0), samples, "LRG", hod.LRG).collect()} == {(0.0, 0.0)}
    with pytest.raises(ValueError):
        inference.tracer_of(samples.withColumn("acent", F.lit(1.0)), hod.LRG)


def test_log_probabilities(spark):
    g = np.random.default_rng(2)
    cov = {pair: (lambda a: a @ a.T + np.eye(4))(g.normal(size=(4, 4))) for pair in ("LRG", "ELG")}
    data = {pair: g.normal(size=4) for pair in cov}
    theory = {s: {pair: g.normal(size=4) for pair in cov} for s in range(50)}
    a = [(float(s % 10),) for s in range(50)]
    samples = spark.createDataFrame([(s, *a[s]) for s in range(50)], "sample long, a double")
    rows = lambda d: [(pair, i, float(v)) for pair, x in d.items() for i, v in enumerate(x)]
    inverse = spark.createDataFrame([(pair, i, j, float(c[i, j])) for pair, c in cov.items() for i in range(4) for j in range(4)], "pair string, i int, j int, value double")
    data_df = spark.createDataFrame(rows(data), "pair string, i int, value double")
    t = spark.createDataFrame([(s, *r) for s, d in theory.items() for r in rows(d)], "sample long, pair string, i int, value double")
    got = {r.sample: r.lnp for r in inference.log_probabilities(samples, {"a": (0.0, 8.0)}, t, data_df, inverse).collect()}
    for s in range(50):
        want = -0.5 * sum((theory[s][p] - data[p]) @ cov[p] @ (theory[s][p] - data[p]) for p in cov) if 0 < a[s][0] < 8 else -math.inf
        assert got[s] == want or abs(got[s] - want) < 1e-9
    single = hod.log_probability({"a": 3.0}, {"a": (0.0, 8.0)}, lambda _: t.where("sample = 3").drop("sample"), data_df, inverse)
    assert abs(single - got[3]) < 1e-9 and hod.log_probability({"a": 9.0}, {"a": (0.0, 8.0)}, None, data_df, inverse) == -math.inf


def test_partition_rows_and_starts(spark):
    g = np.random.default_rng(3)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(g.uniform(0, 50, 500))], "id long, x double").repartition(5)
    rows = sorted(mesh.partitioned(df, 7, 50.0, ["id"]).collect(), key=lambda r: r.place)
    assert [r.place for r in rows] == list(range(500)) and [(r.part, r.id) for r in rows] == sorted((r.part, r.id) for r in rows)
    starts = {r.part: (r.start, r.n) for r in mesh.partition_starts(df, 7, 50.0).collect()}
    assert all(starts[r.part][0] <= r.place < sum(starts[r.part]) for r in rows) and len(starts) == 7


def test_headers_are_gathered_once(spark, tmp_path):
    src, target, done = tmp_path / "src", str(tmp_path / "t"), str(tmp_path / "c")
    (src / "a").mkdir(parents=True)
    put = lambda name, *rows: (src / name).write_text("\n".join(json.dumps(r) for r in rows))
    put("a/1.json", {"sim": "s1", "redshift": "z0.100", "param": {"n": "1", "m": "2"}, "state": {"a": "1"}})
    put("2.json", {"sim": "s2", "redshift": "z0.100", "param": {"n": "3"}}, {"sim": None, "redshift": "z1"})
    assert gather_headers(spark, str(src), target, done) == 2
    assert gather_headers(spark, str(src), target, done) == 0
    put("3.json", {"sim": "s1", "redshift": "z0.100", "param": {"n": "9"}, "state": {"b": "2"}})
    assert gather_headers(spark, str(src), target, done) == 1
    got = {r.sim: (r.param, r.state) for r in gathered(spark, target).collect()}
    assert got == {"s1": ({"m": "2", "n": "9"}, {"a": "1", "b": "2"}), "s2": ({"n": "3"}, {})}
    from halogrid.sources.catalog import get_meta

    assert get_meta(gathered(spark, target), "s1", 0.1) == {"m": "2", "n": "9", "a": "1", "b": "2"}
