import io
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from halogrid.functions import decode
from halogrid.operators import hod, mesh, neighbors, power, ranks
from halogrid.plans.mocks import Mocks, prepare
from halogrid.queries import ORACLE_SQL, QUERIES
from halogrid.sources import catalog, sinks
from halogrid.sources.adapters import halos
from halogrid.streaming.deposits import deposit_stream, windowed_counts

SF = "/root/testdata/sf0.001"


def points(spark, n, box, seed, **extra):
    r = np.random.default_rng(seed)
    x = r.uniform(0, box, (n, 3))
    rows = [(i, *map(float, x[i]), *(float(v[i]) for v in extra.values())) for i in range(n)]
    return x, spark.createDataFrame(rows, "id long, x double, y double, z double" + "".join(f", {k} double" for k in extra))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL.keys() & QUERIES.keys()))
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events", "nation", "region"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    show = lambda rows: sorted(tuple(repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in rows)
    got = show(tuple(r) for r in df.select(*cols).collect())
    want = show(rel.project(", ".join(f'"{c}"' for c in cols)).fetchall())
    assert got == want


def test_single_particle_cube(spark):
    box, n = 123.0, 10
    p = spark.createDataFrame([(5 * box / n, 6 * box / n, 7 * box / n)], "x double, y double, z double")
    cells = {(r.ix, r.iy, r.iz): r.density for r in mesh.deposit(p, n, box).collect()}
    assert len(cells) == 27
    assert cells[5, 6, 7] == pytest.approx(0.75**3) and cells[4, 5, 6] == pytest.approx(0.5**9) and cells[5, 6, 8] == pytest.approx(0.125 * 0.75**2)
    assert sum(cells.values()) == pytest.approx(1)


def test_distance_join_against_all_pairs(spark):
    for box, r in ((100.0, 12.0), (100.0, 40.0)):
        x, p = points(spark, 150, box, 3)
        d = x[:, None] - x[None]
        d -= box * np.round(d / box)
        want = {(i, j) for i, j in zip(*np.nonzero((d**2).sum(2) <= r * r), strict=True)}
        assert {(a.a_id, a.b_id) for a in neighbors.distance_join(p, p, r, box).select("a_id", "b_id").collect()} == want


def test_prefix_sums(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate((1, 2, 3, 4))], "i long, v long")
    get = lambda **k: [r.s for r in ranks.prefix_sum(df, "v", ["i"], "s", **k).orderBy("i").collect()]
    assert get() == [0, 1, 3, 6] and get(initial=False) == [1, 3, 6, 10] and get(initial=False, offset=5) == [6, 8, 11, 15]
    assert ranks.prefix_sum(df.limit(0), "v", ["i"], "s").collect() == []


def test_rank_edges(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 1.5, 4.0), (3, 2.0, 1.0), (4, 2.5, 9.0), (5, 9.0, 0.0)], "id long, mass double, v double")
    got = {r.id: r.rank for r in ranks.rank_in_bins(df, "v", "mass", [0.5, 2.0, 3.0], "id").collect()}
    assert got == {1: 0.5, 2: -0.5, 3: 0.0, 4: 0.0, 5: 0.0}


def test_euler_axes_are_orthonormal(spark):
    t = decode.euler16_table(spark)
    assert t.count() == 65340
    dot = lambda a, b: F.expr("+".join(f"{a}_{c} * {b}_{c}" for c in "xyz"))
    worst = t.select(*[F.max(F.abs(dot(a, b) - (1.0 if a == b else 0.0))).alias(a + b) for a, b in (("maj", "maj"), ("min", "min"), ("mid", "mid"), ("maj", "min"), ("maj", "mid"))]).first()
    assert max(worst) < 1e-12


def test_options():
    assert catalog.subsample_options({"A": True, "rv": True}) == {"A": True, "pos": True, "vel": True}
    for bad in ({"q": True}, {"rv": True, "pos": True}):
        with pytest.raises(ValueError):
            catalog.subsample_options(bad)
    with pytest.raises(ValueError):
        catalog.check_unpack_bits("mass")
    assert catalog.check_unpack_bits(True) == catalog.PID_FIELDS


def test_scan_round_trip(spark, tmp_path):
    raw = [(s, i, s * 10 + i, 40 + i, 2 * i, 2, [0.1, 0.2, 0.3], 0.01) for s in range(2) for i in range(4)]
    spark.createDataFrame(raw, "slab int, row long, id long, N long, npstartA long, npoutA long, x_L2com array<double>, r100_L2com double").write.parquet(f"{tmp_path}/halos")
    spark.createDataFrame([(s, i, 0 if i == 1 else 50 + i) for s in range(2) for i in range(4)], "slab int, row long, N_total long").write.parquet(f"{tmp_path}/clean")
    words = [(s, "A", r, [(100 * r << 12) + 2048, 0, 0], 7 + (1 << 48)) for s in range(2) for r in range(10)]
    spark.createDataFrame(words, "slab int, ab string, row long, rvint array<int>, packedpid long").write.parquet(f"{tmp_path}/parts")
    header = {"BoxSize": 1000.0, "VelZSpace_to_kms": 100.0, "ppd": 64}
    c = catalog.Catalog.scan(spark, f"{tmp_path}/halos", header, ["id", "N", "x_L2com"], f"{tmp_path}/clean", {"A": True}, f"{tmp_path}/parts", lambda h: F.col("N_total" if "N_total" in h.columns else "N") > 50, unpack_bits="tagged")
    assert sorted((r.id, r.N) for r in c.halos.collect()) == [(2, 52), (3, 53), (12, 52), (13, 53)]
    assert c.halos.first().x_L2com == [100.0, 200.0, 300.0]
    got = c.particles.where("slab = 0").orderBy("row").collect()
    assert [(r.halo_id, r.row, r.pid, r.tagged) for r in got] == [(2, 4, 7, 1), (2, 5, 7, 1), (3, 6, 7, 1), (3, 7, 7, 1)]
    assert got[0].x == pytest.approx(0.4) and got[0].vx == 0
    with pytest.raises(KeyError):
        catalog.Catalog.scan(spark, f"{tmp_path}/halos", header, ["nothing"])
    with pytest.raises(ValueError):
        catalog.Catalog.scan(spark, [f"{tmp_path}/halos"] * 2, header)
    out = io.BytesIO()
    assert sinks.to_pipe(c.halos.orderBy("id").coalesce(1), ["N", "x_L2com"], out) == 4
    raw = out.getvalue()
    assert struct.unpack_from("<qi4q", raw) == (4, 8, 52, 53, 52, 53) and struct.unpack_from("<qi", raw, 44) == (4, 24)


def test_power_of_a_plane_wave(spark):
    n, box = 16, 100.0
    m = np.fft.rfftn(np.cos(2 * np.pi * 2 * np.arange(n) / n)[:, None, None] * np.ones((n, n, n))) / n**3
    p = (abs(m) ** 2) * box**3
    k, mu = power.k_mu_edges(n, box, math.pi * n / box, 8, 2, False)
    r = power.bin_modes(p, n, box, k, mu, (0, 2))
    at = int(np.nanargmax(r["poles"][0]))
    assert k[at] < 2 * 2 * np.pi / box <= k[at + 1]
    both = np.nansum(r["power"] * r["n_modes"], 1) / r["n_modes"].sum(1)
    np.testing.assert_allclose(both, r["poles"][0], rtol=1e-9)
    x, df = points(spark, 500, box, 5)
    out = power.power_spectrum(df, box, 16, 6, 2).collect()
    assert len(out) == 12 and sum(r.n_modes for r in out) > 1000
    inter = power.power_spectrum(df, box, 16, 6, 2, interlaced=True).collect()
    low = [(a.power, b.power) for a, b in zip(out, inter) if a.n_modes and a.k_bin == 1]
    for a, b in low:
        assert a == pytest.approx(b, rel=0.2)


def test_mock_end_to_end(spark, tmp_path):
    h = halos(spark, SF).withColumns({"r98": F.lit(1.5), "conc": F.lit(6.0) + F.col("id") % 3, "sigma_v": F.lit(300.0)})
    sinks.write_prepared(prepare(h, 1000.0, [0.0, 5e12, 1e13, 2e13], 20.0, 60.0, 1e11), f"{tmp_path}/staged")
    staged = spark.read.parquet(f"{tmp_path}/staged")
    tracers = {"LRG": hod.Tracer(13.0, 13.6, 0.6, 1.0, 0.4, bcent=0.2), "ELG": hod.Tracer(12.5, 13.2, 1.0, 1.0, 1.0, p_max=0.5, gamma=2.0)}
    m = Mocks(staged, None, 1000.0, 100.0, tracers)
    mock = m.run(reseed=3).persist()
    again = {(r.id, r.tracer) for r in m.run(reseed=3).select("id", "tracer").collect()}
    rows = mock.collect()
    assert {(r.id, r.tracer) for r in rows} == again and len({r.id for r in rows}) == len(rows) > 100
    assert all(-500 <= r.z < 500 for r in rows)
    mock = sinks.read_mock(spark, sinks.write_mock(mock, f"{tmp_path}/mock"))
    wp = m.clustering(mock, "wp", rp=[5.0, 20.0, 60.0], pimax=40)
    assert {(r.t1, r.t2) for r in wp.collect()} <= {("LRG", "LRG"), ("LRG", "ELG"), ("ELG", "ELG")}
    with pytest.raises(ValueError):
        m.clustering(mock, "other")
    assert sinks.read_mock(spark, f"{tmp_path}/mock_rsd", "LRG").count() == sum(r.tracer == "LRG" for r in rows)
    assert m.run(nfw=True, reseed=4).where("not is_central").count() > 0


def test_streams(spark, tmp_path):
    _, p = points(spark, 200, 100.0, 2)
    p.repartition(4).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(p.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    q = deposit_stream(s, 4, 100.0).writeStream.outputMode("complete").format("memory").queryName("cells").start()
    q.processAllAvailable()
    q.stop()
    want = {(r.ix, r.iy, r.iz): r.density for r in mesh.deposit(p, 4, 100.0).collect()}
    assert {(r.ix, r.iy, r.iz): r.density for r in spark.table("cells").collect()} == pytest.approx(want)
    e = spark.read.parquet(f"{SF}/events.parquet")
    assert windowed_counts(e).agg(F.sum("n")).first()[0] == e.count()


def test_metadata(spark):
    m = spark.createDataFrame([("s", "z0.100", {"a": "1", "b": "2"}, {"b": "3"})], "sim string, redshift string, param map<string,string>, state map<string,string>")
    assert catalog.get_meta(m, "s", 0.1) == {"a": "1", "b": "3"}
    with pytest.raises(ValueError):
        catalog.get_meta(m, "s", 0.2)
