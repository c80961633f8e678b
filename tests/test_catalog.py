"""Catalog scans: layouts, field sets, light cones, principal axes and particles that cleaning merged in."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from halogrid.functions import decode
from halogrid.sources import catalog, layout

HEADER = {"BoxSize": 1000.0, "VelZSpace_to_kms": 100.0, "ppd": 64, "SimName": "small"}


def halo_rows(slab, n=4):
    return [(slab, i, slab * 10 + i, 40 + i, 3 * i, 2, 2 * i, 1, [0.1, 0.2, 0.3], 7 * i + slab) for i in range(n)]


SCHEMA = "slab int, row long, id long, N long, npstartA long, npoutA long, npstartB long, npoutB long, x_L2com array<double>, sigmar_eigenvecs_L2com_u16 int"


def write(spark, root, inside=True):
    group = f"{root}/sims/small/halos/z0.000"
    for s in range(2):
        spark.createDataFrame(halo_rows(s), SCHEMA).coalesce(1).write.parquet(f"{group}/halo_info/halo_info_{s:03d}.parquet")
        clean = [(s, i, 0 if i == 1 else 50 + i, 5, 2 * i, 1 if i == 2 else 0, i, 0, -1) for i in range(4)]
        at = f"{root}/sims/cleaning/small/z0.000" + ("/cleaned_halo_info" if inside else "")
        spark.createDataFrame(clean, "slab int, row long, N_total long, N_merge long, npstartA_merge long, npoutA_merge long, npstartB_merge long, npoutB_merge long, N_mainprog long").coalesce(1).write.parquet(f"{at}/cleaned_halo_info_{s:03d}.parquet")
    return group


@pytest.mark.parametrize("inside", [True, False])
def test_layouts(spark, tmp_path, inside):
    group = write(spark, tmp_path, inside)
    whole = layout.resolve(spark, group)
    assert whole.slabs == [0, 1] and len(whole.cleaned) == 2 and layout.resolve(spark, f"{group}/halo_info").halos == whole.halos
    one = layout.resolve(spark, f"{group}/halo_info/halo_info_001.parquet")
    assert one.slabs == [1] and one.cleaned[0].endswith("cleaned_halo_info_001.parquet")
    assert (one.merged_particles.endswith("cleaned_rvpid")) == inside
    files = [f"{group}/halo_info/halo_info_{i:03d}.parquet" for i in (0, 1)]
    assert layout.resolve(spark, files, cleaned=False).cleaned == []
    with pytest.raises(ValueError):
        layout.resolve(spark, files + files[:1])
    with pytest.raises(FileNotFoundError):
        layout.resolve(spark, f"{tmp_path}/nothing")
    with pytest.raises(FileNotFoundError):
        layout.resolve(spark, group, cleaning=f"{tmp_path}/empty")
    with pytest.raises(ValueError):
        layout.resolve(spark, [group, f"{group}/halo_info"])
    assert layout.is_light_cone(spark, "/data/halo_light_cones/z1") and not layout.is_light_cone(spark, group)


def test_field_sets_and_axes(spark, tmp_path):
    at = layout.resolve(spark, write(spark, tmp_path))
    default = catalog.Catalog.scan(spark, at, HEADER).halos
    assert "N" in default.columns and "N_merge" in default.columns and "N_mainprog" not in default.columns and "N_total" not in default.columns
    assert "N_mainprog" in catalog.Catalog.scan(spark, at, HEADER, "all").halos.columns
    plain = catalog.Catalog.scan(spark, at.halos, HEADER)
    assert "N_merge" not in plain.halos.columns and plain.nbytes > 0 and "small" in repr(plain)
    axes = catalog.Catalog.scan(spark, at, HEADER, ["id", *(f"sigmar_eigenvecs{a}_L2com" for a in ("Min", "Mid", "Maj"))]).halos.collect()
    table = {r.code: r for r in decode.euler16_table(spark).where("code < 40").collect()}
    for r in axes:
        code = 7 * (r.id % 10) + r.id // 10
        m = np.array([r.sigmar_eigenvecsMin_L2com, r.sigmar_eigenvecsMid_L2com, r.sigmar_eigenvecsMaj_L2com])
        np.testing.assert_allclose(m @ m.T, np.eye(3), atol=1e-9)
        assert r.sigmar_eigenvecsMaj_L2com == [table[code].maj_x, table[code].maj_y, table[code].maj_z]
    assert [r.x_L2com for r in catalog.Catalog.scan(spark, at, HEADER, "x_L2com").halos.take(1)] == [[100.0, 200.0, 300.0]]


def test_particles_that_cleaning_merged_in(spark, tmp_path):
    at = layout.resolve(spark, write(spark, tmp_path))
    word = lambda tag, s, k, r: (s, k, r, 1000 * tag + 100 * s + 10 * (k == "B") + r)
    kind = "slab int, ab string, row long, packedpid long"
    spark.createDataFrame([word(1, s, k, r) for s in range(2) for k in "AB" for r in range(14)], kind).write.parquet(f"{tmp_path}/parts")
    spark.createDataFrame([word(2, s, k, r) for s in range(2) for k in "AB" for r in range(8)], kind).write.parquet(f"{tmp_path}/merged")
    c = catalog.Catalog.scan(spark, at, HEADER, ["id", "N"], subsamples={"A": True, "B": True, "pid": True}, particle_path=f"{tmp_path}/parts", merged_path=f"{tmp_path}/merged")
    h = {r.id: r for r in c.halos.collect()}
    got = [(r.ab, r.slab, r.halo_id, r.place, r.pid) for r in c.particles.orderBy("ab", "slab", "halo_id", "place").collect()]
    want = []
    for k in "AB":
        for s in range(2):
            for i in range(4):
                if i == 1:
                    continue  # merged away: no particles
                own = [word(1, s, k, r)[3] for r in (range(3 * i, 3 * i + 2) if k == "A" else range(2 * i, 2 * i + 1))]
                more = [word(2, s, k, r)[3] for r in (range(2 * i, 2 * i + (i == 2)) if k == "A" else ())]
                assert (h[s * 10 + i][f"npstart{k}"], h[s * 10 + i][f"npout{k}"]) == (len(want), len(own + more))
                want += [(k, s, s * 10 + i, p, x) for p, x in enumerate(own + more)]
    assert got == want and h[1].npoutA == h[1].npoutB == 0


def test_light_cone(spark, tmp_path):
    rows = [(0, i, 40, 3 * i, 3, 5 + i, [0.0, 0.0, float(i)], [1.0, 1.0, 1.0], 9) for i in range(3)]
    spark.createDataFrame(rows, "slab int, id long, N long, npstartA long, npoutA long, origin int, pos_avg array<double>, pos_interp array<double>, other int").write.parquet(f"{tmp_path}/halo_light_cones/z1/lc_halo_info.parquet")
    spark.createDataFrame([(0, "A", r, [float(r)] * 3, r) for r in range(9)], "slab int, ab string, row long, pos array<double>, pid long").write.parquet(f"{tmp_path}/pidrv")
    at = layout.resolve(spark, f"{tmp_path}/halo_light_cones/z1")
    assert at.light_cone and at.cleaned == []
    c = catalog.Catalog.scan(spark, at, HEADER, ["N", "origin", "pos_interp", "other", "id"], subsamples=True, particle_path=f"{tmp_path}/pidrv")
    assert "other" not in c.halos.columns and "npoutA" in c.halos.columns
    assert sorted((r.origin, r.pos_interp) for r in c.halos.collect()) == [(0, [0.0, 0.0, 1.0]), (1, [0.0, 0.0, 2.0]), (2, [1.0, 1.0, 1.0])]
    with pytest.raises(ValueError):
        catalog.Catalog.scan(spark, at.halos * 2, HEADER, light_cone=True)
    header = {"OutputType": "LightCone", "SimSet": "big", "ParticleSubsampleA": 0.03, "ParticleSubsampleB": 0.07}
    assert layout.subsample_fraction(header, ("big",))["SubsampleFraction"] == pytest.approx(0.1)
    assert "SubsampleFraction" not in layout.subsample_fraction(header, ("small",))


def test_options_are_flags():
    for bad in ({"A": 3}, {"pos": "yes"}, {"A": None}):
        with pytest.raises(ValueError):
            catalog.subsample_options(bad)


def test_particles_of_each_encoding(spark, tmp_path):
    head, part = bytes([255, 0x80, 0x8D, 0x7D, 0x07, 0x7E, 0x7D, 0x07, 0xD0]), bytes([0x80, 0x00, 0x80, 0x80, 0x00, 0x80, 0x80, 0x00, 0x80])
    spark.createDataFrame([("f", 0, bytearray(head)), ("f", 1, bytearray(part))], "file string, pos long, pack9 binary").write.parquet(f"{tmp_path}/p9")
    got = catalog.read_particles(spark, f"{tmp_path}/p9", HEADER)
    assert {"x", "y", "z", "vx", "vy", "vz"} <= set(got.columns) and got.count() == 1
    assert set(catalog.read_particles(spark, f"{tmp_path}/p9", HEADER, ("pos",)).columns) == {"file", "pos", "x", "y", "z"}
    spark.range(3).select(F.col("id").alias("pid")).write.parquet(f"{tmp_path}/pid")
    assert catalog.read_particles(spark, f"{tmp_path}/pid", HEADER).count() == 3
    spark.range(3).select(F.col("id").alias("pid"), F.col("id").alias("packedpid")).write.parquet(f"{tmp_path}/two")
    with pytest.raises(ValueError):
        catalog.read_particles(spark, f"{tmp_path}/two", HEADER)
