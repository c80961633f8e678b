"""Tables stored by halo, binary records, pipes."""

import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from halogrid.functions import decode
from halogrid.operators import hod
from halogrid.plans.mocks import Mocks
from halogrid.sources import records, sinks, storage


def staged(spark):
    halos = spark.range(2000).select("id", (F.col("id") * 3e10 + 1e12).alias("mass"), F.rand(1).alias("u"), *[(F.col("id") % 97).cast("double").alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")])
    p = spark.range(20_000).select(F.col("id").alias("pid"), (F.col("id") % 2000).alias("halo_id"), F.rand(2).alias("u"), F.lit(0.2).alias("weight"), *[(F.col("id") % 89).cast("double").alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")])
    return halos, p.join(halos.select(F.col("id").alias("halo_id"), "mass"), "halo_id")


def test_stored_mock_has_no_exchange(spark):
    halos, p = staged(spark)
    halos, p = halos.coalesce(2), p.coalesce(2)
    store = storage.store_by_halo("kept", halos, p, buckets=5)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tracers = {"LRG": hod.LRG, "ELG": hod.ELG}
        mock = Mocks.stored(spark, store, 1000.0, 100.0, tracers=tracers).run()
        counted = mock.groupBy("tracer", "is_central").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan(mock) and "Exchange" not in plan(mock) and plan(counted).count("Exchange") == 1
        loose = Mocks(*store.tables(spark), 1000.0, 100.0, tracers)
        assert sorted(counted.collect()) == sorted(loose.run().groupBy("tracer", "is_central").agg(F.count("*").alias("n"), F.sum("id").alias("ids")).collect())
        loose.close()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        store.drop(spark)


def test_ranges_meet_record_borders(spark, tmp_path):
    g = np.random.default_rng(1)
    words = g.integers(-(2**31), 2**31, (1003, 3)).astype("<i4")
    (tmp_path / "r").mkdir()
    (tmp_path / "r/a").write_bytes(words[:700].tobytes())
    (tmp_path / "r/b").write_bytes(words[700:].tobytes())
    (tmp_path / "r/_c").write_bytes(b"no record")
    df = records.read_records(spark, str(tmp_path / "r"), "rvint", split_bytes=1000)
    assert df.rdd.getNumPartitions() == -(-700 // 83) + -(-303 // 83)
    assert [(r.rv_x, r.rv_y, r.rv_z, r.row) for r in df.orderBy("row").collect()] == [(*map(int, w), i) for i, w in enumerate(words)]
    one = records.read_records(spark, str(tmp_path / "r/b"), "rvint", ["rv_y"])
    assert one.columns == ["rv_y"] and [r[0] for r in one.collect()] == words[700:, 1].tolist()
    (tmp_path / "r/d").write_bytes(b"12345")
    with pytest.raises(Exception, match="ends inside a record"):
        records.read_records(spark, str(tmp_path / "r"), "rvint").count()
    with pytest.raises(Exception, match="unknown fields"):
        records.read_records(spark, str(tmp_path / "r"), "rvint", ["vx"]).count()


@pytest.mark.parametrize("kind", ["rvint", "packedpid"])
def test_round_trip(spark, tmp_path, kind):
    names = [n for n, _ in records.LAYOUTS[kind]]
    df = spark.range(500).select("id", *[(F.col("id") * 7919 - i).cast("int" if kind == "rvint" else "long").alias(n) for i, n in enumerate(names)]).repartitionByRange(4, "id").sortWithinPartitions("id")
    path = f"{tmp_path}/w"
    records.write_records(df, path, kind)
    got = records.read_records(spark, path, kind, split_bytes=100).orderBy("row")
    assert [tuple(r[n] for n in names) for r in got.collect()] == [tuple(r[n] for n in names) for r in df.orderBy("id").collect()]
    records.write_records(df.limit(3), path, kind, "overwrite")
    assert records.read_records(spark, path, kind).count() == 3


def test_failed_write_leaves_nothing(spark, tmp_path):
    path = tmp_path / "w"
    good = spark.range(100).select(F.col("id").alias("packedpid"))
    records.write_records(good, str(path), "packedpid")
    before = sorted(p.name for p in path.iterdir())
    bad = good.repartition(3).withColumn("packedpid", F.when(F.col("packedpid") != 57, F.col("packedpid")))
    with pytest.raises(Exception, match="null"):
        records.write_records(bad, str(path), "packedpid", "overwrite")
    assert sorted(p.name for p in path.iterdir()) == before and records.read_records(spark, str(path), "packedpid").count() == 100


def test_pack9_in_ranges(spark, tmp_path):
    g = np.random.default_rng(4)
    raw = g.integers(0, 255, (900, 9)).astype("u1")
    raw[[3, 200, 201, 640], 0] = records.HEADER
    (tmp_path / "p9").write_bytes(raw.tobytes())
    rows = spark.createDataFrame([("f", i, bytearray(r.tobytes())) for i, r in enumerate(raw)], "file string, pos int, raw binary")
    want = [tuple(r)[1:] for r in decode.decode_pack9(rows, 100.0, 2.0).orderBy("pos").collect()]
    for split in (90, 10_000):
        got = records.read_records(spark, str(tmp_path / "p9"), "pack9", split_bytes=split)
        assert [tuple(r) for r in decode.decode_pack9_records(got, 100.0, 2.0).orderBy("row").collect()] == want and len(want) == 900 - 3 - 4
    again = f"{tmp_path}/again"
    records.write_records(rows.coalesce(1).select(F.col("raw").alias("record")), again, "pack9")
    assert [tuple(r) for r in decode.decode_pack9_records(records.read_records(spark, again, "pack9"), 100.0, 2.0).orderBy("row").collect()] == want


def test_pipe_fields_line_up(spark):
    df = spark.range(1000).repartition(8).select("id", (F.col("id") * 2.5).alias("m"), F.array(*[(F.col("id") + i).cast("float") for i in range(3)]).alias("x"))
    for order in (None, ["id"]):
        out = io.BytesIO()
        assert sinks.to_pipe(df, ["id", "m", "x"], out, order) == 1000
        out.seek(0)
        cols = []
        for kind in ("i8", "f8", "(3,)f4"):
            n, width = struct.unpack("<qi", out.read(12))
            assert (n, width) == (1000, np.dtype(kind).itemsize)
            cols.append(np.frombuffer(out.read(n * width), kind))
        assert not out.read() and sorted(cols[0]) == list(range(1000))
        assert (cols[1] == cols[0] * 2.5).all() and (cols[2] == cols[0][:, None] + np.arange(3)).all()
        assert order is None or (np.diff(cols[0]) == 1).all()
    out = io.BytesIO()
    assert sinks.to_pipe(df.limit(0), ["m"], out) == 0 and out.getvalue() == struct.pack("<qi", 0, 8)
