"""Sinks: mocks with their parameters, prepared slabs, caches, chains."""

import json

import pytest
from pyspark.sql import functions as F

from halogrid.sources import sinks


def test_mocks_by_chunk(spark, tmp_path):
    mock = spark.createDataFrame([(i, "LRG" if i % 3 else "ELG", i % 2 == 0) for i in range(12)], "id long, tracer string, is_central boolean")
    for chunk in (0, 1):
        path = sinks.write_mock(mock.where(F.col("id") % 2 == chunk), f"{tmp_path}/m", suffix="_x", chunk=chunk, parameters={"logm_cut": 13.0})
    assert path.endswith("m_rsd_x") and sinks.read_mock(spark, path).count() == 12 and sinks.read_mock(spark, path, "ELG").count() == 4
    meta = spark.read.parquet(f"{path}.meta").collect()
    assert sorted((m.chunk, m.tracer, m.n, m.n_cent) for m in meta) == [(0, "ELG", 2, 2), (0, "LRG", 4, 4), (1, "ELG", 2, 0), (1, "LRG", 4, 0)]
    assert json.loads(meta[0].parameters) == {"logm_cut": 13.0}


def test_prepared_slabs(spark, tmp_path):
    df = spark.createDataFrame([(s, s) for s in range(4)], "slab int, v int")
    assert sinks.write_prepared(df.where("slab < 2"), f"{tmp_path}/p")
    assert sinks.write_prepared(df.withColumn("v", F.col("v") + 10), f"{tmp_path}/p", overwrite=False)
    assert not sinks.write_prepared(df, f"{tmp_path}/p", overwrite=False)
    assert sorted((r.slab, r.v) for r in spark.read.parquet(f"{tmp_path}/p").collect()) == [(0, 0), (1, 1), (2, 12), (3, 13)]
    parts = [[r.slab for r in sinks.chunk_of(df, c, 3, 4).orderBy("slab").collect()] for c in range(3)]
    assert parts == [[0, 1], [2, 3], []]
    with pytest.raises(ValueError):
        sinks.chunk_of(df, 3, 3, 4)


def test_caches_and_chains(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert sinks.cached(spark, f"{tmp_path}/c", {"n": 3}, make).count() == 3
    assert made == [1]
    with pytest.raises(ValueError):
        sinks.cached(spark, f"{tmp_path}/c", {"n": 4}, make)
    for step in range(2):
        sinks.append_samples(spark, f"{tmp_path}/chain", ["a", "b"], [(step, 1), (step, 2)], step)
    assert spark.read.parquet(f"{tmp_path}/chain").where("step = 1 and a = 1").count() == 2
    assert sinks.write_correlation(spark.range(2), str(tmp_path), "small", 0.5).endswith("small-z0.500-cf")
    spark.createDataFrame([(0, 0, 0, 5.0, 10.0, 20.0)], "ix int, iy int, iz int, dx double, dy double, dz double").write.parquet(f"{tmp_path}/d")
    assert tuple(sinks.read_displacement(spark, f"{tmp_path}/d", 10.0).first()) == (0, 0, 0, 0.5, 1.0, 2.0)
