"""Halo-particle range joins: the particles of all halos, and none outside the ranges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from halogrid.operators import ranks
from halogrid.queries import QUERIES
from halogrid.sources import catalog
from halogrid.sources.adapters import particles

SF = "/root/testdata/sf0.001"


def test_every_halo_has_its_particles(spark):
    want, row = set(), {}
    for p in sorted(particles(spark, SF).select("halo_id", "pid", "price", "weight").collect()):
        slab = p.halo_id % 8
        want.add((p.halo_id, row.get(slab, 0), p.pid, p.weight))
        row[slab] = row.get(slab, 0) + 1
    got = [tuple(r) for r in QUERIES["halo_particle_range_join"](spark, SF).collect()]
    assert len(got) == len(want) and set(got) == want


def test_particles_outside_the_ranges_drop_out(spark):
    h = spark.createDataFrame([(0, 1, 0, 2), (0, 2, 2, 0), (0, 3, 4, 1), (1, 4, 1, 1)], "slab int, id long, npstartA long, npoutA long")
    p = spark.createDataFrame([(s, "A", r, 10 * s + r) for s in range(2) for r in range(6)] + [(0, "B", 0, 99)], "slab int, ab string, row long, pid long")
    got = sorted((r.halo_id, r.row, r.pid) for r in catalog.halo_particles(h, p, ["A"]).collect())
    assert got == [(1, 0, 0), (1, 1, 1), (3, 4, 4), (4, 1, 11)]


def test_index_where_partitions_are_merged_by_size(spark):
    """The rows and their sums must be of the same partitions, though they have other widths."""
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = spark.range(20000).select("id", (F.col("id") % 8).alias("slab"), F.sha2(F.col("id").cast("string"), 256).alias("wide"))
        got = ranks.ordered_index(df, ["slab", "id"], by="slab").select("id", "_index", "wide").collect()
        assert len(got) == 20000 and all(r._index == r.id // 8 for r in got)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("parts", [8, 200])
def test_index_of_many_rows_read_with_other_columns(spark, parts):
    """A sample sees few of the rows, and pruning changes what is shuffled: numbers must not depend on either."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        df = spark.range(600_000).select((F.col("id") * 7919 % 600_011).alias("key"), F.lit("x" * 40).alias("wide"))
        want = df.select("key").toPandas()["key"].rank().astype(int) - 1
        for cols in (["key"], ["key", "wide"]):
            for _ in range(2):
                got = ranks.ordered_index(df, ["key"]).select("_index", *cols)
                one = got.agg(F.count("*").alias("n"), F.countDistinct("_index").alias("d"), F.max("_index").alias("m"), F.sum(F.col("_index") * F.col("key")).alias("s")).first()
                assert (one.n, one.d, one.m) == (600_000, 600_000, 599_999)
                assert one.s == int((want * (np.arange(600_000) * 7919 % 600_011)).sum())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
