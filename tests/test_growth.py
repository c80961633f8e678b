"""What a task holds, and how often a step runs, as tables grow."""

import numpy as np
from pyspark.sql import functions as F

from halogrid import queries, queries_catalog, queries_more, queries_spatial, session
from halogrid.operators import neighbors, ranks
from halogrid.sources import records

SMALL = "/root/testdata/sf0.001"


def largest(df):
    """Rows of the fullest partition."""
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


def test_particles_with_their_halos_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "DEALT_ROWS", 100)
    assert largest(queries_more._relative(spark, SMALL)) < 300


def test_next_place_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(5)
    at = rng.integers(0, 4, (200, 3)).astype(float)
    grp = rng.integers(0, 30, 200)
    df = spark.createDataFrame([(int(g), i, *map(float, p)) for i, (g, p) in enumerate(zip(grp, at, strict=True))] + [(99, 200, 1.0, 1.0, 1.0), (99, 201, 1.0, 1.0, 1.0)], "g int, i int, x double, y double, z double")
    got = {r.i: r.nn2 for r in neighbors.next_place(df, "g", "nn2").collect()}
    assert got.pop(200) is None and got.pop(201) is None and len(got) == 200
    for i in range(200):
        d2 = ((at[grp == grp[i]] - at[i]) ** 2).sum(axis=1)
        assert got[i] == (d2[d2 > 0].min() if (d2 > 0).any() else None)


def test_sampled_particles_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(session, "DEALT_ROWS", 100)
    assert largest(queries._sat(spark, SMALL)) < 300


def test_bounds_are_no_column_of_the_rows(spark):
    rows = [(i, float("nan") if i % 5 == 0 else None if i % 7 == 0 else i / 3, ("a,b", '"q"', "é\n", None)[i % 4]) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, v double, t string")
    few = ranks.ordered_buckets(df, ["v", "t", "i"])
    assert "Join" not in few._jdf.queryExecution().optimizedPlan().toString()
    many = ranks.ordered_buckets(df, ["v", "t", "i"], "other", finer=200)  # by joined bounds
    both = few.join(many, ["i"]).groupBy("other").agg(F.min("_part").alias("lo"), F.max("_part").alias("hi")).orderBy("other").collect()
    assert few.agg(F.max("_part")).first()[0] == 3 and all(a.hi <= b.lo for a, b in zip(both, both[1:], strict=False))


def test_sizes_of_bins_need_no_order(spark):
    df = spark.range(1000).select("id", F.expr("id * 7 % 11.0D").alias("v"), F.expr("id % 3 + 0.5D").alias("m"))
    plan = ranks.rank_in_bins(df, "v", "m", [0.0, 1.0, 2.0, 3.0], "id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2  # the sums of buckets and the sizes of bins


def test_counts_from_starts_join_no_rows_with_rows(spark):
    n = [(i * 37 % 101, i * 37 % 101 % 4) for i in range(101)]
    start, at = {}, 0
    for i, k in sorted(n):
        start[i], at = at, at + k
    df = spark.createDataFrame([(i, start[i], f"x{i}") for i, _ in n], "id long, start long, more string")
    got = ranks.counts_from_starts(df, "start", ["id"], at, "n")
    assert {r.id: (r.n, r.more) for r in got.collect()} == {i: (k, f"x{i}") for i, k in n}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # with one row a bucket


def test_records_are_written_by_several_tasks_and_read_in_bounded_ranges(spark, monkeypatch, tmp_path):
    parts, write = [], records.write_records
    monkeypatch.setattr(records, "write_records", lambda df, *more: (parts.append(df.rdd.getNumPartitions()), write(df, *more)))
    monkeypatch.setattr(queries_spatial.records, "write_records", records.write_records)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = queries_spatial.records_round_trip(spark, SMALL).count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == 1500 and parts[0] > 1
    with open(tmp_path / "large", "wb") as f:
        f.truncate(12 * 100_000)
    ranges = records.RecordReader({"path": str(tmp_path / "large"), "kind": "rvint", "splitBytes": "12"}, ["row"]).partitions()
    assert len(ranges) <= records.MOST_RANGES and sum(r.count for r in ranges) == 100_000


def test_staged_files_are_made_from_what_is_written(spark, monkeypatch):
    frames, stage = {}, queries_catalog._stage
    monkeypatch.setattr(queries_catalog, "_stage", lambda spark, **more: (frames.update(more), stage(spark, **more))[1])
    queries_catalog._raw(spark, SMALL)
    read = {name: " ".join(df.inputFiles()) for name, df in frames.items()}
    assert "lineitem" in read["particles"] and "orders" not in read["particles"]
    assert "lineitem" not in read["cleaned"] and "lineitem" not in read["merged"]
