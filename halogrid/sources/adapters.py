"""Halo and particle views of TPC-H-like tables: positions and uniform numbers are integer hashes of keys, exact in any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = 1000.0


def hashed(key: Column, a: int, b: int, m: int) -> Column:
    return (key * a + b) % m


def unit(key: Column, stream: int) -> Column:
    """Uniform number with 10007 values."""
    return hashed(key, 7919, stream * 104729, 10007).cast("double") / F.lit(10007.0)


def halos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, n (particles), mass, x, y, z, vx, vy, vz, slab, merged_to of orders."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    n = F.floor(F.col("o_totalprice") / 100).cast("long") + 35
    pos = [(hashed(k, a, b, m).cast("double") / F.lit(float(m)) * F.lit(BOX)).alias(c) for c, a, b, m in (("x", 7919, 17, 10007), ("y", 104729, 29, 10009), ("z", 15485863, 31, 10037))]
    vel = [(hashed(k, a, 7, 2001) - 1000).cast("double").alias(c) for c, a in (("vx", 611953), ("vy", 611957), ("vz", 611977))]
    merged = F.when(k % 17 == 0, k - k % 5 - 1).otherwise(F.lit(-1).cast("long"))
    return o.select(k.alias("id"), n.alias("n"), (n.cast("double") * F.lit(2.0e9)).alias("mass"), *pos, *vel, (k % 8).cast("int").alias("slab"), merged.alias("merged_to"), F.col("o_custkey").alias("owner"))


def moved(pid: Column) -> dict[str, Column]:
    """dx, dy, dz, v of a particle, by its pid."""
    out = {c: (hashed(pid, a, b, 2001) - 1000).cast("long") for c, a, b in (("dx", 31, 7), ("dy", 37, 11), ("dz", 41, 13))}
    return out | {"v": (hashed(pid, 43, 17, 4001) - 2000).cast("long")}


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """halo_id, pid, x, y, z (displacements of quantity and so on), weight, v of lineitem."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    price = F.round(F.col("l_extendedprice") * 100).cast("long")
    pid = F.col("l_partkey") * 1000003 + F.col("l_suppkey") * 101 + F.col("l_linenumber") + price % 997 * 1000000007
    return li.select(
        F.col("l_orderkey").alias("halo_id"), pid.alias("pid"), price.alias("price"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_quantity").cast("long").alias("weight"),
        *[x.alias(c) for c, x in moved(pid).items()],
    )


HALOS_SQL = """halos AS (SELECT o_orderkey AS id, floor(o_totalprice / 100)::BIGINT + 35 AS n, (floor(o_totalprice / 100)::BIGINT + 35)::DOUBLE * 2e9 AS mass,
  ((o_orderkey * 7919 + 17) % 10007)::DOUBLE / 10007::DOUBLE * 1000::DOUBLE AS x, ((o_orderkey * 104729 + 29) % 10009)::DOUBLE / 10009::DOUBLE * 1000::DOUBLE AS y,
  ((o_orderkey * 15485863 + 31) % 10037)::DOUBLE / 10037::DOUBLE * 1000::DOUBLE AS z,
  ((o_orderkey * 611953 + 7) % 2001 - 1000)::DOUBLE AS vx, ((o_orderkey * 611957 + 7) % 2001 - 1000)::DOUBLE AS vy, ((o_orderkey * 611977 + 7) % 2001 - 1000)::DOUBLE AS vz,
  (o_orderkey % 8)::INT AS slab, CASE WHEN o_orderkey % 17 = 0 THEN o_orderkey - o_orderkey % 5 - 1 ELSE -1 END AS merged_to, o_custkey AS owner FROM orders)"""
PARTICLES_SQL = """raw AS (SELECT l_orderkey AS halo_id, round(l_extendedprice * 100)::BIGINT AS price, l_linenumber::BIGINT AS line, l_quantity::BIGINT AS weight,
  l_partkey * 1000003 + l_suppkey * 101 + l_linenumber + round(l_extendedprice * 100)::BIGINT % 997 * 1000000007 AS pid FROM lineitem),
particles AS (SELECT halo_id, pid, price, line, weight, (pid * 31 + 7) % 2001 - 1000 AS dx, (pid * 37 + 11) % 2001 - 1000 AS dy, (pid * 41 + 13) % 2001 - 1000 AS dz,
  (pid * 43 + 17) % 4001 - 2000 AS v FROM raw)"""
