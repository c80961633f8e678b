"""Prepared tables stored by halo: buckets of the halo's id, so that halos meet their particles without a shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Particles of a bucket, from which the number of buckets follows; a task of a mock reads one bucket of each table.
BUCKET_ROWS = 4_000_000


@dataclass(frozen=True)
class Stored:
    """Two tables of the session's catalog with the same number of buckets."""

    halos: str
    particles: str
    buckets: int

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        return spark.table(self.halos), spark.table(self.particles)

    def drop(self, spark: SparkSession) -> None:
        for name in (self.halos, self.particles):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def store_by_halo(name: str, halos: DataFrame, particles: DataFrame, buckets: int | None = None, mode: str = "overwrite") -> Stored:
    """Tables <name>_halos (by id) and <name>_particles (by halo_id): one shuffle now, none in any mock made of them.

    Each bucket is one file, sorted by the halo, so a filter on the halo's id also skips row groups.  Without a number
    of buckets the particles are counted.
    """
    n = buckets or max(1, -(-particles.count() // BUCKET_ROWS))
    for df, kind, key in ((halos, "halos", "id"), (particles, "particles", "halo_id")):
        df.repartition(n, key).write.mode(mode).format("parquet").bucketBy(n, key).sortBy(key).saveAsTable(f"{name}_{kind}")
    return Stored(f"{name}_halos", f"{name}_particles", n)
