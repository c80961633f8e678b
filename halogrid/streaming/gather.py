"""Headers of simulations gathered from files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "sim string, redshift string, param map<string,string>, state map<string,string>"


def gather_headers(spark: SparkSession, source: str, target: str, checkpoint: str, files_at_once: int = 1000) -> int:
    """Add the header files (JSON lines of SCHEMA) under source that are new since the last call to the table at target; number of rows added.

    The stream's checkpoint knows the files that are done.  Each batch replaces the folder of its own number, so a batch that
    runs again after a failure is there once.
    """
    added = []

    def keep(rows: DataFrame, number: int) -> None:
        rows = rows.where("sim is not null and redshift is not null").withColumn("at", F.monotonically_increasing_id())
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")
        added.append(spark.read.parquet(f"{target}/batch={number}").count())

    headers = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_at_once).option("recursiveFileLookup", "true").json(source)
    headers.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return sum(added)


def gathered(spark: SparkSession, target: str) -> DataFrame:
    """sim, redshift, param, state: one row for each simulation and redshift; of several headers the keys of later batches win."""
    rows = spark.read.schema(f"{SCHEMA}, at long, batch int").parquet(target)
    entries = {n: F.coalesce(F.map_entries(n), F.array().cast("array<struct<key:string,value:string>>")).alias(n) for n in ("param", "state")}
    order = F.array_sort(F.collect_list(F.struct("batch", "at", *entries.values())))  # a header comes once, or a few times when it is renewed

    def merged(name: str):
        start = F.create_map().cast("map<string,string>")
        return F.aggregate(F.flatten(f"all.{name}"), start, lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_entries(F.array(e)))).alias(name)

    return rows.groupBy("sim", "redshift").agg(order.alias("all")).select("sim", "redshift", merged("param"), merged("state"))
