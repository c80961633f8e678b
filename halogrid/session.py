"""Session defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "halogrid", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; conf keys use _ for dots."""
    b = SparkSession.builder.appName(app)
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    }
    for k, v in (base | {k.replace("_", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; only a local master may go without."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (top or "/tmp/halogrid-checkpoints").rstrip("/")


#: Rows of a partition of dealt().
DEALT_ROWS = 100_000


def dealt(key: str, most: DataFrame, *others: DataFrame) -> list[DataFrame]:
    """The frames dealt by a hash of one key, all into as many partitions as give some DEALT_ROWS rows of the first to each, so that a task's memory doesn't grow with the table."""
    n = max(most.sparkSession.sparkContext.defaultParallelism, -(-most.count() // DEALT_ROWS))
    return [df.repartition(n, key) for df in (most, *others)]


def checkpointed(df: DataFrame) -> DataFrame:
    """df as rows in the shared folder: what reads it several times runs it once, and a lost executor takes nothing along."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
