"""Sinks: binary column pipes, partitioned mocks, prepared subsamples."""

from __future__ import annotations

import contextlib
import json
import shutil
import struct
import tempfile
from collections.abc import Callable
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .layout import Files


def to_pipe(df: DataFrame, fields: list[str], out: BinaryIO, order: list[str] | None = None) -> int:
    """For each field: number of rows (int64), bytes per row (int32), then the values; the i-th values of all fields are of one row.

    The table is read once, by batches, in the order asked for (as it comes without one); each field's bytes wait in a
    temporary file of the driver until their turn.
    """
    if out.isatty():
        raise ValueError("not to a terminal")
    if bad := [f for f in fields if f not in df.columns]:
        raise KeyError(f"unknown fields: {bad}")
    kinds = dict(df.dtypes)
    types = [np.dtype({"int": "i4", "bigint": "i8", "float": "f4", "double": "f8"}[kinds[f].removeprefix("array<").rstrip(">")]) for f in fields]
    listed = [kinds[f].startswith("array<") for f in fields]

    def raw(batches):
        for b in batches:
            cols = [pa.array([np.asarray((b.column(i).flatten() if of else b.column(i)).to_numpy(zero_copy_only=False), t).tobytes()], pa.binary()) for i, (t, of) in enumerate(zip(types, listed, strict=True))]
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), *cols], ["n", *(f"f{i}" for i in range(len(fields)))])

    rows = (df.orderBy(*order) if order else df).select(*fields).mapInArrow(raw, ", ".join(["n long", *(f"f{i} binary" for i in range(len(fields)))]))
    n = 0
    with contextlib.ExitStack() as stack:
        spools = [stack.enter_context(tempfile.TemporaryFile()) for _ in fields]
        for row in rows.toLocalIterator(prefetchPartitions=True):
            n += row[0]
            for spool, part in zip(spools, row[1:], strict=True):
                spool.write(part)
        for spool, one in zip(spools, types, strict=True):
            out.write(struct.pack("<qi", n, spool.tell() // n if n else one.itemsize))
            spool.seek(0)
            shutil.copyfileobj(spool, out)
    return n


def write_mock(mock: DataFrame, path: str, rsd: bool = True, suffix: str = "", chunk: int | None = None, parameters: dict | None = None) -> str:
    """One Parquet directory a tracer, or a tracer and chunk; with parameters, a table beside them has these and the numbers of centrals and galaxies."""
    path = f"{path}{'_rsd' if rsd else ''}{suffix}"
    data = mock if chunk is None else mock.withColumn("chunk", F.lit(chunk))
    keys = ["tracer"] if chunk is None else ["tracer", "chunk"]
    data.write.mode("overwrite").option("partitionOverwriteMode", "static" if chunk is None else "dynamic").partitionBy(*keys).parquet(path)
    if parameters is not None:
        n = mock.groupBy("tracer").agg(F.count("*").alias("n"), F.sum(F.col("is_central").cast("long")).alias("n_cent"))
        n = n.withColumn("chunk", F.lit(chunk).cast("int")).withColumn("parameters", F.lit(json.dumps(parameters, sort_keys=True)))
        n.write.mode("overwrite" if chunk is None else "append").parquet(f"{path}.meta")
    return path


def read_mock(spark, path: str, tracer: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if tracer is None else df.where(F.col("tracer") == tracer)


def write_prepared(df: DataFrame, path: str, overwrite: bool = True) -> bool:
    """Slabs are replaced one by one; without overwrite, only those that are not there yet are written.  Says whether anything was."""
    if not overwrite and Files(df.sparkSession).exists(path):
        there = df.sparkSession.read.parquet(path).select("slab").distinct()
        df = df.join(F.broadcast(there), "slab", "left_anti")  # a catalog's slabs
        if df.isEmpty():
            return False
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slab").parquet(path)
    return True


def chunk_of(df: DataFrame, chunk: int, n_chunks: int, n_slabs: int) -> DataFrame:
    """The slabs of one of n_chunks parts: equal numbers of slabs, the last part may have fewer."""
    if not 0 <= chunk < n_chunks:
        raise ValueError("no such chunk")
    each = -(-n_slabs // n_chunks)
    return df.where((F.col("slab") >= chunk * each) & (F.col("slab") < (chunk + 1) * each))


def cached(spark: SparkSession, path: str, config: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path if it was made with this config; made and written if there is none; an error if the config differs."""
    text, files = json.dumps(config, sort_keys=True), Files(spark)
    if files.exists(f"{path}/config"):
        stored = spark.read.parquet(f"{path}/config").first().config
        if stored != text:
            raise ValueError(f"{path} was made with {stored}")
    else:
        make().write.mode("overwrite").parquet(f"{path}/data")
        # Written last: a table without it is not finished.
        spark.createDataFrame([(text,)], "config string").coalesce(1).write.mode("overwrite").parquet(f"{path}/config")
    return spark.read.parquet(f"{path}/data")


def append_samples(spark: SparkSession, path: str, names: list[str], rows: list[tuple], step: int) -> None:
    """Samples of a chain, appended step by step."""
    schema = "step int, " + ", ".join(f"{n} double" for n in names)
    spark.createDataFrame([(step, *map(float, r)) for r in rows], schema).coalesce(1).write.mode("append").parquet(path)


def write_correlation(xi: DataFrame, folder: str, simulation: str, redshift: float) -> str:
    """A correlation function under the name of its simulation and redshift."""
    path = f"{folder}/{simulation}-z{redshift:.3f}-cf"
    xi.write.mode("overwrite").parquet(path)
    return path


def read_displacement(spark: SparkSession, path: str, box: float) -> DataFrame:
    """ix, iy, iz, dx, dy, dz of a mesh of displacements, in units of the box."""
    return spark.read.parquet(path).select("ix", "iy", "iz", *[(F.col(f"d{a}") / box).alias(f"d{a}") for a in "xyz"])
