"""Files of fixed-length binary records as a data source: ranges of bytes that meet record borders, a writer with commit.

    register(spark)
    spark.read.format("halogrid.records").option("kind", "rvint").load(folder)
    df.write.format("halogrid.records").option("kind", "rvint").mode("append").save(folder)

Kinds: rvint (three packed words of position and velocity), packedpid (one packed id), pack9 (nine bytes; a record that begins
with 0xFF is the header of the cells that follow, and each other record comes with its header, so that it can be
decoded wherever a range begins).  Words stay packed: functions.decode turns them into columns in generated code.  The option
fields names the columns to make, splitBytes the size of a range (longer where there would be over MOST_RANGES of them).  Files are opened through pyarrow's file systems, so a
path may be a URI of a store that these reach.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Fields of each kind and their types in the file, little-endian (fixed values of the formats).
LAYOUTS = {
    "rvint": (("rv_x", "<i4"), ("rv_y", "<i4"), ("rv_z", "<i4")),
    "packedpid": (("packedpid", "<i8"),),
    "pack9": (("record", "V9"),),
}
SQL_TYPES = {"<i4": "int", "<i8": "long", "V9": "binary"}
HEADER = 0xFF
#: Bytes of a range, records of a batch, and records that a range looks back at a time for its header.
SPLIT_BYTES, BATCH, LOOK_BACK = 64 << 20, 1 << 16, 1 << 12
#: Ranges that large files are read in, not counting that each file begins one: more only cost starts of tasks.
MOST_RANGES = 1000


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return fs.LocalFileSystem(), path


@dataclass
class Range(InputPartition):
    path: str
    start: int  # in records, and so is count
    count: int
    first: int  # records of the files before


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


def _dtype(kind: str) -> np.dtype:
    if kind not in LAYOUTS:
        raise ValueError(f"kind must be one of {sorted(LAYOUTS)}")
    return np.dtype(list(LAYOUTS[kind]))


class Records(DataSource):
    @classmethod
    def name(cls) -> str:
        return "halogrid.records"

    def schema(self) -> str:
        kind = self.options.get("kind", "")
        _dtype(kind)
        cols = {n: SQL_TYPES[t] for n, t in LAYOUTS[kind]} | ({"header": "binary"} if kind == "pack9" else {}) | {"row": "long"}
        asked = [f.strip() for f in self.options.get("fields", "").split(",") if f.strip()] or list(cols)
        if bad := [f for f in asked if f not in cols]:
            raise ValueError(f"unknown fields: {bad}")
        return ", ".join(f"{f} {cols[f]}" for f in asked)

    def reader(self, schema) -> RecordReader:
        return RecordReader(dict(self.options), schema.names)

    def writer(self, schema, overwrite: bool) -> RecordWriter:
        return RecordWriter(dict(self.options), schema.names, overwrite)


class RecordReader(DataSourceReader):
    def __init__(self, options: dict[str, str], names: list[str]):
        self.path, self.kind, self.names = options["path"], options["kind"], names
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))

    def partitions(self) -> list[Range]:
        """Ranges of whole records of the path's files, in the order of their names; an error for a file that ends inside a record."""
        store, path = _open(self.path)
        top = store.get_file_info(path)
        if top.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [top] if top.is_file else sorted((f for f in store.get_file_info(fs.FileSelector(path)) if f.is_file and f.base_name[0] not in "._"), key=lambda f: f.base_name)
        size, first, out = _dtype(self.kind).itemsize, 0, []
        step = max(1, self.split // size, -(-sum(f.size for f in files) // size // MOST_RANGES))
        for f in files:
            n, rest = divmod(f.size, size)
            if rest:
                raise ValueError(f"{f.path} ends inside a record of {size} bytes")
            out += [Range(f.path, s, min(step, n - s), first) for s in range(0, n, step)]
            first += n
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        store, _ = _open(self.path)
        kind = _dtype(self.kind)
        with store.open_input_file(partition.path) as f:
            header = self._header(f, partition.start) if self.kind == "pack9" else None
            for s in range(partition.start, partition.start + partition.count, BATCH):
                n = min(BATCH, partition.start + partition.count - s)
                a = np.frombuffer(f.read_at(n * kind.itemsize, s * kind.itemsize), kind)
                cols = {c: a[c] for c in kind.names} | {"row": np.arange(partition.first + s, partition.first + s + n)}
                if header is not None:
                    raw = a["record"].tolist()
                    keep, headers = [], []
                    for i, r in enumerate(raw):
                        if r[0] == HEADER:
                            header = r
                        else:
                            keep.append(i)
                            headers.append(header)
                    cols = {"record": pa.array([raw[i] for i in keep], pa.binary()), "header": pa.array(headers, pa.binary()), "row": cols["row"][keep]}
                yield pa.RecordBatch.from_arrays([pa.array(cols[c]) for c in self.names], names=self.names)

    @staticmethod
    def _header(f: pa.NativeFile, start: int) -> bytes:
        """The last header before a record; empty if there is none."""
        while start > 0:
            n = min(LOOK_BACK, start)
            raw = f.read_at(9 * n, 9 * (start - n))
            for i in range(n - 1, -1, -1):
                if raw[9 * i] == HEADER:
                    return raw[9 * i : 9 * i + 9]
            start -= n
        return b""


class RecordWriter(DataSourceArrowWriter):
    """Each task writes a file under a hidden name; commit gives the files of the tasks that counted their names, abort removes all."""

    def __init__(self, options: dict[str, str], names: list[str], overwrite: bool):
        self.path, self.kind, self.overwrite = options["path"], options["kind"], overwrite
        if missing := [n for n in _dtype(self.kind).names if n not in names]:
            raise ValueError(f"fields are missing: {missing}")
        self.job = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, top = _open(self.path)
        context, kind = TaskContext.get(), _dtype(self.kind)
        name, rows = f"{context.partitionId():06d}-{context.taskAttemptId()}", 0
        store.create_dir(f"{top}/{self.job}", recursive=True)
        with store.open_output_stream(f"{top}/{self.job}/{name}") as out:
            for batch in iterator:
                a = np.empty(len(batch), kind)
                for c in kind.names:
                    col = batch.column(batch.schema.get_field_index(c))
                    if col.null_count:
                        raise ValueError(f"{c} is null in a row")
                    if self.kind == "pack9":
                        raw = col.to_pylist()
                        if any(len(r) != 9 for r in raw):
                            raise ValueError("a record of pack9 has nine bytes")
                        a = np.frombuffer(b"".join(raw), kind)
                    else:
                        a[c] = col.to_numpy()
                out.write(a.tobytes())
                rows += len(batch)
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        store, top = _open(self.path)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(top)):
                if f.is_file and f.base_name[0] not in "._":
                    store.delete_file(f.path)
        for m in messages:
            if m is not None and m.rows:
                store.move(f"{top}/{self.job}/{m.name}", f"{top}/{PurePosixPath(m.name).name}-{self.job[9:17]}.bin")
        self._clear(store, top)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*_open(self.path))

    def _clear(self, store: fs.FileSystem, top: str) -> None:
        if store.get_file_info(f"{top}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{top}/{self.job}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Records)


def read_records(spark: SparkSession, path: str, kind: str, fields: list[str] | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of a file, or of a folder's files in the order of their names; row numbers them over all files."""
    register(spark)
    r = spark.read.format(Records.name()).option("kind", kind).option("splitBytes", str(split_bytes))
    return (r.option("fields", ",".join(fields)) if fields else r).load(path)


def write_records(df: DataFrame, path: str, kind: str, mode: str = "append") -> None:
    """Rows go to a file for each task, in the task's order; a failed write leaves no file."""
    register(df.sparkSession)
    df.write.format(Records.name()).option("kind", kind).mode(mode).save(path)
