"""Whitening of embeddings: a covariance put together from tiles, its eigenvectors, projections to unit variance.

Entries become whole numbers first, so sums per dimension are exact.  Dimensions are cut into blocks of TILE.  A row block,
the rows of one Arrow batch, gives one column block for each block of dimensions; column blocks are shuffled by row block, each
pair of a row block's column blocks is multiplied, and the products are summed per tile, a pair of blocks of
dimensions.  A task holds one row block, whatever the number of rows; only the assembled covariance, dimensions squared, comes
to the driver, where it is decomposed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, session, table

#: Dimensions of a tile's side, and bytes of a row block.
TILE, BLOCK_BYTES = 32, 1 << 23
SCALE, SHIFT = 1024, 100_000
#: Entries beyond this size count as this: whole numbers up to it are doubles, so floor() keeps them.
MOST = 2**52


class Fit(NamedTuple):
    """n rows, their sums per dimension, and the leading eigenvectors (one a column) with their variances."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    variances: np.ndarray
    trace: float


def whole_vectors(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, dim, x: floor(SCALE * entry) + SHIFT of each entry of the vectors that are not null and hold no null or non-finite entry."""
    v = F.col(vector_col).cast("array<double>")
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("v is not null and forall(v, c -> coalesce(c - c = 0, false))")
    x = f"transform(v, c -> cast(floor(greatest(least({SCALE} * c, {MOST}D), -{MOST}D)) as long) + {SHIFT})"
    return rows.select("vec_id", F.size("v").alias("dim"), F.expr(x).alias("x"))


def _rows(t: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each length of the batch's vectors, the rows that have it and their entries."""
    x = t.column(t.schema.get_field_index("x"))
    flat, starts = x.values.to_numpy(zero_copy_only=False), np.asarray(x.offsets)[:-1]
    dims = t.column(t.schema.get_field_index("dim")).to_numpy()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        yield int(dim), at, flat[starts[at][:, None] + np.arange(dim)]


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: in 64 bits, or as Python's integers where these could pass them."""
    if n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in sums), default=0) < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (_deviations(x, n, sums) / n).astype(np.float64)


def _column_blocks(n_sums: dict[int, tuple[int, list[int]]], tile: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        for t in batches:
            for dim, _, x in _rows(t):
                step = max(1, BLOCK_BYTES // (8 * dim))
                for lo in range(0, len(x), step):
                    z = _centred(x[lo : lo + step], *n_sums[dim])
                    cols = [np.ascontiguousarray(z[:, c : c + tile]).tobytes() for c in range(0, dim, tile)]
                    m = len(cols)
                    yield pa.RecordBatch.from_arrays([pa.array([part << 32 | k] * m, pa.int64()), pa.array([dim] * m, pa.int32()), pa.array(range(m), pa.int32()), pa.array([len(z)] * m, pa.int32()), pa.array(cols, pa.binary())], ["row_block", "dim", "col_block", "rows", "z"])
                    k += 1

    return run


def _tiles(t: pa.Table) -> pa.Table:
    """Products of the pairs of one row block's column blocks: first dimensions of the tile's sides, its entries."""
    cols = sorted(zip(t.column("col_block").to_pylist(), t.column("z").to_pylist(), strict=True))
    n, dim = t.column("rows")[0].as_py(), t.column("dim")[0].as_py()
    blocks = [np.frombuffer(z).reshape(n, -1) for _, z in cols]
    i, j, out = [], [], []
    for a in range(len(blocks)):
        for b in range(a, len(blocks)):
            i.append(a)
            j.append(b)
            out.append((blocks[a].T @ blocks[b]).ravel())
    return pa.table({"dim": pa.array([dim] * len(i), pa.int32()), "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "products": pa.array(out, pa.list_(pa.float64()))})


def covariance_tiles(rows: DataFrame, n_sums: dict[int, tuple[int, list[int]]], tile: int = TILE) -> DataFrame:
    """dim, i, j, products: the sum over all rows of the centred rows' products, one row for each tile (i, j), i <= j, its entries row by row."""
    blocks = rows.where("dim > 0").mapInArrow(_column_blocks(n_sums, tile), "row_block long, dim int, col_block int, rows int, z binary")
    parts = blocks.groupBy("row_block").applyInArrow(_tiles, "dim int, i int, j int, products array<double>")
    entries = parts.select("dim", "i", "j", F.posexplode("products").alias("at", "product")).groupBy("dim", "i", "j", "at").agg(F.sum("product").alias("product"))
    tiles = entries.groupBy("dim", "i", "j").agg(F.array_sort(F.collect_list(F.struct("at", "product"))).alias("entries"))  # tile squared
    return tiles.select("dim", "i", "j", F.col("entries.product").alias("products"))


def fit(rows: DataFrame, components: int = 8, tile: int = TILE) -> dict[int, Fit]:
    """The fit of each length of vectors in whole_vectors(): lengths are spaces of their own, few in a table of embeddings."""
    sums = rows.select("dim", F.posexplode("x").alias("at", "x")).groupBy("dim", "at").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(20,0)")).alias("s"))
    n_sums: dict[int, tuple[int, list[int]]] = {}
    for r in sorted(sums.collect()):  # one row for each dimension
        n_sums.setdefault(r.dim, (r.n, []))[1].append(int(r.s))
    cov = {d: np.zeros((d, d)) for d in n_sums}
    for r in covariance_tiles(rows, n_sums, tile).toLocalIterator():  # dimensions squared
        a, b = r.i * tile, r.j * tile
        block = np.array(r.products).reshape(min(tile, r.dim - a), -1) / n_sums[r.dim][0]
        cov[r.dim][a : a + tile, b : b + tile] = block
        cov[r.dim][b : b + tile, a : a + tile] = block.T
    out = {}
    for d, (n, s) in n_sums.items():
        e, v = np.linalg.eigh(cov[d])
        k = min(components, d)
        v = v[:, ::-1][:, :k]
        v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(k)] < 0, -1.0, 1.0)
        out[d] = Fit(n, s, v, np.maximum(e[::-1][:k], 0.0), float(np.trace(cov[d])))
    return out


def project(rows: DataFrame, fits: dict[int, Fit]) -> DataFrame:
    """vec_id, dim, deviation, w: the rows' squared deviations from the mean (decimal, exact) and whitened components.

    A direction without variance (under a 10**-12th of all) has 0 for each row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            ids = t.column(t.schema.get_field_index("vec_id"))
            for dim, at, x in _rows(t):
                f = fits[dim]
                d = _deviations(x, f.n, f.sums)
                if d.dtype != object and dim * int(np.abs(d).max(initial=0)) ** 2 >= 2**63:
                    d = d.astype(object)
                square = [int(s) for s in (d * d).sum(axis=1)]
                there = f.variances > 1e-12 * f.trace
                w = (d / f.n).astype(np.float64) @ f.vectors * np.where(there, 1 / np.sqrt(np.where(there, f.variances, 1.0)), 0.0)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array([dim] * len(at), pa.int32()), pa.array([str(s) for s in square]), pa.array(list(w), pa.list_(pa.float64()))], ["vec_id", "dim", "deviation", "w"])

    out = rows.where("dim > 0").mapInArrow(run, "vec_id long, dim int, deviation string, w array<double>")
    return out.withColumn("deviation", F.expr("try_cast(deviation as decimal(38,0))"))


def identity_errors(projected: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """Largest absolute difference between the covariance of the whitened components, over all rows, and the identity, by length."""
    out = {}
    k = max((len(f.variances) for f in fits.values()), default=0)
    if not k:
        return out
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    at = lambda i: F.get("w", F.lit(i))
    for r in projected.groupBy("dim").agg(*[F.covar_pop(at(i), at(j)).alias(f"c{i}_{j}") for i, j in pairs]).collect():
        out[r.dim] = max(abs(r[f"c{i}_{j}"] - (i == j)) for i, j in pairs if j < len(fits[r.dim].variances))
    return out


def whiten(embeddings: DataFrame, components: int = 8, tile: int = TILE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each kept vector and component.

    Vectors that are null or hold null or non-finite entries are dropped; empty ones have no components.  Vectors of different
    lengths are fitted apart.  Null ids and rows that repeat an id are rows like any others; other columns are ignored.
    deviation is decimal(38, 0), null if it would not fit.
    """
    session(embeddings.sparkSession)
    rows = whole_vectors(embeddings, id_col, vector_col)
    fits = fit(rows, components, tile)
    projected = Scratch(embeddings.sparkSession).write(project(rows, fits))
    error = identity_errors(projected, fits)
    each = [(d, i + 1, f.n, float(e / f.trace) if f.trace else 0.0, error.get(d, 0.0)) for d, f in fits.items() for i, e in enumerate(f.variances)]
    facts = embeddings.sparkSession.createDataFrame(each, "dim int, component int, n long, explained double, identity_error double")
    out = projected.select("vec_id", "dim", "deviation", F.posexplode("w").alias("at", "whitened")).withColumn("component", F.col("at") + 1)
    out = out.join(F.broadcast(facts), ["dim", "component"])  # `components` rows for each length
    return out.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def op11_embedding_whitening(spark, sf_dir):
    """The contract's query; a deviation beyond a long is null."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation as long)"))
