"""Approximate nearest neighbours by collision counting over single-projection sorted arrays.

Vectors are dealt to blocks by a hash of their row.  In a block every random projection is a sorted array, cut at
equal ranks into buckets; a query opens a window of buckets around its own projection in each array, and a vector
collides as often as it stands in a window.  Virtual rehashing widens all windows by `growth` until enough vectors
collide in the threshold's share of the projections, and all of those are verified by the exact inner product.

Windows are bitmaps over the block's rows: the rows below a bucket's edge are one bitmap, two of which give a window,
and the collisions of 64 rows are counted at once by adding bitmaps in carry-save form, so that a query costs some
six word operations for 64 rows and a projection.  For the largest inner product vectors get one more coordinate that
makes all of one length, so that the nearest are those with the largest product.

Stated queries against all rows, in blocks: a task has one block and one portion of the queries, both bounded, and
returns the best k of each query there; a window over those few rows makes the final ranks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, session, table

_U = np.uint64
#: Rows of a block, the unit that is indexed: some 25 MB of bitmaps; and queries that one task has for it.
BLOCK, PORTION = 8192, 16384
#: Buckets of a sorted array, and queries that are counted together.
BUCKETS, TOGETHER = 64, 16
#: Bitmaps that are added in one go: they stay in the CPU cache.
ADDED = 31


def counted(words: list[np.ndarray]) -> list[np.ndarray]:
    """Bit planes, least first, of how many of these bitmaps have each bit: a tree of full adders."""
    planes, level = [], words
    while level:
        carries = []
        while len(level) > 1:
            if len(level) == 2:
                a, b = level
                level = [a ^ b]
                carries.append(a & b)
            else:
                out = []
                for i in range(0, len(level) - 2, 3):
                    a, b, c = level[i : i + 3]
                    x = a ^ b
                    out.append(x ^ c)
                    carries.append((a & b) | (x & c))
                level = out + level[len(level) - len(level) % 3 :]
        planes.append(level[0])
        level = carries
    return planes


def added(x: list[np.ndarray], y: list[np.ndarray]) -> list[np.ndarray]:
    """Sum of two counts in bit planes."""
    if len(x) < len(y):
        x, y = y, x
    out, carry = [], None
    for i, a in enumerate(x):
        b = y[i] if i < len(y) else None
        if b is None and carry is None:
            out.append(a)
        elif b is None or carry is None:
            c = carry if b is None else b
            out.append(a ^ c)
            carry = a & c
        else:
            t = a ^ b
            out.append(t ^ carry)
            carry = (a & b) | (t & carry)
    return out if carry is None else [*out, carry]


def at_least(planes: list[np.ndarray], least: int) -> np.ndarray:
    """Bitmap of the bits whose count is at least this."""
    if least >= 1 << len(planes):
        return np.zeros_like(planes[0])
    more, same = np.zeros_like(planes[0]), np.full_like(planes[0], ~_U(0))
    for i in range(len(planes) - 1, -1, -1):
        if least >> i & 1:
            same &= planes[i]
        else:
            more |= same & planes[i]
            same &= ~planes[i]
    return more | same


class Block:
    """Sorted projections of some vectors of one length, as bitmaps of the rows below each bucket's edge."""

    def __init__(self, vectors: np.ndarray, radius: float, projections: int, seed: int = 7):
        self.vectors, n = vectors, len(vectors)
        rest = np.sqrt(np.maximum(radius**2 - (vectors**2).sum(1), 0))
        self.axes = np.random.default_rng(seed).normal(size=(vectors.shape[1] + 1, projections))
        p = vectors @ self.axes[:-1] + rest[:, None] * self.axes[-1]
        self.spread = float(p.std()) or 1.0
        edge = np.linspace(0, n, BUCKETS + 1).astype(np.int64)
        words = -(-n // 64)
        self.edges = np.empty((projections, BUCKETS - 1))
        self.below = np.zeros((projections, BUCKETS + 1, words), _U)
        bucket = np.repeat(np.arange(BUCKETS), np.diff(edge))
        for j in range(projections):
            order = np.argsort(p[:, j], kind="stable")
            self.edges[j] = p[order[np.minimum(edge[1:-1], n - 1)], j]
            bits = np.zeros((BUCKETS, words * 64), np.uint8)
            bits[bucket, order] = 1
            np.bitwise_or.accumulate(np.packbits(bits, axis=1, bitorder="little").view(_U), axis=0, out=self.below[j, 1:])

    def candidates(self, queries: np.ndarray, least: int, collisions: float, growth: float, start: float):
        """(query, rows): the rows that collide in at least this share of the projections, once there are `least` of them."""
        m, _, words = self.below.shape
        n = len(self.vectors)
        if n <= least:
            for i in range(len(queries)):
                yield i, np.arange(n)
            return
        q = queries @ self.axes[:-1]
        threshold = max(1, round(collisions * m))
        widest = 2 * float(np.abs(self.edges).max() + np.abs(q).max())
        for lo in range(0, len(q), TOGETHER):
            open_ = np.arange(lo, min(lo + TOGETHER, len(q)))
            width = start * self.spread
            while len(open_):
                planes = []
                for at in range(0, m, ADDED):
                    windows = []
                    for j in range(at, min(at + ADDED, m)):
                        a = np.searchsorted(self.edges[j], q[open_, j] - width, "right")
                        b = np.searchsorted(self.edges[j], q[open_, j] + width, "right") + 1
                        windows.append(self.below[j, a] ^ self.below[j, b])
                    planes = added(planes, counted(windows))
                met = at_least(planes, threshold)
                enough = np.bitwise_count(met).sum(1) >= least
                for i, row in zip(open_[enough], met[enough], strict=True):
                    yield i, np.flatnonzero(np.unpackbits(row.view(np.uint8), count=n, bitorder="little"))
                open_ = open_[~enough]
                if width > widest:  # every window holds everything
                    for i in open_:
                        yield i, np.arange(n)
                    break
                width *= growth


def _valid(embeddings: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    df = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    ok = "vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> coalesce(x - x = 0, false)) and exists(v, x -> x <> 0)"
    return df.where(ok).select(F.monotonically_increasing_id().alias("row"), "vec_id", F.size("v").alias("dim"), "v")


def _matrix(t: pa.Table, name: str = "v") -> np.ndarray:
    v = t.column(name).combine_chunks()
    return v.values.to_numpy(zero_copy_only=False)[v.offsets[0].as_py() : v.offsets[len(v)].as_py()].reshape(len(v), -1)


def _search(k: int, projections: int, verified: int, collisions: float, growth: float, start: float):
    """Best k of each query of a portion over a block's rows."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if len(rows) and len(queries):
            row, ids, x = rows.column("row").to_numpy(), rows.column("vec_id").to_numpy(), _matrix(rows)
            mine, mine_id, q = queries.column("q_row").to_numpy(), queries.column("q_vec_id").to_numpy(), _matrix(queries, "q_v")
            one = rows.slice(0, 1).to_pylist()[0]
            least = max(2 * k, -(-verified * len(x) // one["total"]))
            for i, found in Block(x, one["radius"], projections).candidates(q, least, collisions, growth, start):
                found = found[row[found] != mine[i]]
                score = (x[found] * q[i]).sum(axis=1)
                if len(score) > k:
                    keep = score >= np.partition(score, len(score) - k)[len(score) - k]
                    score, found = score[keep], found[keep]
                top = np.lexsort((ids[found], -score))[:k]
                for c, v in zip(out, (np.full(len(top), mine[i]), np.full(len(top), mine_id[i]), ids[found[top]], score[top]), strict=True):
                    c.append(v)
        cols = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table({n: pa.array(c.astype(t)) for n, c, t in zip(("query", "query_id", "vec_id", "score"), cols, (np.int64, np.int64, np.int64, np.float64), strict=True)})

    return run


def nearest(
    embeddings: DataFrame,
    k: int = 20,
    modulus: int = 20,
    projections: int = 224,
    verified: int = 800,
    collisions: float = 0.72,
    growth: float = 1.08,
    start: float = 1.15,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k vectors found with the largest inner product with each query.

    Queries are the rows whose id is divisible by modulus; candidates are all other rows.  Ties go to the smaller vec_id.
    Vectors that are null, empty, zero or hold null or non-finite components, and null ids, take no part.  Rows that
    repeat an id are rows like any others: each is a candidate, and each that is a query has its own ranks.  Vectors of
    different lengths are never compared; other columns are ignored.  A query verifies at least `verified` vectors of
    all blocks together (at least 2 * k of each), and every one that collides as often as these: a table of up to
    that many vectors is verified whole.
    """
    spark = session(embeddings.sparkSession)
    scratch = Scratch(spark)
    rows = scratch.write(_valid(embeddings, id_col, vector_col))
    # One row for each length of vectors.
    lengths = rows.groupBy("dim").agg(F.count("*").alias("total"), F.max(F.expr("sqrt(aggregate(v, 0D, (s, x) -> s + x * x))")).alias("radius"), F.sum((F.col("vec_id") % modulus == 0).cast("long")).alias("asked"))
    lengths = scratch.write(lengths.where("asked > 0").select("*", F.ceil(F.col("total") / BLOCK).alias("blocks"), F.ceil(F.col("asked") / PORTION).alias("portions")).drop("asked"))
    rows = rows.join(lengths, "dim")
    part = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    blocks = rows.select("dim", "row", "vec_id", "v", "total", "radius", part("blocks").alias("block"), every("portions").alias("portion"))
    queries = rows.where(F.col("vec_id") % modulus == 0).withColumn("portion", F.pmod(F.xxhash64("row", F.lit(1)), F.col("portions")).cast("int")).withColumn("block", every("blocks"))
    queries = queries.select(*[F.col(c).alias(f"q_{c}") for c in ("dim", "block", "portion", "row", "vec_id", "v")])
    found = blocks.groupBy("dim", "block", "portion").cogroup(queries.groupBy("q_dim", "q_block", "q_portion")).applyInArrow(_search(k, projections, verified, collisions, growth, start), "query long, query_id long, vec_id long, score double")
    w = W.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest_neighbours(spark, sf_dir):
    """The contract's query: 20 nearest of every twentieth embedding."""
    return nearest(table(spark, sf_dir, "embeddings"))
