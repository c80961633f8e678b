"""Ranks inside bins and groups, prefix sums, top-k."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType, StringType, StructType

#: Rows of the sample that sets the bounds of ordered_index, for each shuffle partition and at most.
SAMPLE_ROWS, MOST_SAMPLED = 64, 1 << 16


#: Bounds of ordered_buckets that are a literal of the plan; more are joined as one row.
LITERAL_BOUNDS = 512

#: Edges up to which a search is a tree of comparisons in generated code; more are searched in an array.
TREE_EDGES = 64


def searchsorted(x: Column, edges: list[float], side: str = "left") -> Column:
    """Number of edges (rising) below x, with side right also those equal to it, in about log2(edges) comparisons; null for a null x, all for NaN."""
    edges = [float(e) for e in edges]
    before = (lambda e: e <= x) if side == "right" else (lambda e: e < x)
    if len(edges) <= TREE_EDGES:

        def tree(lo: int, hi: int) -> Column:
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(before(F.lit(edges[mid])), tree(mid + 1, hi)).otherwise(tree(lo, mid))

        return F.when(x.isNotNull(), tree(0, len(edges)))
    steps = F.lit([1 << i for i in range(len(edges).bit_length() - 1, -1, -1)])

    def search(all_):
        # The answer is put together from its highest bit on: a step is taken if the edge before the place it leads to counts.
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(before(F.get(all_, at + step - 1)), F.lit(False)), at + step).otherwise(at))

    edges_once = F.expr("array(array(" + ", ".join(f"{e!r}D" for e in edges) + "))")  # one literal, bound to a name
    return F.when(x.isNotNull(), F.transform(edges_once, search)[0])


def bin_index(x: Column, edges: list[float], rule: str = "open") -> Column:
    """Index of the bin of x, or null.

    open: lo < x < hi (mass ranks).  left: lo <= x < hi, the last closed (histograms).  half: the same, the last half-open.
    right: lo < x <= hi, the first closed, nothing at or over the last edge (mode bins).
    """
    first, last, bins = F.lit(float(edges[0])), F.lit(float(edges[-1])), len(edges) - 1
    at = searchsorted(x, edges, "left" if rule == "right" else "right") - 1
    if rule == "open":
        return F.when((x > first) & (x < last) & (at == searchsorted(x, edges, "left") - 1), at)
    if rule == "right":
        return F.when((x >= first) & (x < last), F.greatest(at, F.lit(0)))
    inside = (x >= first) & (x < last)
    return F.when(inside, at).when(x == last, F.lit(bins - 1)) if rule == "left" else F.when(inside, at)


def rank_in_bins(df: DataFrame, value: str, mass: str, edges: list[float], key: str, out: str = "rank") -> DataFrame:
    """rank / (n - 1) - 0.5 of value among the rows of one mass bin; 0 for lone rows and outside the bins or on an edge.

    Bins are few and large, so a window over a bin would be one task: rows are range-partitioned by (bin, value, key), get
    their place in their partition, and the partitions' counts, few rows, give the places before them.
    """
    d = df.withColumn("_bin", bin_index(F.col(mass), edges))
    ranked = ordered_index(d.where("_bin is not null"), ["_bin", value, key], by="_bin")
    n = d.where("_bin is not null").groupBy("_bin").agg(F.count("*").alias("_n"))
    ranked = ranked.join(F.broadcast(n), "_bin").withColumn(out, F.when(F.col("_n") > 1, F.col("_index") / (F.col("_n") - 1) - 0.5).otherwise(0.0))
    return ranked.drop("_n", "_index").unionByName(d.where("_bin is null").withColumn(out, F.lit(0.0))).drop("_bin")


def _bounds(df: DataFrame, order: list[str], parts: int) -> tuple[list, StructType]:
    """Rows that cut df, in this order, into about so many parts: a sample by hash, brought to the driver once."""
    most = min(SAMPLE_ROWS * parts, MOST_SAMPLED)
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(order)]
    sample = df.select(*keys, F.xxhash64(*order).alias("h")).orderBy("h").limit(most).drop("h")
    rows = sample.orderBy(*sample.columns).collect()
    at = sorted({len(rows) * i // parts for i in range(1, parts)} - {0})
    return [rows[i] for i in at], sample.schema


def ordered_buckets(df: DataFrame, order: list[str], out: str = "_part", finer: int = 1) -> DataFrame:
    """df with its bucket in this order: an int that never falls as the order rises, of about `finer` values a shuffle partition.

    A row's bucket is the number of the sampled bounds that do not exceed it, a column like any other, so nothing rests on
    which partition a row falls into.  A few bounds are a literal, in which a row finds its place by halving; many are a
    joined row, with two levels of comparison: a row meets about twice the root of their number.  Rows that are equal in
    the order share a bucket.
    """
    found, schema = _bounds(df, order, finer * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if not found:
        return df.withColumn(out, F.lit(0))
    if len(found) <= LITERAL_BOUNDS and all(isinstance(f.dataType, (NumericType, StringType)) for f in schema):
        return df.withColumn(out, _not_above(found, schema, order))
    step = math.isqrt(len(found)) + 1
    low = [found[i : i + step] for i in range(0, len(found), step)]
    kind = schema.simpleString()
    one = df.sparkSession.createDataFrame([([b[0] for b in low], low)], f"_tops array<{kind}>, _low array<array<{kind}>>")
    r = df.crossJoin(F.broadcast(one))  # one row, MOST_SAMPLED bounds at most
    me = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])
    top = F.size(F.filter("_tops", lambda b: b <= me))
    inner = F.when(top > 0, F.size(F.filter(F.element_at("_low", F.greatest(top, F.lit(1))), lambda b: b <= me))).otherwise(0)
    return r.withColumn(out, F.greatest(top - 1, F.lit(0)) * step + inner).drop("_tops", "_low")


def _not_above(found: list, schema: StructType, order: list[str]) -> Column:
    """Number of the bounds (rising) that do not exceed a row in this order; the row's values are made once, not for each comparison."""
    text = json.dumps([b.asDict() for b in found], default=str)  # one small expression, made a literal before rows are read
    bounds = F.from_json(F.lit(text), ArrayType(schema))
    me = F.struct(*[F.col(c).alias(f.name) for c, f in zip(order, schema, strict=True)])
    steps = F.lit([1 << i for i in range(len(found).bit_length() - 1, -1, -1)])

    def search(s):
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(s["bounds"], at + step - 1) <= s["me"], F.lit(False)), at + step).otherwise(at))

    return F.transform(F.array(F.struct(bounds.alias("bounds"), me.alias("me"))), search)[0]


def ordered_index(df: DataFrame, order: list[str], by: str | None = None, weight: str | None = None, out: str = "_index") -> DataFrame:
    """Global row number from 0 (or exclusive prefix sum of weight) in this order, inside each group `by`, without one-task windows.

    The order must be unique for a defined result.  Rows are numbered inside (bucket, group), and the sums of the buckets, few
    rows, give what comes before them.
    """
    keys = [by] if by else []
    r = ordered_buckets(df, order)
    w = W.partitionBy("_part", *keys).orderBy(*order)
    x = F.col(weight) if weight else F.lit(1)
    zero = F.lit(0).cast("long")
    total = r.groupBy("_part", *keys).agg(F.sum(x).alias("_sum"))
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # as many rows as buckets
    total = total.withColumn("_before", F.coalesce(F.sum("_sum").over(before), zero)).drop("_sum")
    r = r.withColumn("_local", F.coalesce(F.sum(x).over(w.rowsBetween(W.unboundedPreceding, -1)), zero))
    return r.join(total, ["_part", *keys]).withColumn(out, F.col("_local") + F.col("_before")).drop("_part", "_local", "_before")


def prefix_sum(df: DataFrame, value: str, order: list[str], out: str, initial: bool = True, offset: int = 0) -> DataFrame:
    """Exclusive (initial) or inclusive prefix sum of value in this order, plus offset."""
    r = ordered_index(df, order, weight=value, out=out)
    return r.withColumn(out, F.col(out) + F.lit(offset) + (F.lit(0) if initial else F.col(value)))


def group_rank(df: DataFrame, group: str, value: str, key: list[str], out: str) -> DataFrame:
    """2 * rank / (n - 1) - 1 of value inside a group (a halo's particles); 0 for a lone row."""
    w = W.partitionBy(group)
    place = F.row_number().over(w.orderBy(value, *key)) - 1
    n = F.count("*").over(w)
    return df.withColumn(out, F.when(n > 1, 2.0 * place / (n - 1) - 1.0).otherwise(0.0))


def top_n(df: DataFrame, value: str, key: str, n: int) -> DataFrame:
    return df.orderBy(F.col(value).desc(), key).limit(n)


def perihelion(v_tan2: Column, v_rad2: Column, r0: Column, rs: Column, alpha: Column, steps: int = 20) -> Column:
    """Squared ratio of the perihelion to the radius of an orbit in an NFW profile, by fixed-point steps; 1 where it is undefined.

    alpha is the squared velocity scale of the profile at the radius; velocities are squared, r0 and rs of one unit.
    """
    # A one-element array binds the terms that every step uses.
    start = F.try_divide(v_tan2, v_tan2 + v_rad2)
    terms = F.array(F.struct(v_tan2.alias("t"), (v_tan2 + v_rad2).alias("a"), F.try_divide(r0, rs).alias("x"), alpha.alias("s")))

    def solve(c):
        def step(x2, _):
            old = F.sqrt(x2)
            return F.try_divide(c["t"], c["a"] + c["s"] * (F.try_divide(F.log1p(old * c["x"]), old) - F.log1p(c["x"])))

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)

    x = F.transform(terms, solve)[0]
    return F.coalesce(F.nanvl(x, F.lit(1.0)), F.lit(1.0))


def particle_ranks(particles: DataFrame, key: list[str], selected: str = "selected") -> DataFrame:
    """Ranks from -1 to 1 among the selected particles of a halo: ranks (distance), ranksv (speed), ranksr (radial velocity), ranksp (perihelion), ranksc (distance to the next particle).

    particles: halo_id, key columns, selected, x, y, z and vx, vy, vz relative to the halo, m (mass in the unit of alpha: 2 G m
    / r in squared velocities), r25, r98 and nn2 (squared distance to the next particle of the halo, selected or not).
    A lone selected particle has 0, the others -1; ties go by the key.
    """
    d2, v2 = F.expr("x * x + y * y + z * z"), F.expr("vx * vx + vy * vy + vz * vz")
    p = particles.withColumn("_d2", d2).withColumn("_v2", v2)
    r0 = F.sqrt("_d2")
    p = p.withColumn("_vr", F.try_divide(F.expr("vx * x + vy * y + vz * z"), r0))
    c = F.col("r98") / F.col("r25")
    alpha = F.try_divide(F.col("m"), (F.log1p(c) - c / (c + 1)) * r0)
    vr2 = F.coalesce(F.col("_vr") * F.col("_vr"), F.lit(0.0))
    p = p.withColumn("_p2", F.col("_d2") * perihelion(F.col("_v2") - vr2, vr2, r0, F.col("r25"), alpha))
    n = F.count("*").over(W.partitionBy("halo_id", selected))
    out = {}
    for name, value in (("ranks", "_d2"), ("ranksv", "_v2"), ("ranksr", "_vr"), ("ranksp", "_p2"), ("ranksc", "nn2")):
        place = F.row_number().over(W.partitionBy("halo_id", selected).orderBy(value, *key)) - 1
        out[name] = F.when(~F.col(selected), F.lit(-1.0)).when(n > 1, 2.0 * place / (n - 1) - 1.0).otherwise(F.lit(0.0))
    return p.withColumns(out).drop("_d2", "_v2", "_vr", "_p2")


def matched(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """left with the columns of right's row of the same key; a row without one is an error when it is read, not a null."""
    there = right.withColumn("_there", F.lit(True))
    out = left.join(there, key, "left")
    missing = F.assert_true(F.coalesce("_there", F.lit(False)), F.lit("a row has no match"))
    return out.where(missing.isNull()).drop("_there")


def duplicated(df: DataFrame, key: str) -> DataFrame:
    """Keys that more than one row has, with the number of rows."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def keep_first(frames: list[DataFrame], key: str) -> DataFrame:
    """Union by name in which a key's row comes from the first frame that has it."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("_from", F.lit(i))
        out = f if out is None else out.unionByName(f)
    cols = [c for c in out.columns if c not in (key, "_from")]
    best = out.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct("_from", *cols)).alias("_r"))
    return best.select(key, "_r.*")


def counts_from_starts(df: DataFrame, start: str, order: list[str], total: int | Column, out: str) -> DataFrame:
    """df with the number of entries of each row: the next row's start less its own, the last one's from the total.

    The next row is the next of the bucket; a bucket's last row takes the first one of the next bucket, few rows in all.
    """
    r = ordered_buckets(df, order)
    first = r.groupBy("_part").agg(F.min_by(F.struct(start), F.struct(*order)).alias("_first"))
    first = first.select("_part", F.lead("_first").over(W.orderBy("_part")).alias("_first"))  # as many rows as buckets
    r = r.withColumn("_next", F.lead(F.struct(start)).over(W.partitionBy("_part").orderBy(*order))).join(first, "_part")
    following = F.coalesce("_next", "_first")[start]
    return r.withColumn(out, F.coalesce(following, total if isinstance(total, Column) else F.lit(total)) - F.col(start)).drop("_part", "_next", "_first")
