"""Queries of the operators on nearest neighbours, pixels, bins and stored tables."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import functions as F

from .functions import decode
from .functions.healpix import nested_pixel, ring_pixel
from .operators import mesh, nearest, ranks
from .plans import inference
from .plans.mocks import Mocks
from .queries import _D2, _ERF, _PE, _PL, _PS, _PU, _SOME, _U, ELG, LRG, _drawn, _elg
from .registry import query
from .session import shared_folder
from .sources import records, storage
from .sources.adapters import BOX, halos, particles, unit

K = 4


@query(
    f"""WITH {_SOME}, {_D2}, q AS (SELECT i, min(struct_pack(d2 := px * px + py * py + pz * pz, id := j), {K}) AS t FROM d3 WHERE i <> j GROUP BY i)
    SELECT i AS id, u.k::INT AS rank, t[u.k].id AS b_id, t[u.k].d2 AS d2 FROM q, unnest(range(1, {K + 1})) u(k)""",
    "h",
)
def halo_k_nearest(spark, d):
    h = halos(spark, d)
    return nearest.k_nearest(h, h, K, BOX)


@query(
    f"""WITH {_SOME}, {_D2}, r AS (SELECT *, (an % 37)::DOUBLE AS r0, 40.0::DOUBLE + (an % 61)::DOUBLE AS r1, px * px + py * py + pz * pz AS r2 FROM d3 WHERE an > 1000),
    m AS (SELECT i, (coalesce(sum(bn) FILTER (r2 <= r1 * r1), 0) - coalesce(sum(bn) FILTER (r2 <= r0 * r0), 0))::BIGINT AS menv FROM r GROUP BY i)
    SELECT s.id, coalesce(m.menv, 0)::BIGINT AS menv FROM s LEFT JOIN m ON s.id = m.i""",
    "h",
)
def menv_own_radii(spark, d):
    h = halos(spark, d).select("id", "x", "y", "z", F.col("n").alias("mass"), (F.col("n") % 37).cast("double").alias("inner"), (F.lit(40.0) + F.col("n") % 61).alias("outer"))
    return nearest.environment_mass_radii(h, "inner", "outer", BOX, 1000)


#: Pixels a side of a face, seen from the middle of the box.
NSIDE = 8
_SEEN = f"""seen AS (SELECT id, n, x - 500 AS dx, y - 500 AS dy, z - 500 AS dz FROM halos),
dir AS (SELECT *, CASE WHEN dx = 0 AND dy = 0 AND dz = 0 THEN 1.0::DOUBLE ELSE dz / sqrt(dx * dx + dy * dy + dz * dz) END AS u, atan2(dy, dx) / (pi() / 2) AS t0 FROM seen),
turn AS (SELECT *, CASE WHEN t0 < 0 AND t0 + 4 >= 4 THEN 0 WHEN t0 < 0 THEN t0 + 4 ELSE t0 END AS t FROM dir),
edge AS (SELECT *, floor({NSIDE} * (t + 0.5::DOUBLE) - {NSIDE} * 0.75::DOUBLE * u)::BIGINT AS up, floor({NSIDE} * (t + 0.5::DOUBLE) + {NSIDE} * 0.75::DOUBLE * u)::BIGINT AS down,
  floor((t - floor(t)) * (sqrt(3 * (1 - abs(u))) * {NSIDE}))::BIGINT AS a, floor((1 - (t - floor(t))) * (sqrt(3 * (1 - abs(u))) * {NSIDE}))::BIGINT AS b FROM turn),
ring AS (SELECT id, n, CASE WHEN abs(u) <= 2 / 3.0::DOUBLE THEN {2 * NSIDE * (NSIDE - 1)} + (up - down + {NSIDE}) * {4 * NSIDE} + ((up + down - {NSIDE} + ((up - down + {NSIDE}) & 1) + 1 + {8 * NSIDE}) >> 1) % {4 * NSIDE}
  WHEN u > 0 THEN 2 * (a + b + 1) * (a + b) + floor(t * (a + b + 1))::BIGINT % (4 * (a + b + 1))
  ELSE {12 * NSIDE**2} - 2 * (a + b + 1) * (a + b + 2) + floor(t * (a + b + 1))::BIGINT % (4 * (a + b + 1)) END AS pixel FROM edge),
face AS (SELECT id, n, CASE WHEN abs(u) <= 2 / 3.0::DOUBLE THEN CASE WHEN up // {NSIDE} = down // {NSIDE} THEN (up // {NSIDE}) % 4 + 4 WHEN up // {NSIDE} < down // {NSIDE} THEN up // {NSIDE} ELSE down // {NSIDE} + 8 END
    WHEN u > 0 THEN least(floor(t)::BIGINT, 3) ELSE least(floor(t)::BIGINT, 3) + 8 END AS f,
  CASE WHEN abs(u) <= 2 / 3.0::DOUBLE THEN down % {NSIDE} WHEN u > 0 THEN {NSIDE - 1} - least(b, {NSIDE - 1}) ELSE least(a, {NSIDE - 1}) END AS p,
  CASE WHEN abs(u) <= 2 / 3.0::DOUBLE THEN {NSIDE - 1} - up % {NSIDE} WHEN u > 0 THEN {NSIDE - 1} - least(a, {NSIDE - 1}) ELSE least(b, {NSIDE - 1}) END AS q FROM edge),
nest AS (SELECT id, n, f * {NSIDE**2} + (p & 1) + 4 * ((p >> 1) & 1) + 16 * ((p >> 2) & 1) + 2 * ((q & 1) + 4 * ((q >> 1) & 1) + 16 * ((q >> 2) & 1)) AS pixel FROM face)"""


def _pixels(spark, d, number):
    return halos(spark, d).select("id", "n", number(*[F.col(c) - BOX / 2 for c in "xyz"], NSIDE).alias("pixel"))


@query(f"WITH {_SEEN} SELECT pixel, count(*)::BIGINT AS n FROM nest GROUP BY 1", "h")
def healpix_histogram(spark, d):
    return mesh.pixel_counts(_pixels(spark, d, nested_pixel))


@query(f"WITH {_SEEN} SELECT pixel >> 4 AS pixel, count(*)::BIGINT AS n FROM nest GROUP BY 1", "h")
def healpix_degrade(spark, d):
    return mesh.degrade(mesh.pixel_counts(_pixels(spark, d, nested_pixel)), 2)


@query(f"WITH {_SEEN} SELECT pixel, sum(n)::BIGINT AS particles FROM ring GROUP BY 1", "h")
def healpix_ring_map(spark, d):
    return _pixels(spark, d, ring_pixel).groupBy("pixel").agg(F.sum("n").alias("particles"))


@query("SELECT greatest(least(n // 7, 299), 0)::INT AS bin, count(*)::BIGINT AS n, min(n)::BIGINT AS least FROM halos WHERE n >= 0 AND n <= 2100 GROUP BY 1", "h")
def bins_by_search(spark, d):
    """300 bins, found by a binary search."""
    b = halos(spark, d).select("n", ranks.bin_index(F.col("n").cast("double"), [7.0 * i for i in range(301)], "left").alias("bin")).where("bin is not null")
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.min("n").alias("least"))


@query(
    f"""WITH m AS (SELECT id, mass, {_U} AS u, {_PL} AS l, {_PE} AS e FROM halos), c AS (SELECT id, mass, CASE WHEN u <= l THEN 'LRG' WHEN u <= l + e THEN 'ELG' END AS cen FROM m),
j AS (SELECT halo_id AS id, pid, {_PS} * 0.9::DOUBLE AS pl, CASE WHEN cen = 'LRG' THEN {_elg(repr(10**13.0), "0.8")} WHEN cen = 'ELG' THEN {_elg(repr(10**12.9), "0.9")} ELSE {_elg(repr(10**13.2), "1.0")} END AS pe FROM particles JOIN c ON halo_id = id),
g AS (SELECT id, cen AS tracer, true AS is_central FROM c WHERE cen IS NOT NULL
  UNION ALL SELECT id, CASE WHEN {_PU} <= pl THEN 'LRG' ELSE 'ELG' END, false FROM j WHERE {_PU} <= pl + pe)
SELECT tracer, is_central, count(*)::BIGINT AS n, sum(id)::BIGINT AS ids FROM g GROUP BY 1, 2""",
    "hp",
)
def mock_from_stored(spark, d):
    """Halos and particles are stored by halo; the mock of two tracers is counted from there."""
    p = particles(spark, d).select("halo_id", "pid", *[F.col(f"d{a}").cast("double").alias(a) for a in "xyz"], *[F.col("v").cast("double").alias(f"v{a}") for a in "xyz"], F.lit(1.0).alias("weight"), unit(F.col("pid"), 2).alias("u"))
    p = p.join(halos(spark, d).select(F.col("id").alias("halo_id"), "mass"), "halo_id")
    store = storage.store_by_halo(f"stored_{uuid.uuid4().hex}", _drawn(spark, d), p, buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    atexit.register(_forget, store, spark)
    m = Mocks.stored(spark, store, BOX, 100.0, tracers={"LRG": LRG, "ELG": ELG}).run()
    return m.groupBy("tracer", "is_central").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def _forget(store, spark):
    with contextlib.suppress(Exception):  # the session may have ended
        store.drop(spark)


@query(
    """WITH r AS (SELECT id, n, n * 4096 + n % 4096 AS w, (row_number() OVER (ORDER BY id) - 1)::BIGINT AS row FROM halos)
SELECT row, ((w >> 12) * (1000.0::DOUBLE / 1000000))::DOUBLE AS x, ((w & 4095) - 2048) * (6000.0::DOUBLE / 2048) AS vx FROM r""",
    "h",
)
def records_round_trip(spark, d):
    """Packed words of halos written as binary files in the shared folder, each a range of the order, and read back in ranges."""
    word = F.expr("cast(n * 4096 + n % 4096 as int)")
    h = halos(spark, d).orderBy("id").select(word.alias("rv_x"), word.alias("rv_y"), word.alias("rv_z"))
    path = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    records.write_records(h, path, "rvint")
    r = records.read_records(spark, path, "rvint", ["rv_x", "row"], split_bytes=12_000)
    return r.select("row", decode.rvint_position(F.col("rv_x"), BOX).alias("x"), decode.rvint_velocity(F.col("rv_x")).alias("vx"))


_ONE_CEN = "0.5::DOUBLE * (1 - " + _ERF.format(x="((cut - log10(mass)) / (1.41421356::DOUBLE * sigma))") + ")"


@query(
    f"""WITH o AS (SELECT DISTINCT owner AS sample, 12.5::DOUBLE + (owner % 50) / 50.0::DOUBLE AS cut, 0.2::DOUBLE + (owner % 7) / 20.0::DOUBLE AS sigma, 13.5::DOUBLE + (owner % 11) / 10.0::DOUBLE AS m1 FROM halos),
w AS (SELECT mass, count(*) AS k FROM halos GROUP BY 1),
e AS (SELECT sample, mass, k, {_ONE_CEN} AS c, CASE WHEN mass > 0.4::DOUBLE * pow(10.0::DOUBLE, cut) THEN pow((mass - 0.4::DOUBLE * pow(10.0::DOUBLE, cut)) / pow(10.0::DOUBLE, m1), 1.0::DOUBLE) ELSE 0 END AS s FROM o, w)
SELECT sample, round(sum(k * c * 0.9::DOUBLE), 4) AS n_cent, round(sum(k * s * c * 0.9::DOUBLE), 4) AS n_sat FROM e GROUP BY 1""",
    "h",
)
def expected_numbers_many(spark, d):
    """A parameter set for each owner of halos, all of them in one pass."""
    h = halos(spark, d)
    o = F.col("owner")
    samples = h.select("owner").distinct().select(o.alias("sample"), (F.lit(12.5) + o % 50 / 50).alias("logm_cut"), (F.lit(0.2) + o % 7 / 20).alias("sigma"), (F.lit(13.5) + o % 11 / 10).alias("logm1"))
    got = inference.expected_numbers(h, samples, "LRG", LRG)
    return got.select("sample", F.round("n_cent", 4).alias("n_cent"), F.round("n_sat", 4).alias("n_sat"))


@query("WITH q AS (SELECT id, least(floor(x * 16 / 1000.0::DOUBLE)::INT, 15) AS part, x FROM halos) SELECT id, part, (row_number() OVER (ORDER BY part, x, id) - 1)::BIGINT AS place FROM q", "h")
def partition_rows(spark, d):
    return mesh.partitioned(halos(spark, d).select("id", "x"), 16, BOX, ["x", "id"]).select("id", "part", "place")
