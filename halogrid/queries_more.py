"""Queries of ranks, staging, mocks, fits and catalog scans, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import hod, mesh, neighbors, power, ranks, sampling
from .registry import query
from .session import dealt
from .sources.adapters import BOX, halos, particles, unit

# --- ranks of particles ---

_RELATIVE = """rel AS (SELECT halo_id, pid, price, line, pid % 3 <> 0 AS selected, dx / 1000.0::DOUBLE AS x, dy / 1000.0::DOUBLE AS y, dz / 1000.0::DOUBLE AS z, v::DOUBLE AS vx,
  ((pid * 47 + 19) % 4001 - 2000)::DOUBLE AS vy, ((pid * 53 + 23) % 4001 - 2000)::DOUBLE AS vz, h.n * 40.0::DOUBLE AS m, 0.1::DOUBLE + h.id % 7 * 0.01::DOUBLE AS r25, 0.5::DOUBLE + h.id % 5 * 0.1::DOUBLE AS r98 FROM particles JOIN halos h ON halo_id = h.id)"""


def _relative(spark, d):
    h = halos(spark, d).select(F.col("id").alias("halo_id"), F.expr("n * 40D").alias("m"), F.expr("0.1D + id % 7 * 0.01D").alias("r25"), F.expr("0.5D + id % 5 * 0.1D").alias("r98"))
    p = particles(spark, d).select(
        "halo_id", "pid", "price", "line", F.expr("pid % 3 <> 0").alias("selected"), *[F.expr(f"d{a} / 1000D").alias(a) for a in "xyz"],
        F.expr("cast(v as double)").alias("vx"), F.expr("cast((pid * 47 + 19) % 4001 - 2000 as double)").alias("vy"), F.expr("cast((pid * 53 + 23) % 4001 - 2000 as double)").alias("vz"),
    )
    p, h = dealt("halo_id", p, h)
    return p.join(h, "halo_id")


def _next_distance(p):
    return neighbors.next_place(p, "halo_id", "nn2").withColumn("nn2", F.round("nn2", 9))


_ALPHA = "m / ((ln(1 + r98 / r25) - (r98 / r25) / (r98 / r25 + 1)) * sqrt(d2))"


def _ranks_sql() -> str:
    start = "CASE WHEN v2 > 0 THEN greatest(v2 - vr * vr, 0) / v2 END"
    step = "CASE WHEN x2 IS NULL OR x2 <= 0 THEN NULL ELSE vt2 / (a + al * (ln(1 + sqrt(x2) * x0) / sqrt(x2) - ln(1 + x0))) END"
    steps = ", ".join(f"i{i} AS MATERIALIZED (SELECT * REPLACE ({step} AS x2) FROM i{i - 1})" for i in range(1, 21))
    rank = lambda c: f"CASE WHEN NOT selected THEN -1 WHEN count(*) OVER (PARTITION BY halo_id, selected) > 1 THEN round(2.0::DOUBLE * (row_number() OVER (PARTITION BY halo_id, selected ORDER BY {c} NULLS FIRST, pid, price, line) - 1) / (count(*) OVER (PARTITION BY halo_id, selected) - 1) - 1, 9) ELSE 0 END::DOUBLE"
    return f"""WITH {_RELATIVE}, q AS (SELECT *, x * x + y * y + z * z AS d2, vx * vx + vy * vy + vz * vz AS v2 FROM rel), r AS (SELECT *, CASE WHEN d2 > 0 THEN (vx * x + vy * y + vz * z) / sqrt(d2) END AS vr FROM q),
i0 AS (SELECT *, {start} AS x2, greatest(v2 - vr * vr, 0) AS vt2, v2 AS a, sqrt(d2) / r25 AS x0, {_ALPHA} AS al FROM r), {steps},
pl AS (SELECT DISTINCT halo_id, x, y, z FROM rel), nn AS (SELECT a.halo_id, a.x, a.y, a.z, round(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), 9) AS nn2 FROM pl a LEFT JOIN pl b ON a.halo_id = b.halo_id AND NOT (a.x = b.x AND a.y = b.y AND a.z = b.z) GROUP BY 1, 2, 3, 4),
f AS (SELECT i20.*, nn2, round(d2, 9) AS rd, round(d2 * CASE WHEN x2 IS NULL OR isnan(x2) THEN 1 ELSE x2 END, 9) AS p2, round(vr, 9) AS rvr FROM i20 LEFT JOIN nn USING (halo_id, x, y, z))
SELECT halo_id, pid, price, line, {rank('d2')} AS ranks, {rank('v2')} AS ranksv, {rank('vr')} AS ranksr, {rank('p2')} AS ranksp, {rank('nn2')} AS ranksc FROM f"""


@query(_ranks_sql(), "hp")
def particle_rank_perihelion(spark, d):
    p = ranks.particle_ranks(_next_distance(_relative(spark, d)), ["pid", "price", "line"])
    return p.select("halo_id", "pid", "price", "line", *[F.round(c, 9).alias(c) for c in ("ranks", "ranksv", "ranksr", "ranksp", "ranksc")])


# --- staging, draws, velocities ---


@query(f"WITH {_RELATIVE}, s AS (SELECT halo_id, pid, price, line, r98 / r25 AS conc, count(*) OVER (PARTITION BY halo_id) AS np FROM rel) SELECT halo_id, pid, price, line, round(conc, 9) AS conc, round(1.0::DOUBLE / np / 0.3::DOUBLE, 9) AS weight FROM s", "hp")
def stage_particles(spark, d):
    h = halos(spark, d).select("id", "mass", F.expr("0.1D + id % 7 * 0.01D").alias("r25"), F.expr("0.5D + id % 5 * 0.1D").alias("r98"))
    _, p = hod.stage(h, particles(spark, d), 0.3)
    return p.select("halo_id", "pid", "price", "line", F.round("conc", 9).alias("conc"), F.round("weight", 9).alias("weight"))


@query("SELECT id, round(vx + 0.3::DOUBLE * (id % 11 - 5), 9) + 0.0::DOUBLE AS vx, round(vy + 0.3::DOUBLE * (id % 13 - 6), 9) + 0.0::DOUBLE AS vy, round(vz + 0.3::DOUBLE * (id % 17 - 8), 9) + 0.0::DOUBLE AS vz FROM halos", "h")
def central_velocity_bias(spark, d):
    h = halos(spark, d).withColumns({f"d{a}": F.expr(f"cast(id % {m} - {m // 2} as double)") for a, m in zip("xyz", (11, 13, 17))})
    return hod.velocity_bias(h, 0.3, ("dx", "dy", "dz")).select("id", *[(F.round(f"v{a}", 9) + 0.0).alias(f"v{a}") for a in "xyz"])


@query("SELECT p.halo_id, p.pid, p.price, p.line, round(h.vx + 0.7::DOUBLE * (p.v - h.vx), 9) + 0.0::DOUBLE AS vx, round(h.vy + 0.7::DOUBLE * (p.dx - h.vy), 9) + 0.0::DOUBLE AS vy, round(h.vz + 0.7::DOUBLE * (p.dy - h.vz), 9) + 0.0::DOUBLE AS vz FROM particles p JOIN halos h ON p.halo_id = h.id", "hp")
def satellite_velocity_bias(spark, d):
    h = halos(spark, d).select(F.col("id").alias("halo_id"), *[F.col(f"v{a}").alias(f"hv{a}") for a in "xyz"])
    p = particles(spark, d).select("halo_id", "pid", "price", "line", F.col("v").cast("double").alias("vx"), F.col("dx").cast("double").alias("vy"), F.col("dy").cast("double").alias("vz")).join(h, "halo_id")
    return hod.satellite_velocity(p, 0.7).select("halo_id", "pid", "price", "line", *[(F.round(f"v{a}", 9) + 0.0).alias(f"v{a}") for a in "xyz"])  # no negative zeros


_UNIT = lambda key, stream: f"(({key} * 7919 + {stream} * 104729) % 10007)::DOUBLE / 10007::DOUBLE"
_ERF = "CASE WHEN {x} >= 0 THEN 1 ELSE -1 END * (1 - ((((1.061405429::DOUBLE / (1 + 0.3275911::DOUBLE * abs({x})) - 1.453152027::DOUBLE) / (1 + 0.3275911::DOUBLE * abs({x})) + 1.421413741::DOUBLE) / (1 + 0.3275911::DOUBLE * abs({x})) - 0.284496736::DOUBLE) / (1 + 0.3275911::DOUBLE * abs({x})) + 0.254829592::DOUBLE) / (1 + 0.3275911::DOUBLE * abs({x})) * exp(-({x}) * ({x})))"
_RANKED = hod.Tracer(13.0, 13.6, 0.6, 1.0, 0.4, ic=0.9, s=0.3, s_v=-0.2, s_r=0.1)


def _lrg_sql(cut: str = "13.0::DOUBLE") -> str:
    return f"(0.5::DOUBLE * (1 - {_ERF.format(x=f'(({cut} - log10(mass)) / (1.41421356::DOUBLE * 0.6::DOUBLE))')}))"


_SAT = "(CASE WHEN mass > 0.4::DOUBLE * 1e13::DOUBLE THEN pow((mass - 0.4::DOUBLE * 1e13::DOUBLE) / 39810717055349.69::DOUBLE, 1.0::DOUBLE) ELSE 0 END)"


@query(f"WITH r AS (SELECT p.halo_id, p.pid, p.price, p.line, h.mass, (p.dx % 100) / 100.0::DOUBLE AS a, (p.dy % 100) / 100.0::DOUBLE AS b, (p.dz % 100) / 100.0::DOUBLE AS c FROM particles p JOIN halos h ON p.halo_id = h.id) SELECT halo_id, pid, price, line FROM r WHERE {_UNIT('pid', 2)} <= {_SAT} * {_lrg_sql()} * 0.9::DOUBLE * (1 + 0.3::DOUBLE * a - 0.2::DOUBLE * b + 0.1::DOUBLE * c)", "hp")
def hod_satellites_ranks(spark, d):
    h = halos(spark, d).select(F.col("id").alias("halo_id"), "mass")
    p = particles(spark, d).drop("weight").join(h, "halo_id").withColumn("u", unit(F.col("pid"), 2)).withColumn("weight", F.lit(1.0))
    p = p.withColumns({n: F.expr(f"d{a} % 100 / 100D") for n, a in (("ranks", "x"), ("ranksv", "y"), ("ranksr", "z"))})
    return hod.satellites(p, {"LRG": _RANKED}).select("halo_id", "pid", "price", "line")


_CUT_Z = 13.0 + 2.0 * (1 / 1.5 - 1 / 1.8)


@query(f"SELECT id FROM halos WHERE {_UNIT('id', 1)} <= {_lrg_sql(f'{_CUT_Z!r}::DOUBLE')} * 0.9::DOUBLE", "h")
def hod_redshift_evolution(spark, d):
    t = hod.evolved(_RANKED, 0.5, 0.8, {"logm_cut": 2.0})
    return hod.centrals(halos(spark, d).withColumn("u", unit(F.col("id"), 1)), {"LRG": t}).select("id")


_ELG = hod.Tracer(12.5, 13.2, 1.0, 1.0, 1.0, p_max=0.5, q=100.0, gamma=2.0, beside={"ELG": (12.9, 0.9)})
_QSO = hod.Tracer(12.8, 13.9, 0.5, 1.0, 1.0, ic=0.4)
_CE = "(log10(mass) - 12.5::DOUBLE)"
_ECEN = f"(2 * (0.5::DOUBLE - 1 / 100.0::DOUBLE) * 0.3989422804014327::DOUBLE * exp(-{_CE} * {_CE} / 2) * 0.5::DOUBLE * (1 + {_ERF.format(x=f'({_CE} * 2.0::DOUBLE / sqrt(2.0::DOUBLE))')}))"
_ESAT = lambda m1, al: f"(CASE WHEN mass > 3162277660168.3794::DOUBLE THEN pow((mass - 3162277660168.3794::DOUBLE) / {m1!r}::DOUBLE, {al}::DOUBLE) ELSE 0 END)"
_HIST = "h AS (SELECT n // 100 AS b, count(*)::DOUBLE AS w FROM halos GROUP BY 1), m AS (SELECT w, pow(10.0::DOUBLE, 11 + b / 20.0::DOUBLE) AS mass FROM h)"


def _by_mass(spark, d):
    return halos(spark, d).groupBy(F.floor(F.col("n") / 100).alias("b")).agg(F.count("*").cast("double").alias("weight"))


def _expected(spark, d, name, t):
    return hod.mean_number(_by_mass(spark, d), name, t, 11.0 + F.col("b") / 20.0).select(F.round("n_cent", 4).alias("n_cent"), F.round("n_sat", 4).alias("n_sat"))


@query(f"WITH {_HIST} SELECT round(sum(w * {_ECEN}), 4) AS n_cent, round(sum(w * ({_ESAT(10**13.2, 1.0)} * (1 - {_ECEN}) + {_ESAT(10**12.9, 0.9)} * {_ECEN})), 4) AS n_sat FROM m", "h")
def ngal_elg(spark, d):
    return _expected(spark, d, "ELG", _ELG)


@query(f"WITH {_HIST} SELECT round(sum(w * 0.4::DOUBLE * 0.5::DOUBLE * (1 + {_ERF.format(x='((log10(mass) - 12.8::DOUBLE) / (1.41421356::DOUBLE * 0.5::DOUBLE))')})), 4) AS n_cent, round(sum(w * 0.4::DOUBLE * CASE WHEN mass > {10**12.8!r}::DOUBLE THEN (mass - {10**12.8!r}::DOUBLE) / {10**13.9!r}::DOUBLE ELSE 0 END), 4) AS n_sat FROM m", "h")
def ngal_qso(spark, d):
    return _expected(spark, d, "QSO", _QSO)


@query("SELECT (n // 500)::INT AS b_n, (id % 97 // 10)::INT AS b_a, (id % 89 // 10)::INT AS b_b, sum(owner)::BIGINT AS weight FROM halos WHERE n < 5000 AND id % 97 < 90 AND id % 89 < 80 GROUP BY 1, 2, 3", "h")
def hmf_histogram3d(spark, d):
    h = halos(spark, d).withColumn("a", F.expr("id % 97")).withColumn("b", F.expr("id % 89")).where("n < 5000 and a < 90 and b < 80")
    return hod.mass_histogram(h, {"n": [500.0 * i for i in range(11)], "a": [10.0 * i for i in range(10)], "b": [10.0 * i for i in range(9)]}, "owner")


# --- environment on edges, unions, checks ---


@query(
    """WITH e AS (SELECT id, x, y, z, n::DOUBLE AS menv, 5.0::DOUBLE + id % 3 AS r_inner, x < 100 OR z > 900 AS edge FROM halos), r AS (SELECT x, y, z FROM halos WHERE id % 2 = 1 AND x > 20 AND z < 980),
p AS (SELECT e.id, count(*) AS k FROM e, r, (SELECT unnest([-1, 0, 1]) AS i) a, (SELECT unnest([-1, 0, 1]) AS j) b, (SELECT unnest([-1, 0, 1]) AS k) c
  WHERE edge AND abs(r.x + 1000 * a.i - e.x) <= 40 AND abs(r.y + 1000 * b.j - e.y) <= 40 AND abs(r.z + 1000 * c.k - e.z) <= 40
  AND (r.x + 1000 * a.i - e.x) ** 2 + (r.y + 1000 * b.j - e.y) ** 2 + (r.z + 1000 * c.k - e.z) ** 2 <= 1600 AND (r.x + 1000 * a.i - e.x) ** 2 + (r.y + 1000 * b.j - e.y) ** 2 + (r.z + 1000 * c.k - e.z) ** 2 > r_inner * r_inner GROUP BY e.id)
SELECT id, round(CASE WHEN NOT edge THEN menv WHEN k IS NULL THEN 0 ELSE menv / (k / (4 / 3.0::DOUBLE * 3.141592653589793::DOUBLE * 7.5e-6::DOUBLE * (64000 - r_inner ** 3))) END, 6) AS menv FROM e LEFT JOIN p USING (id)""",
    "h",
)
def menv_edge_normalised(spark, d):
    h = halos(spark, d).withColumn("r_inner", F.expr("5D + id % 3"))
    env = h.select("id", F.col("n").cast("double").alias("menv"))
    randoms = h.where("id % 2 = 1 and x > 20 and z < 980")
    return neighbors.edge_normalised(env, h, randoms, F.expr("x < 100 or z > 900"), 40.0, 7.5e-6, BOX).select("id", F.round("menv", 6).alias("menv"))


@query("SELECT owner AS id, max_by(src, -src) AS src, arg_min(n, src) AS n FROM (SELECT owner, 0 AS src, max(n) AS n FROM halos WHERE slab < 3 GROUP BY 1 UNION ALL SELECT owner, 1, max(n) FROM halos WHERE slab BETWEEN 2 AND 5 GROUP BY 1 UNION ALL SELECT owner, 2, max(n) FROM halos WHERE slab > 4 GROUP BY 1) GROUP BY owner", "h")
def union_keep_first(spark, d):
    h = halos(spark, d)
    parts = [h.where(w).groupBy(F.col("owner").alias("id")).agg(F.max("n").alias("n")).withColumn("src", F.lit(i)) for i, w in enumerate(("slab < 3", "slab between 2 and 5", "slab > 4"))]
    return ranks.keep_first(parts, "id").select("id", "src", "n")


@query("SELECT id FROM halos WHERE (x > 0 AND x <= 400 AND y > 0 AND y <= 400 AND z > 0 AND z <= 400) OR (x - 500 > 0 AND x - 500 <= 300 AND y > 0 AND y <= 300 AND z - 200 > 0 AND z - 200 <= 300)", "h")
def union_cell_masks(spark, d):
    return halos(spark, d).where(sampling.any_box([(0.0, 400.0), (0.0, 300.0)], [(0.0, 0.0, 0.0), (500.0, 0.0, 200.0)])).select("id")


@query("SELECT owner, count(*)::BIGINT AS n FROM halos GROUP BY owner HAVING count(*) > 1", "h")
def duplicate_ids(spark, d):
    return ranks.duplicated(halos(spark, d), "owner")


@query("SELECT p.halo_id, p.pid, p.price, p.line, h.n FROM particles p JOIN halos h ON p.halo_id = h.id", "hp")
def searchsorted_must_match(spark, d):
    h = halos(spark, d).select(F.col("id").alias("halo_id"), "n")
    return ranks.matched(particles(spark, d).select("halo_id", "pid", "price", "line"), h, ["halo_id"])


@query("WITH s AS (SELECT id, (sum(n % 7) OVER (ORDER BY id) - n % 7)::BIGINT AS start FROM halos) SELECT id, (n % 7)::BIGINT AS npout FROM halos", "h")
def subsample_counts_from_starts(spark, d):
    h = ranks.prefix_sum(halos(spark, d).select("id", F.expr("n % 7").alias("k")), "k", ["id"], "start")
    total = h.agg(F.sum("k").alias("t")).first().t or 0
    return ranks.counts_from_starts(h.select("id", "start"), "start", ["id"], total, "npout").select("id", "npout")


@query("SELECT id, coalesce(n > 1000 AND n < 4000 AND x > 100 AND x < 900, false) AS inside FROM halos", "h")
def prior_inrange(spark, d):
    return hod.in_range(halos(spark, d), {"n": (1000, 4000), "x": (100.0, 900.0)}).select("id", "inside")


@query("WITH s AS (SELECT slab AS pair, (id % 6)::INT AS i, sum(n)::DOUBLE / 1e6 AS a, sum(owner)::DOUBLE / 1e6 AS b FROM halos GROUP BY 1, 2), r AS (SELECT pair, i, b - a AS r FROM s), c AS (SELECT i, j, CASE WHEN i = j THEN 2.0::DOUBLE ELSE 1.0::DOUBLE / (1 + abs(i - j)) END AS v FROM range(6) a(i), range(6) b(j)) SELECT round(-0.5::DOUBLE * sum(x.r * c.v * y.r), 6) AS lnl FROM r x JOIN c ON c.i = x.i JOIN r y ON y.pair = x.pair AND y.i = c.j", "h")
def log_likelihood(spark, d):
    s = halos(spark, d).groupBy(F.col("slab").alias("pair"), F.expr("cast(id % 6 as int)").alias("i")).agg((F.sum("n").cast("double") / 1e6).alias("a"), (F.sum("owner").cast("double") / 1e6).alias("b"))
    six = spark.range(6).select(F.col("id").cast("int").alias("i"))
    inverse = six.join(six.select(F.col("i").alias("j")), F.lit(True)).withColumn("value", F.expr("if(i = j, 2D, 1D / (1 + abs(i - j)))"))  # 36 rows
    inverse = inverse.join(s.select("pair").distinct())
    got = hod.log_likelihood(s.select("pair", "i", F.col("a").alias("value")), s.select("pair", "i", F.col("b").alias("value")), inverse)
    return got.select(F.round("lnl", 6).alias("lnl"))


# --- meshes of thinned particles ---


@query()
def shear_mark(spark, d):
    h = halos(spark, d)
    thinned = sampling.thin([h.where("slab < 4").select("id", "x", "y", "z"), h.where("slab >= 4").select("id", "x", "y", "z")], "id", 2, 7)
    return power.cells_frame(spark, power.tidal_shear(thinned, 16, BOX, 60.0), "shear").withColumn("shear", F.round("shear", 6))


@query()
def stored_draws(spark, d):
    return hod.stored_draws(halos(spark, d).select("id"), F.lit(300.0), 600)
