"""Queries over the adapter tables, with their SQL: one per operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import decode
from .functions import math as fm
from .operators import hod, mesh, neighbors, power, ranks, sampling, variates
from .plans import mocks
from .registry import ORACLE_SQL, QUERIES, query
from .session import checkpointed, dealt
from .sources import catalog
from .sources.adapters import BOX, halos, particles, unit

MASS_EDGES = [0.0, 2.0e12, 4.0e12, 6.0e12, 8.0e12, 1.2e13]


def _orders(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet")


# --- scans, projections, filters ---


@query("SELECT id, n, mass, x, y, z FROM halos", "h")
def scan_fields(spark, d):
    return halos(spark, d).select("id", "n", "mass", "x", "y", "z")


@query("SELECT id, mass FROM halos WHERE n > 2000", "h")
def scan_filter_mass(spark, d):
    return halos(spark, d).where("n > 2000").select("id", "mass")


@query("SELECT slab, count(*)::BIGINT AS n_halos, sum(n)::BIGINT AS n_particles FROM halos WHERE slab BETWEEN 2 AND 4 GROUP BY slab", "h")
def scan_slab_prune(spark, d):
    return halos(spark, d).where("slab between 2 and 4").groupBy("slab").agg(F.count("*").alias("n_halos"), F.sum("n").alias("n_particles"))


@query("SELECT id, x, z FROM halos WHERE abs((x - 990.0::DOUBLE) - 1000.0::DOUBLE * round((x - 990.0::DOUBLE) / 1000.0::DOUBLE)) <= 40.0::DOUBLE", "h")
def edge_pad_filter(spark, d):
    return halos(spark, d).where(F.abs(fm.wrap_dx(F.col("x") - 990.0, BOX)) <= 40.0).select("id", "x", "z")


@query("SELECT id FROM halos WHERE x > 100 AND x <= 700 AND y > 100 AND y <= 700 AND z > 100 AND z <= 700 AND x * x + y * y + z * z BETWEEN 90000.0::DOUBLE AND 640000.0::DOUBLE", "h")
def lc_bounds_filter(spark, d):
    return halos(spark, d).where(sampling.in_box(100, 700)).where("x * x + y * y + z * z between 90000D and 640000D").select("id")


# --- decoders ---


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (((l_partkey * 4801 % 1048576 - 524288) * 4096 + l_suppkey * 37 % 4096) >> 12)::DOUBLE * (1000.0::DOUBLE / 1000000.0::DOUBLE) AS pos, "
    "((((l_partkey * 4801 % 1048576 - 524288) * 4096 + l_suppkey * 37 % 4096) & 4095) - 2048)::DOUBLE * (6000.0::DOUBLE / 2048.0::DOUBLE) AS vel FROM lineitem"
)
def decode_rvint(spark, d):
    word = F.expr("cast((l_partkey * 4801 % 1048576 - 524288) * 4096 + l_suppkey * 37 % 4096 as int)")
    df = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("w", word)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", decode.rvint_position(F.col("w"), BOX).alias("pos"), decode.rvint_velocity(F.col("w")).alias("vel"))


_WORD = "(id % 32768) + ((id * 3 % 32768) << 16) + ((id * 7 % 32768) << 32) + ((id % 2) << 48) + ((id * 11 % 1024) << 49)"


@query(f"WITH w AS (SELECT id, {_WORD} AS w FROM halos) SELECT id, w & 140735340838911 AS pid, ((w >> 48) & 1)::INT AS tagged, ((((w >> 49) & 1023) * ((w >> 49) & 1023)))::FLOAT AS density FROM w", "h")
def decode_pid_bits(spark, d):
    f = _packed(spark, d)
    return f.select("id", "pid", "tagged", "density")


@query(
    f"WITH w AS (SELECT id, {_WORD} AS w FROM halos) SELECT id, (w & 32767)::INT AS ix, ((w >> 16) & 32767)::INT AS iy, ((w >> 32) & 32767)::INT AS iz, "
    "(w & 32767)::DOUBLE * (1000.0::DOUBLE / 6912) - 500.0::DOUBLE AS qx, ((w >> 16) & 32767)::DOUBLE * (1000.0::DOUBLE / 6912) - 500.0::DOUBLE AS qy FROM w",
    "h",
)
def decode_lagr_pos(spark, d):
    f = _packed(spark, d)
    return f.select("id", F.col("lagr_idx_x").alias("ix"), F.col("lagr_idx_y").alias("iy"), F.col("lagr_idx_z").alias("iz"), F.col("lagr_pos_x").alias("qx"), F.col("lagr_pos_y").alias("qy"))


def _packed(spark, d):
    word = F.expr("(id % 32768) + shiftleft(id * 3 % 32768, 16) + shiftleft(id * 7 % 32768, 32) + shiftleft(id % 2, 48) + shiftleft(id * 11 % 1024, 49)")
    h = halos(spark, d).select("id", word.alias("w"))
    return h.select("id", *[c.alias(n) for n, c in decode.pid_fields(F.col("w"), BOX, 6912).items()])


@query("SELECT id, (id * 13 % 32000)::DOUBLE * (n / 1000.0::DOUBLE) / 32000.0::DOUBLE * 1000.0::DOUBLE AS r25 FROM halos", "h")
def decode_i16_ratio(spark, d):
    return halos(spark, d).select("id", decode.ratio(F.expr("cast(id * 13 % 32000 as short)"), F.expr("n / 1000D"), BOX).alias("r25"))


@query("SELECT id, round(sqrt((n * n - (n * 0.8::DOUBLE) * (n * 0.8::DOUBLE) - (n * 0.3::DOUBLE) * (n * 0.3::DOUBLE))::DOUBLE), 6) AS sigma_mid FROM halos", "h")
def decode_sigmav_mid(spark, d):
    n = F.col("n").cast("double")
    return halos(spark, d).select("id", F.round(decode.sigma_mid(n, n * 0.8, n * 0.3), 6).alias("sigma_mid"))


@query(
    """WITH w AS (SELECT id, id * 31 % 65340 AS c FROM halos), a AS (SELECT id, c, c // 45 // 121 AS cap, c // 45 % 121 AS b, c % 45 AS az FROM w),
b AS (SELECT *, floor(sqrt(b::DOUBLE))::BIGINT AS it FROM a), t0 AS (SELECT *, (it + 0.5::DOUBLE) / (11 * 1.8477590650225735122::DOUBLE) AS u, (b - it * it + 0.5::DOUBLE) / (it + 0.5::DOUBLE) - 1 AS rr FROM b),
t AS (SELECT *, u * sqrt(2 - u * u) / (1 - u * u) AS t1 FROM t0), m AS (SELECT *, sqrt(1 + t1 * t1 + rr * t1 * rr * t1) AS nrm, cap // 4 AS g, CASE WHEN cap % 2 = 0 THEN t1 ELSE -t1 END AS yy, rr * t1 AS xx,
 (cap // 4 + CASE WHEN cap % 4 < 2 THEN 1 ELSE 2 END) % 3 AS s FROM t)
SELECT id, round(CASE WHEN g = 0 THEN 1 WHEN s = 0 THEN yy ELSE xx END / nrm, 6) AS mx, round(CASE WHEN g = 1 THEN 1 WHEN s = 1 THEN yy ELSE xx END / nrm, 6) AS my, round(CASE WHEN g = 2 THEN 1 WHEN s = 2 THEN yy ELSE xx END / nrm, 6) AS mz FROM m""",
    "h",
)
def decode_euler16(spark, d):
    t = decode.euler16_table(spark)  # 65,340 rows
    h = halos(spark, d).select("id", F.expr("id * 31 % 65340").alias("code"))
    return h.join(F.broadcast(t), "code").select("id", *[F.round(f"maj_{a}", 6).alias(f"m{a}") for a in "xyz"])


@query(
    """WITH r AS (SELECT slab AS file, id AS pos, id % 40 < 8 AS head, 1 + id % 9 AS cpd, id * 7 % 500 AS vs, id * 3 % 9 AS ci, id * 5 % 9 AS cj, id * 11 % 9 AS ck, id * 13 % 1001 - 500 AS a, id * 17 % 1001 - 500 AS v FROM halos),
w AS (SELECT *, last_value(CASE WHEN head THEN pos END IGNORE NULLS) OVER (PARTITION BY file ORDER BY pos ROWS UNBOUNDED PRECEDING) AS hp FROM r)
SELECT w.pos, round(w.a * 0.0005::DOUBLE * (1000.0::DOUBLE / h.cpd) + (h.ci + 0.5::DOUBLE) * (1000.0::DOUBLE / h.cpd) - 500, 6) AS x, round(w.v * (h.vs * 0.0005::DOUBLE / h.cpd * 100.0::DOUBLE), 6) + 0.0::DOUBLE AS vx FROM w JOIN r h ON h.pos = w.hp AND NOT w.head""",
    "h",
)
def decode_pack9_stream(spark, d):
    # Records are encoded from integer hashes, as the format packs them, and decoded as a stream per slab.
    h = halos(spark, d).select(F.col("slab").alias("file"), F.col("id").alias("pos"))
    p = F.col("pos")
    head = p % 40 < 8
    f = [F.when(head, F.lit(2032)).otherwise(p * 13 % 1001 - 500)]  # 2032 + 2048 = 0xFF0: a first byte of 255
    f += [F.when(head, x - 2000).otherwise(y) for x, y in ((1 + p % 9, F.lit(1).cast("long")), (p * 7 % 500, F.lit(-3).cast("long")), (p * 3 % 9, p * 17 % 1001 - 500), (p * 5 % 9, F.lit(5).cast("long")), (p * 11 % 9, F.lit(9).cast("long")))]
    u = [(x + 2048).cast("int") for x in f]
    parts = []
    for i in (0, 2, 4):
        parts += [F.shiftright(u[i], 4), u[i].bitwiseAND(15) + F.shiftleft(F.shiftright(u[i + 1], 8), 4), u[i + 1].bitwiseAND(255)]
    raw = F.unhex(F.concat(*[F.lpad(F.hex(x.cast("long")), 2, "0") for x in parts]))
    out = decode.decode_pack9(h.select("file", "pos", raw.alias("raw")), BOX, 100.0)
    return out.select("pos", F.round("x", 6).alias("x"), (F.round("vx", 6) + 0.0).alias("vx"))


@query("SELECT id, CASE WHEN id % 3 <> 0 THEN x ELSE y END AS px, CASE WHEN id % 3 <> 0 THEN vx ELSE vy END AS pv FROM halos", "h")
def lc_interp_select(spark, d):
    h = halos(spark, d)
    h = h.select("id", F.when(F.col("id") % 3 != 0, F.array("x", "vx")).otherwise(F.array(F.lit(0.0), F.lit(0.0))).alias("avg"), F.array("y", "vy").alias("interp"))
    use = F.when(F.exists("avg", lambda v: v != 0), F.col("avg")).otherwise(F.col("interp"))
    return h.select("id", use[0].alias("px"), use[1].alias("pv"))


@query("SELECT id, id % 9 % 3 AS origin FROM halos", "h")
def lc_origin_mod3(spark, d):
    return halos(spark, d).select("id", F.pmod(F.col("id") % 9, F.lit(3)).alias("origin"))


# --- cleaning, ranges, joins ---


def _cleaned(spark, d):
    h = halos(spark, d)
    return catalog.clean(h.select("id", "n", "slab", "mass"), h.where("merged_to >= 0").select("id", "merged_to"))


_CLEAN = """m AS (SELECT id, merged_to, n FROM halos WHERE merged_to >= 0), g AS (SELECT merged_to AS id, sum(n)::BIGINT AS n_merge FROM m GROUP BY merged_to),
c AS (SELECT h.id, h.slab, h.n, CASE WHEN h.merged_to >= 0 THEN 0 ELSE h.n + coalesce(g.n_merge, 0) END::BIGINT AS n_total FROM halos h LEFT JOIN g USING (id))"""


@query(f"WITH {_CLEAN} SELECT id, n, n_total FROM c", "h")
def clean_join(spark, d):
    return _cleaned(spark, d).select("id", "n", "n_total")


@query(f"WITH {_CLEAN} SELECT id, n_total FROM c WHERE n_total > 0", "h")
def clean_drop_zero(spark, d):
    return _cleaned(spark, d).where("n_total > 0").select("id", "n_total")


@query("SELECT a.id, a.merged_to, b.n AS host_n FROM halos a JOIN halos b ON a.merged_to = b.id", "h")
def merge_pointer_join(spark, d):
    h = halos(spark, d)
    return h.select("id", "merged_to").where("merged_to >= 0").join(h.select(F.col("id").alias("merged_to"), F.col("n").alias("host_n")), "merged_to").select("id", "merged_to", "host_n")


@query("WITH c AS (SELECT halo_id, count(*)::BIGINT AS npout FROM particles GROUP BY halo_id) SELECT h.id, coalesce(npout, 0) AS npout, (sum(coalesce(npout, 0)) OVER (ORDER BY slab, h.id) - coalesce(npout, 0))::BIGINT AS npstart FROM halos h LEFT JOIN c ON c.halo_id = h.id", "hp")
def subsample_index_exclusive(spark, d):
    return _ranges(spark, d).select("id", "npout", "npstart")


def _ranges(spark, d):
    c = particles(spark, d).groupBy(F.col("halo_id").alias("id")).agg(F.count("*").alias("npout"))
    return catalog.particle_ranges(halos(spark, d).select("id", "slab", "n").join(c, "id", "left").fillna(0, "npout"))


@query(
    """WITH c AS (SELECT id, n % 7 AS a, n % 5 AS b FROM halos), u AS (SELECT id, 0 AS ab, a AS np FROM c UNION ALL SELECT id, 1, b FROM c)
SELECT id, ab, np, (sum(np) OVER (ORDER BY ab, id) - np)::BIGINT AS npstart FROM u""",
    "h",
)
def subsample_index_ab(spark, d):
    h = halos(spark, d).select("id", F.explode(F.array(F.struct(F.lit(0).alias("ab"), (F.col("n") % 7).alias("np")), F.struct(F.lit(1).alias("ab"), (F.col("n") % 5).alias("np")))).alias("e")).select("id", "e.*")
    return ranks.prefix_sum(h, "np", ["ab", "id"], "npstart").select("id", "ab", "np", "npstart")


def _rows(spark, d):
    """Particles with a row number in (halo, pid) order inside the slab's file, as a file would hold them."""
    p = particles(spark, d).withColumn("slab", (F.col("halo_id") % 8).cast("int"))
    return ranks.ordered_index(p, ["slab", "halo_id", "pid", "price"], by="slab", out="row").withColumn("ab", F.lit("A"))


_ROWS = "r AS (SELECT *, (row_number() OVER (PARTITION BY halo_id % 8 ORDER BY halo_id, pid, price) - 1)::BIGINT AS row FROM particles)"


@query(f"WITH {_ROWS} SELECT halo_id, row, pid, weight FROM r", "p")
def halo_particle_range_join(spark, d):
    p = checkpointed(_rows(spark, d))  # the file: its rows are numbered once
    h = p.groupBy("slab", F.col("halo_id").alias("id")).agg(F.min("row").alias("npstartA"), F.count("*").alias("npoutA"))
    return catalog.halo_particles(h, p.select("slab", "ab", "row", "pid", "weight"), ["A"]).select("halo_id", "row", "pid", "weight")


@query(
    "WITH k AS (SELECT p.*, h.merged_to FROM particles p JOIN halos h ON p.halo_id = h.id), u AS (SELECT halo_id AS id, 0 AS src, pid, weight FROM k WHERE merged_to < 0 UNION ALL SELECT merged_to, 1, pid, weight FROM k WHERE merged_to >= 0) SELECT id, src, count(*)::BIGINT AS np, sum(weight)::BIGINT AS w FROM u GROUP BY id, src",
    "hp",
)
def halo_particle_union_clean(spark, d):
    h = halos(spark, d).select(F.col("id").alias("halo_id"), "merged_to")
    k = particles(spark, d).join(h, "halo_id")
    own = k.where("merged_to < 0").select(F.col("halo_id").alias("id"), F.lit(0).alias("src"), "weight")
    merged = k.where("merged_to >= 0").select(F.col("merged_to").alias("id"), F.lit(1).alias("src"), "weight")
    return own.unionByName(merged).groupBy("id", "src").agg(F.count("*").alias("np"), F.sum("weight").alias("w"))


@query(
    f"""WITH {_CLEAN}, q AS (SELECT c.id, c.n_total // 500 AS mass_bin, p.pid, p.dx * p.dx + p.dy * p.dy + p.dz * p.dz AS d2 FROM c JOIN particles p ON p.halo_id = c.id WHERE c.n_total > 0)
SELECT mass_bin, count(*)::BIGINT AS n, max(d2)::BIGINT AS d2, max_by(id, d2 * 1000000000::HUGEINT - id) AS id FROM q GROUP BY mass_bin""",
    "hp",
)
def particle_farthest_from_center(spark, d):
    c = _cleaned(spark, d).where("n_total > 0").select("id", F.floor(F.col("n_total") / 500).cast("long").alias("mass_bin"))
    p = particles(spark, d).select(F.col("halo_id").alias("id"), F.expr("dx * dx + dy * dy + dz * dz").alias("d2"))
    q = c.join(p, "id")
    best = F.max(F.struct("d2", (-F.col("id")).alias("k")))
    return q.groupBy("mass_bin").agg(F.count("*").alias("n"), best.alias("b")).select("mass_bin", "n", "b.d2", (-F.col("b.k")).alias("id"))


@query("SELECT halo_id, count(*)::BIGINT AS np, sum(weight)::BIGINT AS w FROM particles GROUP BY halo_id", "p")
def particle_count_per_halo(spark, d):
    return particles(spark, d).groupBy("halo_id").agg(F.count("*").alias("np"), F.sum("weight").alias("w"))


@query("WITH e AS (SELECT user_id AS pid, day(ts) <= 15 AS early, event_type AS host FROM events) SELECT b.pid, count(*)::BIGINT AS n_late, (SELECT count(*) FROM e a WHERE a.early AND a.pid = b.pid)::BIGINT AS n_early FROM e b WHERE NOT b.early GROUP BY b.pid")
def track_pid_across_epochs(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("pid"), (F.dayofmonth("ts") <= 15).alias("early"))
    late, early = (e.where(F.col("early") == v).groupBy("pid").agg(F.count("*").alias(n)) for v, n in ((False, "n_late"), (True, "n_early")))
    return late.join(early, "pid", "left").select("pid", "n_late", F.coalesce("n_early", F.lit(0)).alias("n_early"))


@query("WITH c AS (SELECT user_id AS pid, event_type AS host, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY n DESC, host) AS k FROM c) SELECT pid, host, n::BIGINT AS n FROM r WHERE k = 1")
def track_main_host(spark, d):
    c = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("user_id").alias("pid"), F.col("event_type").alias("host")).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), "host")).alias("b")
    return c.groupBy("pid").agg(best).select("pid", "b.host", (-F.col("b.m")).alias("n"))


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name = 'NATION_3' OR n_nationkey = 7")
def meta_lookup(spark, d):
    n, r = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "region"))
    return n.where("n_name = 'NATION_3' or n_nationkey = 7").join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@query("SELECT n_nationkey AS sim, 'name' AS key, r_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT n_nationkey, 'nation', n_name FROM nation UNION ALL SELECT n_nationkey, 'region', n_regionkey::VARCHAR FROM nation")
def meta_merge_state(spark, d):
    n, r = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "region"))
    j = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    param = F.create_map(F.lit("name"), F.col("n_name"), F.lit("nation"), F.col("n_name"))
    state = F.create_map(F.lit("name"), F.col("r_name"), F.lit("region"), F.col("n_regionkey").cast("string"))
    merged = F.map_concat(F.map_filter(param, lambda k, _: k != "name"), state)  # state wins
    return j.select(F.col("n_nationkey").alias("sim"), F.explode(merged)).select("sim", "key", "value")


# --- ranks, order ---


@query("SELECT id, n FROM halos ORDER BY n DESC, id LIMIT 100", "h")
def topn_by_mass(spark, d):
    return ranks.top_n(halos(spark, d).select("id", "n"), "n", "id", 100)


@query("WITH r AS (SELECT id, n, row_number() OVER (ORDER BY id) - 1 AS i FROM halos) SELECT id, n FROM r WHERE i % 100 = 0", "h")
def stride_sample(spark, d):
    return ranks.ordered_index(halos(spark, d).select("id", "n"), ["id"]).where("_index % 100 = 0").select("id", "n")


@query("SELECT max_by(id, n * 100000000 - id) AS id, max(n) AS n FROM halos", "h")
def largest_halo(spark, d):
    return halos(spark, d).agg(F.max(F.struct("n", (-F.col("id")).alias("k"))).alias("m")).select((-F.col("m.k")).alias("id"), F.col("m.n").alias("n"))


@query("SELECT n // 500 AS mass_bin, median(id * 13 % 1009)::DOUBLE AS conc FROM halos GROUP BY 1", "h")
def median_concentration_by_mass(spark, d):
    return halos(spark, d).groupBy(F.floor(F.col("n") / 500).cast("long").alias("mass_bin")).agg(F.median(F.expr("id * 13 % 1009")).alias("conc"))


_BIN = "CASE " + " ".join(f"WHEN mass > {a}::DOUBLE AND mass < {b}::DOUBLE THEN {i}" for i, (a, b) in enumerate(zip(MASS_EDGES, MASS_EDGES[1:]))) + " END"


def _rank_sql(value: str) -> str:
    return f"""WITH b AS (SELECT id, {value} AS v, {_BIN} AS b FROM halos), r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY v, id) - 1 AS k, count(*) OVER (PARTITION BY b) AS c FROM b)
SELECT id, CASE WHEN b IS NULL OR c = 1 THEN 0.0::DOUBLE ELSE round(k::DOUBLE / (c - 1)::DOUBLE - 0.5::DOUBLE, 9) END AS rank FROM r"""


_CONC = "((16000 + id * 17 % 16000)::DOUBLE * (n / 1e6::DOUBLE) / 32000.0::DOUBLE * 1000.0::DOUBLE) / ((1 + id * 13 % 16000)::DOUBLE * (n / 1e6::DOUBLE) / 32000.0::DOUBLE * 1000.0::DOUBLE)"


def _concentration(spark, d):
    """halos with conc, the ratio of two decoded radii."""
    r100 = F.col("n") / 1e6
    r98, r25 = (decode.ratio(F.expr(f"cast({word} as short)"), r100, BOX) for word in ("16000 + id * 17 % 16000", "1 + id * 13 % 16000"))
    return halos(spark, d).withColumn("conc", r98 / r25)


@query(_rank_sql(_CONC), "h")
def deltac_rank(spark, d):
    h = _concentration(spark, d).select("id", "mass", "conc")
    return ranks.rank_in_bins(h, "conc", "mass", MASS_EDGES, "id").select("id", F.round("rank", 9).alias("rank"))


@query(_rank_sql("(floor(x / 100)::BIGINT * 49 + floor(y / 100)::BIGINT * 7 + floor(z / 100)::BIGINT) * 31 % 343"), "h")
def shear_rank_lookup(spark, d):
    h = halos(spark, d).select("id", "mass", *[F.floor(F.col(a) / 100).cast("long").alias(f"i{a}") for a in "xyz"])
    cells = spark.range(1000).select(F.floor(F.col("id") / 100).alias("ix"), F.floor(F.col("id") / 10 % 10).alias("iy"), (F.col("id") % 10).alias("iz")).withColumn("v", F.expr("(ix * 49 + iy * 7 + iz) * 31 % 343"))
    h = h.join(F.broadcast(cells), ["ix", "iy", "iz"])  # 1,000 cells
    return ranks.rank_in_bins(h, "v", "mass", MASS_EDGES, "id").select("id", F.round("rank", 9).alias("rank"))


def _particle_rank_sql(value: str) -> str:
    return f"""WITH r AS (SELECT halo_id, pid, price, row_number() OVER (PARTITION BY halo_id ORDER BY {value}, pid, price) - 1 AS k, count(*) OVER (PARTITION BY halo_id) AS c FROM particles)
SELECT halo_id, pid, price, CASE WHEN c = 1 THEN 0.0::DOUBLE ELSE round(2.0::DOUBLE * k / (c - 1) - 1.0::DOUBLE, 9) END AS rank FROM r"""


def _particle_rank(spark, d, value):
    p = particles(spark, d).withColumn("val", F.expr(value))
    return ranks.group_rank(p, "halo_id", "val", ["pid", "price"], "rank").select("halo_id", "pid", "price", F.round("rank", 9).alias("rank"))


for _name, _value in (("particle_rank_radius", "dx * dx + dy * dy + dz * dz"), ("particle_rank_velocity", "v * v"), ("particle_rank_radial", "v * dx + v * dy")):

    def _f(spark, d, value=_value):
        return _particle_rank(spark, d, value)

    _f.__name__ = _name
    query(_particle_rank_sql(_value), "p")(_f)


@query(
    "SELECT a.halo_id, a.pid, min((a.dx - b.dx) * (a.dx - b.dx) + (a.dy - b.dy) * (a.dy - b.dy) + (a.dz - b.dz) * (a.dz - b.dz))::BIGINT AS d2 FROM (SELECT DISTINCT halo_id, pid, dx, dy, dz FROM particles) a LEFT JOIN (SELECT DISTINCT halo_id, pid, dx, dy, dz FROM particles) b ON a.halo_id = b.halo_id AND a.pid <> b.pid GROUP BY a.halo_id, a.pid",
    "p",
)
def particle_nn_distance(spark, d):
    p = particles(spark, d).select(F.col("halo_id").alias("grp"), F.col("pid").alias("id"), *[F.col(f"d{a}").alias(a) for a in "xyz"]).distinct()
    return neighbors.nearest_other(p).select(F.col("grp").alias("halo_id"), F.col("id").alias("pid"), "d2")


# --- neighbours ---

_D2 = """dd AS (SELECT a.id AS i, b.id AS j, a.n AS an, b.n AS bn, abs(a.x - b.x) AS ux, abs(a.y - b.y) AS uy, abs(a.z - b.z) AS uz FROM s a, s b),
d3 AS (SELECT i, j, an, bn, least(ux, 1000.0::DOUBLE - ux) AS px, least(uy, 1000.0::DOUBLE - uy) AS py, least(uz, 1000.0::DOUBLE - uz) AS pz FROM dd)"""


# All pairs of halos, and every bin; tests/test_pairs.py has them in numpy.
_SOME = "s AS (SELECT * FROM halos)"


@query(f"WITH {_SOME}, {_D2} SELECT s.id, coalesce(sum(bn) FILTER (px * px + py * py + pz * pz <= 6400 AND px * px + py * py + pz * pz > 900 AND an > 1000), 0)::BIGINT AS menv FROM s LEFT JOIN d3 ON s.id = d3.i GROUP BY s.id", "h")
def menv_two_apertures(spark, d):
    h = halos(spark, d).select("id", "x", "y", "z", F.col("n").alias("mass"))
    return neighbors.environment_mass(h, 30.0, 80.0, BOX, 1000).select("id", "menv")


@query(
    f"""WITH {_SOME}, {_D2}, e AS (SELECT s.id, s.mass, coalesce(sum(bn) FILTER (px * px + py * py + pz * pz <= 6400 AND px * px + py * py + pz * pz > 900 AND an > 1000), 0)::BIGINT AS menv FROM s LEFT JOIN d3 ON s.id = d3.i GROUP BY ALL),
b AS (SELECT id, menv AS v, {_BIN} AS b FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY v, id) - 1 AS k, count(*) OVER (PARTITION BY b) AS c FROM b)
SELECT id, CASE WHEN b IS NULL OR c = 1 THEN 0.0::DOUBLE ELSE round(k::DOUBLE / (c - 1)::DOUBLE - 0.5::DOUBLE, 9) END AS rank FROM r""",
    "h",
)
def fenv_rank(spark, d):
    """Halos as they are prepared for mocks: the rank of the mass around each."""
    return mocks.prepare(halos(spark, d), BOX, MASS_EDGES, 30.0, 80.0, 2.0e12).select("id", F.round("fenv", 9).alias("rank"))


_EDGES = [5.0, 20.0, 40.0, 80.0]
_R2 = "px * px + py * py + pz * pz"
_SBIN = "CASE " + " ".join(f"WHEN {_R2} >= {a * a}::DOUBLE AND {_R2} < {b * b}::DOUBLE THEN {i}" for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:]))) + " END"
_RP2 = "px * px + py * py"
_RPBIN = "CASE " + " ".join(f"WHEN {_RP2} >= {a * a}::DOUBLE AND {_RP2} < {b * b}::DOUBLE THEN {i}" for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:]))) + " END"


def _every(rest: str, where: str) -> str:
    return f"WITH {_SOME}, {_D2}, c AS (SELECT {_SBIN} AS bin, count(*)::BIGINT AS npairs FROM d3 WHERE {where} AND ({_SBIN}) IS NOT NULL GROUP BY 1), b AS (SELECT unnest(range({len(_EDGES) - 1}))::INT AS bin), e AS (SELECT bin, coalesce(npairs, 0)::BIGINT AS npairs FROM b LEFT JOIN c USING (bin)) {rest}"


@query(_every("SELECT * FROM e", "i <> j"), "h")
def pair_counts_s(spark, d):
    s = halos(spark, d)
    return neighbors.pair_counts(s, s, _EDGES, BOX, True)


_XI = f"WITH {_SOME}, {_D2}, c AS (SELECT {_RPBIN} AS rp_bin, (floor(pz)::INT // 5)::INT AS pi_bin, count(*)::BIGINT AS npairs FROM d3 WHERE i <> j AND ({_RPBIN}) IS NOT NULL AND pz < 40 GROUP BY 1, 2), k AS (SELECT count(*)::DOUBLE AS n FROM s), g AS (SELECT a.i::INT AS rp_bin, b.i::INT AS pi_bin, coalesce(npairs, 0)::BIGINT AS npairs FROM range({len(_EDGES) - 1}) a(i), range(8) b(i) LEFT JOIN c ON c.rp_bin = a.i AND c.pi_bin = b.i), v AS (SELECT rp_bin, pi_bin, npairs, npairs / (n * n * CASE " + " ".join(f"WHEN rp_bin = {i} THEN {3.141592653589793 * (b * b - a * a) * 5 / 1e9 * 2!r}::DOUBLE" for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:]))) + " END) - 1 AS xi FROM g, k)"


@query(_XI + " SELECT rp_bin, pi_bin, npairs, round(xi, 6) AS xi FROM v", "h")
def xi_rppi(spark, d):
    s = halos(spark, d)
    return neighbors.xi_rp_pi(s, s, _EDGES, 40, 5, BOX).withColumn("xi", F.round("xi", 6))


@query(_XI + " SELECT rp_bin, round(2.0::DOUBLE * 5 * sum(xi), 4) AS wp FROM v GROUP BY rp_bin", "h")
def wp_rp(spark, d):
    s = halos(spark, d)
    return neighbors.projected(neighbors.xi_rp_pi(s, s, _EDGES, 40, 5, BOX), 5).withColumn("wp", F.round("wp", 4))


_SMU = f"WITH {_SOME}, {_D2}, c AS (SELECT {_SBIN} AS s_bin, least(floor(pz / sqrt({_R2}) * 10)::INT, 9) AS mu_bin, count(*)::BIGINT AS npairs FROM d3 WHERE i <> j AND ({_SBIN}) IS NOT NULL GROUP BY 1, 2), k AS (SELECT count(*)::DOUBLE AS n FROM s), g AS (SELECT a.i::INT AS s_bin, b.i::INT AS mu_bin, coalesce(npairs, 0)::BIGINT AS npairs FROM range({len(_EDGES) - 1}) a(i), range(10) b(i) LEFT JOIN c ON c.s_bin = a.i AND c.mu_bin = b.i), v AS (SELECT s_bin, mu_bin, npairs / (n * n * CASE " + " ".join(f"WHEN s_bin = {i} THEN {4 / 3 * 3.141592653589793 * (b**3 - a**3) / 10 / 1e9!r}::DOUBLE" for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:]))) + " END) - 1 AS xi FROM g, k)"


@query(_SMU + " SELECT s_bin, round(sum(xi * 0.1::DOUBLE), 5) AS xi_0, round(sum(5 * 0.1::DOUBLE * xi * (1.5::DOUBLE * ((mu_bin + 0.5::DOUBLE) / 10) * ((mu_bin + 0.5::DOUBLE) / 10) - 0.5::DOUBLE)), 5) AS xi_2 FROM v GROUP BY s_bin", "h")
def xi_multipoles(spark, d):
    s = halos(spark, d)
    xi = neighbors.xi_s_mu(s, s, _EDGES, 10, BOX)
    both = neighbors.multipole(xi, 10, 0).join(neighbors.multipole(xi, 10, 2), "s_bin")
    return both.select("s_bin", F.round("xi_0", 5).alias("xi_0"), F.round("xi_2", 5).alias("xi_2"))


@query(
    f"""WITH w AS ({_XI} SELECT rp_bin, 2.0::DOUBLE * 5 * sum(xi) AS wp FROM v GROUP BY rp_bin),
m AS ({_SMU} SELECT s_bin, sum(xi * 0.1::DOUBLE) AS xi_0, sum(5 * 0.1::DOUBLE * xi * (1.5::DOUBLE * ((mu_bin + 0.5::DOUBLE) / 10) * ((mu_bin + 0.5::DOUBLE) / 10) - 0.5::DOUBLE)) AS xi_2 FROM v GROUP BY s_bin),
u AS (SELECT 0 AS part_no, 'wp' AS part, rp_bin AS bin, wp AS value FROM w UNION ALL SELECT 1, 'xi_0', s_bin, xi_0 FROM m UNION ALL SELECT 2, 'xi_2', s_bin, xi_2 FROM m)
SELECT (row_number() OVER (ORDER BY part_no, bin) - 1)::INT AS place, part, bin, round(value, 4) AS value FROM u""",
    "h",
)
def wp_xi_vector(spark, d):
    """Projected clustering and multipoles as the one vector that a likelihood takes."""
    s = halos(spark, d)
    wp = neighbors.projected(neighbors.xi_rp_pi(s, s, _EDGES, 40, 5, BOX), 5)
    return neighbors.statistics_vector(wp, neighbors.xi_s_mu(s, s, _EDGES, 10, BOX), 10).withColumn("value", F.round("value", 4))


@query(_every("SELECT t1, t2, bin, npairs FROM e, (VALUES ('even', 'odd'), ('odd', 'even')) t(t1, t2)", "i % 2 = 0 AND j % 2 = 1"), "h")
def xi_cross_tracer(spark, d):
    s = halos(spark, d)
    both = neighbors.tracer_pairs({"even": s.where("id % 2 = 0"), "odd": s.where("id % 2 = 1")}, lambda a, b, auto: neighbors.pair_counts(a, b, _EDGES, BOX, auto))
    return both.where("t1 <> t2")


@query(_every(f"SELECT bin, npairs, round(npairs / ((SELECT count(*) * (count(*) - 1) FROM s) * CASE " + " ".join(f"WHEN bin = {i} THEN {4 / 3 * 3.141592653589793 * (b**3 - a**3) / 1e9!r}::DOUBLE" for i, (a, b) in enumerate(zip(_EDGES, _EDGES[1:]))) + " END) - 1, 6) AS xi FROM e", "i <> j"), "h")
def emulator_xi(spark, d):
    return neighbors.emulator_xi(halos(spark, d), _EDGES, BOX).withColumn("xi", F.round("xi", 6))


# --- meshes ---


def _axis_sql(a: str, n: int) -> str:
    u = f"({a} * {n / 1000.0!r}::DOUBLE)"
    c = f"round_even({u}, 0)"
    w = {-1: f"0.5::DOUBLE * (0.5::DOUBLE - ({u} - {c})) * (0.5::DOUBLE - ({u} - {c}))", 0: f"0.75::DOUBLE - ({u} - {c}) * ({u} - {c})", 1: f"0.5::DOUBLE * (0.5::DOUBLE + ({u} - {c})) * (0.5::DOUBLE + ({u} - {c}))"}
    return " UNION ALL ".join(f"SELECT id, n, (({c})::INT + {k} + {n}) % {n} AS i, {v} AS w FROM halos" for k, v in w.items())


@query(f"WITH gx AS ({_axis_sql('x', 16)}), gy AS ({_axis_sql('y', 16)}) SELECT gx.i AS ix, gy.i AS iy, round(sum((gx.w * gy.w)::DECIMAL(28, 12))::DOUBLE, 6) AS density FROM gx JOIN gy USING (id) GROUP BY 1, 2", "h")
def tsc_density_2d(spark, d):
    return mesh.deposit(halos(spark, d), 16, BOX, axes="xy").withColumn("density", F.round("density", 6))


_T3 = f"WITH gx AS ({_axis_sql('x', 8)}), gy AS ({_axis_sql('y', 8)}), gz AS ({_axis_sql('z', 8)})"


@query(_T3 + " SELECT gx.i AS ix, gy.i AS iy, gz.i AS iz, round(sum((gx.w * gy.w * gz.w)::DECIMAL(28, 12))::DOUBLE, 6) AS density FROM gx JOIN gy USING (id) JOIN gz USING (id) GROUP BY 1, 2, 3", "h")
def tsc_density_3d(spark, d):
    return mesh.deposit(halos(spark, d), 8, BOX).withColumn("density", F.round("density", 6))


@query(_T3 + " SELECT gx.i AS ix, gy.i AS iy, gz.i AS iz, round(sum((gx.n * gx.w * gy.w * gz.w)::DECIMAL(28, 12))::DOUBLE, 5) AS density FROM gx JOIN gy USING (id) JOIN gz USING (id) GROUP BY 1, 2, 3", "h")
def tsc_weighted(spark, d):
    return mesh.deposit(halos(spark, d), 8, BOX, weight=F.col("n")).withColumn("density", F.round("density", 5))


def _cic_sql(a: str, n: int) -> str:
    u = f"({a} * {n / 1000.0!r}::DOUBLE)"
    return f"SELECT id, floor({u})::INT % {n} AS i, 1.0::DOUBLE - ({u} - floor({u})) AS w FROM halos UNION ALL SELECT id, (floor({u})::INT + 1) % {n}, {u} - floor({u}) FROM halos"


@query(f"WITH gx AS ({_cic_sql('x', 8)}), gy AS ({_cic_sql('y', 8)}), gz AS ({_cic_sql('z', 8)}) SELECT gx.i AS ix, gy.i AS iy, gz.i AS iz, round(sum((gx.w * gy.w * gz.w)::DECIMAL(28, 12))::DOUBLE, 6) AS density FROM gx JOIN gy USING (id) JOIN gz USING (id) GROUP BY 1, 2, 3", "h")
def cic_density(spark, d):
    return mesh.deposit(halos(spark, d), 8, BOX, "cic").withColumn("density", F.round("density", 6))


@query("WITH c AS (SELECT floor(x / 125)::INT AS ix, floor(y / 125)::INT AS iy, floor(z / 125)::INT AS iz, count(*) AS k FROM halos GROUP BY 1, 2, 3) SELECT ix, iy, iz, round(k::DOUBLE * 512 / (SELECT sum(k) FROM c)::DOUBLE - 1, 6) AS delta FROM c", "h")
def overdensity_normalised(spark, d):
    c = halos(spark, d).groupBy(*[F.floor(F.col(a) / 125).cast("int").alias(f"i{a}") for a in "xyz"]).agg(F.count("*").cast("double").alias("density"))
    return mesh.overdensity(c, 512).select("ix", "iy", "iz", F.round("delta", 6).alias("delta"))


@query("WITH c AS (SELECT least(floor(x * 16 / 1000.0::DOUBLE)::INT, 15) AS part, count(*)::BIGINT AS n FROM halos GROUP BY 1) SELECT part, n, (sum(n) OVER (ORDER BY part) - n)::BIGINT AS start FROM c", "h")
def partition_starts(spark, d):
    return mesh.partition_starts(halos(spark, d), 16, BOX)


# --- occupations ---

_ERF = "CASE WHEN {x} >= 0 THEN 1 ELSE -1 END * (1 - ((((1.061405429::DOUBLE / (1 + 0.3275911::DOUBLE * abs({x})) - 1.453152027::DOUBLE) / (1 + 0.3275911::DOUBLE * abs({x})) + 1.421413741::DOUBLE) / (1 + 0.3275911::DOUBLE * abs({x})) - 0.284496736::DOUBLE) / (1 + 0.3275911::DOUBLE * abs({x})) + 0.254829592::DOUBLE) / (1 + 0.3275911::DOUBLE * abs({x})) * exp(-({x}) * ({x})))"
_LCUT, _ECUT = "((13.0::DOUBLE - log10(mass)) / (1.41421356::DOUBLE * 0.6::DOUBLE))", "(log10(mass) - 12.5::DOUBLE)"
_PL = f"0.5::DOUBLE * (1 - {_ERF.format(x=_LCUT)}) * 0.9::DOUBLE"
_EX = f"({_ECUT} * 2.0::DOUBLE / sqrt(2.0::DOUBLE))"
_PE = f"2 * (0.5::DOUBLE - 1 / 100.0::DOUBLE) * 0.3989422804014327::DOUBLE * exp(-{_ECUT} * {_ECUT} / 2) * 0.5::DOUBLE * (1 + {_ERF.format(x=_EX)})"
_U = "((id * 7919 + 104729) % 10007)::DOUBLE / 10007::DOUBLE"

LRG = hod.Tracer(13.0, 13.6, 0.6, 1.0, 0.4, ic=0.9)
ELG = hod.Tracer(12.5, 13.2, 1.0, 1.0, 1.0, p_max=0.5, q=100.0, gamma=2.0, beside={"LRG": (13.0, 0.8), "ELG": (12.9, 0.9)})


def _drawn(spark, d):
    return halos(spark, d).withColumn("u", unit(F.col("id"), 1))


@query(f"SELECT id FROM halos WHERE {_U} <= {_PL}", "h")
def hod_centrals_lrg(spark, d):
    return hod.centrals(_drawn(spark, d), {"LRG": LRG}).select("id")


@query(f"WITH m AS (SELECT id, {_U} AS u, {_PL} AS l, {_PE} AS e FROM halos) SELECT id, CASE WHEN u <= l THEN 'LRG' ELSE 'ELG' END AS tracer FROM m WHERE u <= l + e", "h")
def hod_centrals_multitracer(spark, d):
    return hod.centrals(_drawn(spark, d), {"LRG": LRG, "ELG": ELG}).select("id", "tracer")


@query("WITH m AS (SELECT id, x, y, z + vz * 0.01::DOUBLE + 500.0::DOUBLE AS t FROM halos) SELECT id, x, y, round(CASE WHEN t < 0 THEN t + 1000 WHEN t >= 1000 THEN t - 1000 ELSE t END - 500.0::DOUBLE, 6) AS z FROM m", "h")
def hod_rsd_box(spark, d):
    return hod.redshift_space(halos(spark, d), 0.01, BOX).select("id", "x", "y", F.round("z", 6).alias("z"))


@query("WITH m AS (SELECT id, x, y, z, x + 10 AS a, y + 10 AS b, z + 10 AS c, vx, vy, vz FROM halos), q AS (SELECT *, 0.01::DOUBLE * (vx * a + vy * b + vz * c) / (a * a + b * b + c * c) AS p FROM m) SELECT id, round(x + p * a, 6) AS x, round(y + p * b, 6) AS y, round(z + p * c, 6) AS z FROM q", "h")
def hod_rsd_lightcone(spark, d):
    m = hod.redshift_space(halos(spark, d), 0.01, BOX, (-10.0, -10.0, -10.0))
    return m.select("id", *[F.round(a, 6).alias(a) for a in "xyz"])


_PS = "CASE WHEN mass > 0.4::DOUBLE * 1e13::DOUBLE THEN pow((mass - 0.4::DOUBLE * 1e13::DOUBLE) / 39810717055349.69::DOUBLE, 1.0::DOUBLE) ELSE 0 END * 0.5::DOUBLE * (1 - " + _ERF.format(x=_LCUT) + ")"
_PU = "((pid * 7919 + 209458) % 10007)::DOUBLE / 10007::DOUBLE"


def _sat(spark, d):
    h = halos(spark, d).select(F.col("id").alias("halo_id"), "mass", F.col("n").alias("halo_n"))
    p, h = dealt("halo_id", particles(spark, d).drop("weight"), h)
    return p.join(h, "halo_id").withColumn("u", unit(F.col("pid"), 2)).withColumn("weight", F.lit(1.0))


@query(f"WITH j AS (SELECT halo_id, pid, price, mass FROM particles JOIN halos ON halo_id = id) SELECT halo_id, pid, price FROM j WHERE {_PU} <= {_PS} * 0.9::DOUBLE", "hp")
def hod_satellites(spark, d):
    return hod.satellites(_sat(spark, d), {"LRG": LRG}).select("halo_id", "pid", "price")


def _elg(m1: str, alpha: str) -> str:
    return f"CASE WHEN mass > 3162277660168.3794::DOUBLE THEN pow((mass - 3162277660168.3794::DOUBLE) / {m1}::DOUBLE, {alpha}::DOUBLE) ELSE 0 END"


@query(
    f"""WITH m AS (SELECT id, mass, {_U} AS u, {_PL} AS l, {_PE} AS e FROM halos), c AS (SELECT id, mass, CASE WHEN u <= l THEN 'LRG' WHEN u <= l + e THEN 'ELG' END AS cen FROM m),
j AS (SELECT halo_id, pid, price, CASE WHEN cen = 'LRG' THEN {_elg(repr(10**13.0), "0.8")} WHEN cen = 'ELG' THEN {_elg(repr(10**12.9), "0.9")} ELSE {_elg(repr(10**13.2), "1.0")} END AS p FROM particles JOIN c ON halo_id = id)
SELECT halo_id, pid, price FROM j WHERE {_PU} <= p""",
    "hp",
)
def hod_satellites_conformity(spark, d):
    cen = hod.centrals(_drawn(spark, d), {"LRG": LRG, "ELG": ELG})
    return hod.satellites(_sat(spark, d), {"ELG": ELG}, cen).select("halo_id", "pid", "price")


@query(f"WITH c AS (SELECT count(*) AS n FROM halos WHERE {_U} <= {_PL}), j AS (SELECT mass, pid FROM particles JOIN halos ON halo_id = id), s AS (SELECT count(*) AS n FROM j WHERE {_PU} <= {_PS} * 0.9::DOUBLE) SELECT 'LRG' AS tracer, (c.n + s.n)::BIGINT AS n, c.n::BIGINT AS n_cent, round(1 - c.n::DOUBLE / (c.n + s.n), 9) AS f_sat FROM c, s", "hp")
def hod_satellite_fraction(spark, d):
    c = hod.centrals(_drawn(spark, d), {"LRG": LRG}).select("tracer", F.lit(True).alias("is_central"))
    s = hod.satellites(_sat(spark, d), {"LRG": LRG}).select("tracer", F.lit(False).alias("is_central"))
    return hod.satellite_fraction(c.unionByName(s)).withColumn("f_sat", F.round("f_sat", 9))


@query("SELECT least(n // 500, 9)::INT AS b_n, (id * 13 % 1009 // 101)::INT AS b_c, sum(owner)::BIGINT AS weight FROM halos WHERE n <= 5000 AND id * 13 % 1009 <= 909 GROUP BY 1, 2 HAVING min(id * 13 % 1009 // 101) < 9", "h")
def hmf_histogram2d(spark, d):
    h = halos(spark, d).withColumn("c", F.expr("id * 13 % 1009")).where("n <= 5000 and c < 909")
    return hod.mass_histogram(h, {"n": [500.0 * i for i in range(11)], "c": [101.0 * i for i in range(10)]}, "owner")


@query(f"WITH h AS (SELECT n // 100 AS b, count(*)::DOUBLE AS w FROM halos GROUP BY 1), m AS (SELECT w, pow(10.0::DOUBLE, 11 + b / 20.0::DOUBLE) AS mass FROM h) SELECT round(sum(w * {_PL}), 4) AS n_cent, round(sum(w * {_PS} * 0.9::DOUBLE), 4) AS n_sat FROM m", "h")
def ngal_lrg(spark, d):
    h = halos(spark, d).groupBy(F.floor(F.col("n") / 100).alias("b")).agg(F.count("*").cast("double").alias("weight"))
    return hod.mean_number(h, "LRG", LRG, 11.0 + F.col("b") / 20.0).select(F.round("n_cent", 4).alias("n_cent"), F.round("n_sat", 4).alias("n_sat"))


# --- samples ---


@query("WITH p AS (SELECT id, 1 / (1 + 0.1::DOUBLE * exp(-(log10(mass) - 11.8::DOUBLE) * 10)) AS p, log10(mass) AS x FROM halos) SELECT id, round(1 / CASE WHEN x > 13 THEN 1 ELSE p END, 6) AS multi FROM p WHERE ((id * 7919 + 104729) % 10007)::DOUBLE / 10007::DOUBLE < CASE WHEN x > 13 THEN 1 ELSE p END", "h")
def subsample_halos_prob(spark, d):
    h = _drawn(spark, d)
    return sampling.subsample_halos(h, F.col("u"), False).select("id", F.round("multi", 6).alias("multi"))


@query("WITH r AS (SELECT halo_id, pid, price, row_number() OVER (PARTITION BY halo_id ORDER BY pid * 7919 % 10007, pid, price) AS k, CASE WHEN mass < 1e11::DOUBLE THEN 0 ELSE least(n, least(floor(1 + 1.5::DOUBLE * pow(10.0::DOUBLE, log10(mass) - 12.5::DOUBLE)), 100)) END AS want FROM particles JOIN halos ON halo_id = id) SELECT halo_id, pid, price FROM r WHERE k <= want", "hp")
def submask_particles_topn(spark, d):
    p = _sat(spark, d).withColumn("key", F.struct("pid", "price"))
    return sampling.sample_particles(p, sampling.particle_targets(F.col("mass"), F.col("halo_n"), True), F.expr("pid * 7919 % 10007"), "key").select("halo_id", "pid", "price")


@query("SELECT id, round(mass / 1e12 * mass / 1e12 + mass / 1e12 * 2 / 3 * 0.5::DOUBLE + 0.05::DOUBLE, 6) AS k0, round(mass / 1e12 * (4 / 3.0::DOUBLE * 0.5::DOUBLE) + 4 / 7.0::DOUBLE * 0.25::DOUBLE, 6) AS k2 FROM halos", "h")
def kaiser_poles(spark, d):
    k0, k2, _ = variates.kaiser_poles(F.col("mass") / 1e12, 0.5)
    return halos(spark, d).select("id", F.round(k0, 6).alias("k0"), F.round(k2, 6).alias("k2"))


@query("SELECT id, round(x * x + y * y / 5 + z * z / 9, 3) AS cov FROM halos", "h")
def multipole_cov(spark, d):
    return halos(spark, d).select("id", F.round(variates.multipole_cov(F.col("x"), F.col("y"), F.col("z"), 0), 3).alias("cov"))


# --- without SQL: transforms and draws ---


@query()
def hod_nfw_satellites(spark, d):
    h = halos(spark, d).withColumn("r98", F.lit(1.5)).withColumn("conc", F.lit(6.0)).withColumn("sigma_v", F.lit(300.0))
    return hod.nfw_satellites(h, "LRG", LRG, BOX, 5)


@query()
def lc_randoms(spark, d):
    """Ten random points for each halo, in the shell that the halos of an octant of the box span."""
    h = halos(spark, d).select(F.sqrt(F.expr("x * x + y * y + z * z")).alias("r")).where("r between 300 and 800")
    span = h.agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).first()
    return sampling.random_shell(spark, 10 * span.n, span.lo or 0.0, span.hi or 0.0, 11, octant=True).where(sampling.in_box(0, 700))


from . import queries_catalog, queries_fields, queries_more, queries_spatial  # noqa: E402, F401  they register more

__all__ = ["ORACLE_SQL", "QUERIES"]
