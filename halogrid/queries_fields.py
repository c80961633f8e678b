"""Queries over wave modes and meshes, with their SQL: transforms are three sums over one axis each."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from .functions.math import legendre
from .operators import fields, mesh, modes, power, variates
from .registry import query
from .sources.adapters import BOX, halos

_PI = "3.141592653589793::DOUBLE"


def _tsc_sql(n: int) -> str:
    """CTEs up to delta (ix, iy, iz, v): the overdensity of halos in all cells."""

    def axis(a: str) -> str:
        u = f"({a} * {n / BOX!r}::DOUBLE)"
        c = f"round_even({u}, 0)"
        w = (f"0.5::DOUBLE * (0.5::DOUBLE - ({u} - {c})) * (0.5::DOUBLE - ({u} - {c}))", f"0.75::DOUBLE - ({u} - {c}) * ({u} - {c})", f"0.5::DOUBLE * (0.5::DOUBLE + ({u} - {c})) * (0.5::DOUBLE + ({u} - {c}))")
        return " UNION ALL ".join(f"SELECT id, (({c})::INT + {k - 1} + {n}) % {n} AS i, {v} AS w FROM halos" for k, v in enumerate(w))

    return f"""gx AS ({axis("x")}), gy AS ({axis("y")}), gz AS ({axis("z")}),
rho AS (SELECT gx.i AS ix, gy.i AS iy, gz.i AS iz, sum((gx.w * gy.w * gz.w)::DECIMAL(28, 12))::DOUBLE AS d FROM gx JOIN gy USING (id) JOIN gz USING (id) GROUP BY 1, 2, 3),
delta AS (SELECT a.i AS ix, b.i AS iy, c.i AS iz, coalesce(d * {n**3} / (SELECT sum(d) FROM rho), 0) - 1 AS v FROM range({n}) a(i), range({n}) b(i), range({n}) c(i) LEFT JOIN rho ON rho.ix = a.i AND rho.iy = b.i AND rho.iz = c.i)"""


def _forward_sql(n: int, source: str = "delta") -> str:
    """CTEs up to fk (x, y, z, re, im): the transform over the half mesh, not normalised, of a table (ix, iy, iz, v)."""
    turn = f"(-2 * {_PI} / {n})"
    steps = [f"f1 AS (SELECT ix, iy, k.i AS z, sum(v * cos({turn} * iz * k.i)) AS re, sum(v * sin({turn} * iz * k.i)) AS im FROM {source}, range({n // 2 + 1}) k(i) GROUP BY 1, 2, 3)"]
    for at, old, new, was in (("iy", "ix", "y", "f1"), ("ix", "y", "x", "f2")):
        rest = "ix, z" if at == "iy" else "y, z"
        name = "f2" if at == "iy" else "fk"
        steps.append(f"{name} AS (SELECT {rest}, k.i AS {new}, sum(re * cos({turn} * {at} * k.i) - im * sin({turn} * {at} * k.i)) AS re, sum(re * sin({turn} * {at} * k.i) + im * cos({turn} * {at} * k.i)) AS im FROM {was}, range({n}) k(i) GROUP BY {rest}, k.i)")
    return ", ".join(steps)


def _signed(c: str, n: int) -> str:
    return f"(CASE WHEN {c} < {n // 2} THEN {c} ELSE {c} - {n} END)"


def _bins_sql(x: str, edges: list[float]) -> str:
    """Bins open below and closed above, the first closed, nothing at or over the last edge."""
    last = len(edges) - 2
    return "CASE " + " ".join(f"WHEN {x} {'>' if i else '>='} {edges[i]!r}::DOUBLE AND {x} {'<=' if i < last else '<'} {edges[i + 1]!r}::DOUBLE THEN {i}" for i in range(last + 1)) + " END"


def _mode_sql(n: int) -> str:
    a, b = _signed("a.i", n), _signed("b.i", n)
    return f"""modes AS (SELECT a.i::INT AS ix, b.i::INT AS iy, c.i::INT AS iz, CASE WHEN c.i = 0 THEN 1 ELSE 2 END AS w, {a} * {a} + {b} * {b} AS p2, {a} * {a} + {b} * {b} + c.i * c.i AS i2 FROM range({n}) a(i), range({n}) b(i), range({n // 2 + 1}) c(i)),
m AS (SELECT *, CASE WHEN i2 > 0 THEN (iz * iz)::DOUBLE / i2 ELSE 0 END AS mu2 FROM modes)"""


# --- modes of the halos' mesh ---

_N, _STEP = 16, 2 * math.pi / BOX
_K = [0.0, 0.012, 0.024, 0.045]
_MU = [0.0, 0.3, 0.6, 1.0]


def _field_sql(n: int) -> str:
    """CTEs up to f: modes with re, im and p, the power of the halos' overdensity in units of the box."""
    return f"""{_tsc_sql(n)}, {_forward_sql(n)}, {_mode_sql(n)},
f AS (SELECT m.*, re / {float(n) ** 3!r}::DOUBLE AS re, im / {float(n) ** 3!r}::DOUBLE AS im, (re * re + im * im) / {float(n) ** 6!r}::DOUBLE AS p FROM m JOIN fk ON x = ix AND y = iy AND z = iz)"""


def _modes(spark, d):
    return power.field_modes(halos(spark, d), _N, BOX, compensated=False).withColumn("p", F.expr("re * re + im * im"))


_KB, _MB = _bins_sql("i2", [(e / _STEP) ** 2 for e in _K]), _bins_sql("mu2", [e * e for e in _MU])


@query(f"WITH {_field_sql(_N)}, b AS (SELECT *, {_KB} AS k_bin, coalesce({_MB}, {len(_MU) - 2}) AS mu_bin FROM f) SELECT k_bin, mu_bin, sum(w)::BIGINT AS n_modes, round(sum(w * p) / sum(w), 10) AS mean, round(sum(w * sqrt(i2) * {_STEP!r}::DOUBLE) / sum(w), 9) AS k_avg FROM b WHERE k_bin IS NOT NULL GROUP BY 1, 2", "h")
def mode_bins_kmu(spark, d):
    b = modes.bin_k_mu(_modes(spark, d), "p", _STEP, _K, _MU)
    return b.select("k_bin", "mu_bin", "n_modes", F.round("mean", 10).alias("mean"), F.round("k_avg", 9).alias("k_avg"))


@query(f"WITH {_field_sql(_N)}, b AS (SELECT *, {_bins_sql('p2', [(e / _STEP) ** 2 for e in _K])} AS k_bin, {_bins_sql('iz * iz', [(0.04 * i / 4 / _STEP) ** 2 for i in range(5)])} AS pi_bin FROM f) SELECT k_bin, pi_bin, sum(w)::BIGINT AS n_modes, round(sum(w * p) / sum(w), 10) AS mean FROM b WHERE k_bin IS NOT NULL AND pi_bin IS NOT NULL GROUP BY 1, 2", "h")
def mode_bins_kppi(spark, d):
    return modes.bin_k_pi(_modes(spark, d), "p", _STEP, _K, 0.04, 4).withColumn("mean", F.round("mean", 10))


_TABLE = {0: [5.0, 4.0, 2.0, 1.0, 0.5], 2: [0.0, 1.0, 1.5, 1.0, 0.25], 4: [0.0, 0.125, 0.5, 0.25, 0.125]}
_XS = [0.01, 0.02, 0.03, 0.04, 0.05]


def _interp_sql(ys: list[float]) -> str:
    k = f"(sqrt(i2) * {_STEP!r}::DOUBLE)"
    f = f"(({k} - {_XS[0]}::DOUBLE) / {_XS[1] - _XS[0]!r}::DOUBLE)"
    t = "[" + ", ".join(f"{y}::DOUBLE" for y in ys) + "]"
    return f"CASE WHEN {k} <= {_XS[0]}::DOUBLE THEN {ys[0]}::DOUBLE WHEN {k} >= {_XS[-1]}::DOUBLE THEN {ys[-1]}::DOUBLE ELSE {t}[floor({f})::INT + 1] + ({f} - floor({f})) * ({t}[floor({f})::INT + 2] - {t}[floor({f})::INT + 1]) END"


@query(
    f"""WITH {_field_sql(_N)}, e AS (SELECT *, ({_interp_sql(_TABLE[0])}) + ({_interp_sql(_TABLE[2])}) * (1.5::DOUBLE * mu2 - 0.5::DOUBLE) + ({_interp_sql(_TABLE[4])}) * (4.375::DOUBLE * mu2 * mu2 - 3.75::DOUBLE * mu2 + 0.375::DOUBLE) AS model FROM f)
SELECT ix, iy, iz, round(model, 9) AS power, round(p - model / 1e6::DOUBLE, 10) + 0.0::DOUBLE AS excess FROM e""",
    "h",
)
def pole_expand_linear_interp(spark, d):
    """A model's multipoles at each mode of the halos' mesh, and the mode's power beyond them."""
    m = modes.expand_poles(_modes(spark, d), _STEP, _XS, _TABLE)
    return m.select("ix", "iy", "iz", F.round("power", 9).alias("power"), (F.round(F.col("p") - F.col("power") / 1e6, 10) + 0.0).alias("excess"))


@query(f"WITH {_field_sql(_N)} SELECT ix, iy, iz, round(re * mu2, 9) + 0.0::DOUBLE AS re, round(im * mu2, 9) + 0.0::DOUBLE AS im FROM f", "h")
def delta_mu2(spark, d):
    m = modes.delta_mu2(_modes(spark, d), "re", "im")
    return m.select("ix", "iy", "iz", *[(F.round(c, 9) + 0.0).alias(c) for c in ("re", "im")])


@query(
    f"""WITH {_field_sql(_N)}, s AS (SELECT *, exp(-i2 * {_STEP * _STEP * 40.0 * 40.0 / 2!r}::DOUBLE) AS s, {_KB} AS k_bin FROM f),
b AS (SELECT k_bin, sum(w * sqrt(i2) * {_STEP!r}::DOUBLE) / sum(w) AS k, sum(w * p * s * s) / sum(w) AS ss, sum(w * p * s) / sum(w) AS ds, sum(w * p) / sum(w) AS dd FROM s WHERE k_bin IS NOT NULL GROUP BY 1)
SELECT k_bin, round(ss + 2 * 1.4::DOUBLE * ds + 1.4::DOUBLE * 1.4::DOUBLE * dd - 2 * 30 * k * k * ss - 2 * 1.4::DOUBLE * 30 * k * k * ds + 1e-5::DOUBLE, 10) AS p FROM b""",
    "h",
)
def bias_combine_spectra(spark, d):
    """The model spectrum of a linear and a derivative bias, from the spectra of the halos' density and of the smoothed one."""
    s = modes.smoothing(_STEP, 40.0)
    m = modes.bin_k_mu(_modes(spark, d), "p", _STEP, _K, [0.0, 1.0], ss=F.col("p") * s * s, ds=F.col("p") * s)
    pairs = {("1cb", "1cb"): F.col("ss"), ("delta", "1cb"): F.col("ds"), ("delta", "delta"): F.col("mean")}
    return m.select("k_bin", F.round(variates.combine_spectra(F.col("k_avg"), pairs, [1.4, 0.0, 0.0, 30.0], 1e-5), 10).alias("p"))


@query(
    f"""WITH {_field_sql(_N)}, s AS (SELECT *, {_KB} AS k_bin FROM f), b AS (SELECT k_bin, sum(w * p) / sum(w) AS dd, sum(w * p * mu2) / sum(w) AS md, sum(w * p * mu2 * mu2) / sum(w) AS mm FROM s WHERE k_bin IS NOT NULL GROUP BY 1)
SELECT k_bin, round(0.64::DOUBLE * (2.25::DOUBLE * dd + 1.5::DOUBLE * md + 0.25::DOUBLE * mm), 10) AS p FROM b""",
    "h",
)
def kaiser_combine_spectra(spark, d):
    """The linear model in redshift space from the spectra of the halos' density and of mu squared times it."""
    field = _modes(spark, d)
    m = field.join(modes.delta_mu2(field, "re", "im").select("ix", "iy", "iz", F.col("re").alias("mre"), F.col("im").alias("mim")), ["ix", "iy", "iz"])
    m = modes.bin_k_mu(m, "p", _STEP, _K, [0.0, 1.0], md=F.expr("mre * re + mim * im"), mm=F.expr("mre * mre + mim * mim"))
    pairs = {("delta", "delta"): F.col("mean"), ("deltamu2", "delta"): F.col("md"), ("deltamu2", "deltamu2"): F.col("mm")}
    return m.select("k_bin", F.round(variates.combine_kaiser(0.0, pairs, 0.8, 1.5, 0.5), 10).alias("p"))


@query(f"WITH {_field_sql(_N)}, s AS (SELECT *, exp(-i2 * {_STEP * _STEP * 40.0 * 40.0 / 2!r}::DOUBLE) AS s FROM f) SELECT ix, iy, iz, round(re * s, 9) + 0.0::DOUBLE AS re, round(im * s, 9) + 0.0::DOUBLE AS im FROM s", "h")
def mode_smoothing(spark, d):
    s = modes.smoothing(_STEP, 40.0)
    return _modes(spark, d).select("ix", "iy", "iz", *[(F.round(F.col(c) * s, 9) + 0.0).alias(c) for c in ("re", "im")])


_KIN = [0.004 + 0.004 * i for i in range(11)]
#: Bins around the input wave numbers.
_AROUND = [0.002 + 0.004 * i for i in range(12)]
_LEG = {0: "1::DOUBLE", 2: "(1.5::DOUBLE * mu2 - 0.5::DOUBLE)", 4: "(4.375::DOUBLE * mu2 * mu2 - 3.75::DOUBLE * mu2 + 0.375::DOUBLE)"}


def _left_bins_sql(x: str, edges: list[float]) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {a!r}::DOUBLE AND {x} < {b!r}::DOUBLE THEN {i}" for i, (a, b) in enumerate(zip(edges, edges[1:]))) + " END"


def _window_sql() -> str:
    widths = [b - a for a, b in zip(_KIN, _KIN[1:])]
    widths.append(widths[-1])
    rows = ", ".join(f"({i}, {k!r}::DOUBLE, {float(k * k * w)!r}::DOUBLE)" for i, (k, w) in enumerate(zip(_KIN, widths)))
    pairs = " UNION ALL ".join(f"SELECT k_bin, {a} AS l, {b} AS lp, sum(w * {2 * a + 1} * {_LEG[a]} * {_LEG[b]}) / sum(w) AS s FROM o GROUP BY k_bin" for a in _LEG for b in _LEG)
    k = f"(sqrt(i2) * {_STEP!r}::DOUBLE)"
    fine = " UNION ALL ".join(f"SELECT i_in, {a} AS lp, sum(w * p * {2 * a + 1} * {_LEG[a]}) / sum(w) AS pole FROM v WHERE i_in IS NOT NULL GROUP BY i_in" for a in _LEG)
    return f"""WITH {_field_sql(_N)}, o AS (SELECT *, {_left_bins_sql(k, _K)} AS k_bin FROM m WHERE iz < {_N // 2}), s AS ({pairs}), e AS (SELECT k_bin, sum(w * {k}) / sum(w) AS k_eff FROM o GROUP BY k_bin),
i AS (SELECT i_in, weight, {_left_bins_sql('k', _K)} AS k_bin FROM (VALUES {rows}) t(i_in, k, weight)), q AS (SELECT k_bin, i_in, weight / sum(weight) OVER (PARTITION BY k_bin) AS share FROM i WHERE k_bin IS NOT NULL),
v AS (SELECT *, {_bins_sql("i2", [(e / _STEP) ** 2 for e in _AROUND])} AS i_in FROM f), fine AS ({fine})
SELECT l, k_bin, round(sum(s * share * pole), 9) + 0.0::DOUBLE AS power, round(max(k_eff), 9) AS k_eff FROM s JOIN e USING (k_bin) JOIN q USING (k_bin) JOIN fine USING (lp, i_in) WHERE k_bin IS NOT NULL GROUP BY l, k_bin"""


@query(_window_sql(), "h")
def window_matrix(spark, d):
    """The halos' multipoles around the input wave numbers, through the mode coupling of the box."""
    m = modes.window_matrix(spark, _N, BOX, _K, _KIN)
    v = modes.bin_k(_modes(spark, d), _STEP, _AROUND)
    fine = v.groupBy(F.col("k_bin").alias("i_in")).agg(*[(F.sum(F.col("w") * F.col("p") * (2 * a + 1) * (F.lit(1.0) if a == 0 else legendre(modes.mu2(), a))) / F.sum("w")).alias(str(a)) for a in _LEG])
    fine = fine.unpivot("i_in", [str(a) for a in _LEG], "lp", "pole").withColumn("lp", F.col("lp").cast("int"))
    out = m.join(fine, ["lp", "i_in"]).groupBy("l", "k_bin").agg(F.sum(F.col("window") * F.col("pole")).alias("power"), F.max("k_eff").alias("k_eff"))
    return out.select("l", "k_bin", (F.round("power", 9) + 0.0).alias("power"), F.round("k_eff", 9).alias("k_eff"))


# --- transforms ---


def _spectrum_sql(n: int, n_k: int, n_mu: int) -> str:
    k, mu = power.k_mu_edges(n, BOX, math.pi * n / BOX, n_k, n_mu, False)
    s = lambda c: f"(1 - sin({_PI} * {c} / {n}) ** 2 + 2 / 15.0::DOUBLE * sin({_PI} * {c} / {n}) ** 4)"
    kb, mb = _bins_sql("i2", [float(e / _STEP) ** 2 for e in k]), _bins_sql("mu2", [float(e) ** 2 for e in mu])
    mids = "[" + ", ".join(repr(float(a + b) / 2) for a, b in zip(k, k[1:])) + "]"
    poles = ", ".join(f"sum(w * p * {2 * ell + 1} * {_LEG[ell]}) OVER (PARTITION BY k_bin) / sum(w) OVER (PARTITION BY k_bin) AS pole_{ell}" for ell in (0, 2, 4))
    return f"""WITH {_tsc_sql(n)}, {_forward_sql(n)}, {_mode_sql(n)},
p AS (SELECT m.*, (re * re + im * im) / {float(n) ** 6!r}::DOUBLE * 1e9::DOUBLE / ({s('ix')} * {s('iy')} * {s('iz')}) AS p FROM m JOIN fk ON x = ix AND y = iy AND z = iz),
b AS (SELECT *, {kb} AS k_bin, coalesce({mb}, {n_mu - 1}) AS mu_bin FROM p), t AS (SELECT *, {poles} FROM b WHERE k_bin IS NOT NULL),
g AS (SELECT k_bin, mu_bin, sum(w * sqrt(i2) * {_STEP!r}::DOUBLE) / sum(w) AS k_avg, sum(w * p) / sum(w) AS power, sum(w)::BIGINT AS n_modes FROM t GROUP BY 1, 2),
e AS (SELECT DISTINCT k_bin, pole_0, pole_2, pole_4 FROM (SELECT k_bin, round(pole_0, 4) AS pole_0, round(pole_2, 4) AS pole_2, round(pole_4, 4) AS pole_4 FROM t))
SELECT a.i::INT AS k_bin, c.i::INT AS mu_bin, {mids}[a.i + 1]::DOUBLE AS k_mid, round(k_avg, 9) AS k_avg, round(power, 4) AS power, coalesce(n_modes, 0)::BIGINT AS n_modes, pole_0, pole_2, pole_4
FROM range({n_k}) a(i), range({n_mu}) c(i) LEFT JOIN g ON g.k_bin = a.i AND g.mu_bin = c.i LEFT JOIN e ON e.k_bin = a.i"""


@query(_spectrum_sql(32, 16, 4), "h")
def power_spectrum_poles(spark, d):
    p = power.power_spectrum(halos(spark, d), BOX, 32, 16, 4, poles=(0, 2, 4))
    return p.select("k_bin", "mu_bin", "k_mid", F.round("k_avg", 9).alias("k_avg"), "n_modes", *[F.round(c, 4).alias(c) for c in ("power", "pole_0", "pole_2", "pole_4")])


def _mirror_sql(n: int, radius: float) -> str:
    sigma = radius * n / BOX
    reach = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    rows = ", ".join(f"({o}, {float(x)!r}::DOUBLE)" for o, x in zip(range(-reach, reach + 1), w / w.sum()))
    to = lambda c: f"least(({c} + o + {2 * n}) % {2 * n}, {2 * n - 1} - ({c} + o + {2 * n}) % {2 * n})"
    steps = [f"g AS (SELECT * FROM (VALUES {rows}) t(o, gw))"]
    for name, was, c in (("s1", "delta", "iz"), ("s2", "s1", "iy"), ("smooth", "s2", "ix")):
        keys = ", ".join(x if x != c else f"{to(c)} AS {c}" for x in ("ix", "iy", "iz"))
        # The weights are symmetric, so a cell gives to its neighbours what it would take from them.
        steps.append(f"{name} AS (SELECT ix, iy, iz, sum(v) AS v FROM (SELECT {keys}, v * gw AS v FROM {was}, g) GROUP BY 1, 2, 3)")
    return ", ".join(steps)


def _shear_sql(n: int, radius: float) -> str:
    a, b = _signed("x", n), _signed("y", n)
    turn = f"(2 * {_PI} / {n})"
    parts = {(i, j): f"t{i}{j}" for i in range(3) for j in range(i, 3)}
    k = ("a", "b", "c")
    values = ", ".join(f"sum(re * {k[i]} * {k[j]} / k2 * cos({turn} * a * q.i) - im * {k[i]} * {k[j]} / k2 * sin({turn} * a * q.i)) AS r{i}{j}, sum(re * {k[i]} * {k[j]} / k2 * sin({turn} * a * q.i) + im * {k[i]} * {k[j]} / k2 * cos({turn} * a * q.i)) AS i{i}{j}" for i, j in parts)
    second = ", ".join(f"sum(r{i}{j} * cos({turn} * b * q.i) - i{i}{j} * sin({turn} * b * q.i)) AS r{i}{j}, sum(r{i}{j} * sin({turn} * b * q.i) + i{i}{j} * cos({turn} * b * q.i)) AS i{i}{j}" for i, j in parts)
    # Modes off the planes c = 0 and c = n / 2 stand for two; of the plane c = n / 2 only the real part counts.
    third = ", ".join(f"sum(CASE WHEN c = {n // 2} THEN 1 ELSE 2 END * (r{i}{j} * cos({turn} * c * q.i) - i{i}{j} * sin({turn} * c * q.i))) / {n**3} AS t{i}{j}" for i, j in parts)
    return f"""WITH {_tsc_sql(n)}, {_mirror_sql(n, radius)}, {_forward_sql(n, "smooth")},
k AS (SELECT {a} AS a, {b} AS b, z AS c, re, im, ({a} * {a} + {b} * {b} + z * z)::DOUBLE AS k2 FROM fk WHERE x <> 0 AND y <> 0 AND z <> 0),
u1 AS (SELECT b, c, q.i AS ix, {values} FROM k, range({n}) q(i) GROUP BY b, c, q.i), u2 AS (SELECT c, ix, q.i AS iy, {second} FROM u1, range({n}) q(i) GROUP BY c, ix, q.i), u AS (SELECT ix, iy, q.i AS iz, {third} FROM u2, range({n}) q(i) GROUP BY ix, iy, q.i)
SELECT ix::INT AS ix, iy::INT AS iy, iz::INT AS iz, round(sqrt(greatest(0.5::DOUBLE * ((t00 - t11) ** 2 + (t11 - t22) ** 2 + (t22 - t00) ** 2) + 3 * (t01 * t01 + t02 * t02 + t12 * t12), 0)), 6) AS shear FROM u"""


@query(_shear_sql(16, 60.0), "h")
def tidal_shear(spark, d):
    return power.cells_frame(spark, power.tidal_shear(halos(spark, d), 16, BOX, 60.0), "shear").withColumn("shear", F.round("shear", 6))


@query(f"WITH {_tsc_sql(8)}, {_mirror_sql(8, 150.0)} SELECT ix::INT AS ix, iy::INT AS iy, iz::INT AS iz, round(v, 6) + 0.0::DOUBLE AS v FROM smooth", "h")
def density_smoothed(spark, d):
    cells = mesh.overdensity(mesh.deposit(halos(spark, d), 8, BOX), 512)
    return power.cells_frame(spark, power.smooth_density(power.dense(cells, 8, "delta", -1.0), 150.0, BOX), "v").withColumn("v", F.round("v", 6) + 0.0)


@query(f"WITH {_tsc_sql(8)}, t AS (SELECT sum(v) / 512 AS m, sum(v * v) / 512 AS m2 FROM delta) SELECT ix::INT AS ix, iy::INT AS iy, iz::INT AS iz, round(v - m, 6) + 0.0::DOUBLE AS delta, round(v * v - m2, 6) + 0.0::DOUBLE AS delta2 FROM delta, t", "h")
def initial_fields(spark, d):
    f = fields.initial_fields(_density(spark, d, 8), BOX)
    one = power.cells_frame(spark, f["delta"], "delta").join(power.cells_frame(spark, f["delta2"], "delta2"), ["ix", "iy", "iz"])
    return one.select("ix", "iy", "iz", (F.round("delta", 6) + 0.0).alias("delta"), (F.round("delta2", 6) + 0.0).alias("delta2"))


def _density(spark, d, n):
    return power.dense(mesh.overdensity(mesh.deposit(halos(spark, d), n, BOX), n**3), n, "delta", -1.0)


# --- control variates on spectra of the halos' own density (no SQL: fits and transforms; tests/test_variates.py) ---


def _spectra(spark, d, n=16, n_k=8):
    """Pairs and crosses of the fields of the halos' density, with the halos as tracers."""
    delta = _density(spark, d, n)
    edges = fields.default_edges(n, BOX, n_k)
    initial = {"1cb": delta, **fields.initial_fields(delta, BOX, 0.05)}
    ffts = {name: np.fft.rfftn(f) / n**3 for name, f in initial.items()}
    half = halos(spark, d).select(*[(F.col(a) - BOX / 2).alias(a) for a in "xyz"])
    pairs = fields.pair_spectra(ffts, BOX, 1.0, edges)
    cross = fields.tracer_spectra(half, ffts, n, BOX, 1.0, edges)
    return (edges[1:] + edges[:-1]) / 2, edges, pairs, cross


def _smoothed(k, spectra):
    """Spectra without their scatter, in the place of ensemble means: polynomials fitted to windows of each multipole."""
    return {key: np.stack([variates.smooth(np.nan_to_num(p), _FIT) for p in np.atleast_2d(poles)]) for key, poles in spectra.items()}


#: Cells a side and wave numbers of the spectra: a bin for each step, and more bins than the window that smooths beta; wave numbers of a fit.
_CELLS, _BINS, _FIT = 64, 32, 11


@query()
def zcv_apply(spark, d):
    k, _, pairs, cross = _spectra(spark, d, _CELLS, _BINS)
    pairs, measured = {key: r["poles"] for key, r in pairs.items()}, cross["tr", "tr"]["poles"]
    crosses = {a: r["poles"] for (a, b), r in cross.items() if a != "tr"}
    got = variates.zeldovich_variate(k, (pairs, crosses, measured), (pairs, crosses, measured), _smoothed(k, pairs), 5, 0.15, window=None)
    names = [f"{n}{ell}" for n in ("measured", "p", "rho") for ell in (0, 2, 4)]
    return spark.createDataFrame([(float(x), *(float(v) for t in (measured, got["reduced"], got["rho"]) for v in t[:, i])) for i, x in enumerate(k)], "k double, " + ", ".join(f"{n} double" for n in names))


@query()
def lcv_apply(spark, d):
    n = _CELLS
    delta = _density(spark, d, n)
    edges = fields.default_edges(n, BOX, _BINS)
    k = (edges[1:] + edges[:-1]) / 2
    pairs = {key: r["poles"] for key, r in fields.linear_spectra(delta, BOX, edges).items()}
    fk = np.fft.rfftn(delta) / n**3
    half = halos(spark, d).select(*[(F.col(a) - BOX / 2).alias(a) for a in "xyz"])
    cross = fields.tracer_spectra(half, {"delta": fk, "deltamu2": fields.times_mu2(fk)}, n, BOX, 1.0, edges)
    measured, theory = cross["tr", "tr"]["poles"], _smoothed(k, {0: pairs["delta", "delta"]})[0][0]
    got = variates.linear_variate(k, pairs, {a: r["poles"] for (a, b), r in cross.items() if a != "tr"}, measured, k, theory, 1.0, 0.5, 0.15)
    names = [f"{n}{ell}" for n in ("measured", "p") for ell in (0, 2, 4)]
    return spark.createDataFrame([(float(x), float(got["bias"]), *(float(v) for t in (measured, got["reduced"]) for v in t[:, i])) for i, x in enumerate(k)], "k double, bias double, " + ", ".join(f"{n} double" for n in names))
