"""Mock galaxies: one tracer at most for each halo and particle, velocities, redshift-space distortion, mean densities."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.math import n_cen_elg, n_cen_lrg, n_cen_qso, n_sat, normal, uniform, wrap
from .ranks import bin_index

TRACERS = ("LRG", "ELG", "QSO")


@dataclass
class Tracer:
    """Parameters of one tracer."""

    logm_cut: float
    logm1: float
    sigma: float
    alpha: float
    kappa: float
    ic: float = 1.0
    p_max: float = 0.33
    q: float = 100.0
    gamma: float = 4.12
    a_s: float = 1.0
    alpha_c: float = 0.0
    alpha_s: float = 1.0
    acent: float = 0.0
    bcent: float = 0.0
    ccent: float = 0.0
    asat: float = 0.0
    bsat: float = 0.0
    csat: float = 0.0
    s: float = 0.0
    s_v: float = 0.0
    s_p: float = 0.0
    s_r: float = 0.0
    #: ELG satellites next to an LRG or an ELG central: (logm1, alpha), by default as elsewhere.
    beside: dict[str, tuple[float, float]] = field(default_factory=dict)


#: Parameters of the usual two-tracer mock, fixed values.
LRG = Tracer(13.3, 14.3, 0.3, 1.0, 0.4, ic=0.97)
ELG = Tracer(11.75, 13.53, 0.58, 1.0, 1.0, p_max=0.33, q=100.0, gamma=4.12)
QSO = Tracer(12.21, 13.94, 0.56, 1.0, 1.0)


def _shifted(base: float, t: tuple[float, float, float]) -> Column | float:
    """A cut shifted by the concentration, environment and shear ranks; plain where no shift is asked for."""
    out: Column | float = base
    for c, name in zip(t, ("deltac", "fenv", "shear"), strict=True):
        if c:
            out = (out if isinstance(out, Column) else F.lit(out)) + F.lit(c) * F.col(name)
    return out


def mean_central(name: str, t: Tracer, mass: Column) -> Column:
    cut = _shifted(t.logm_cut, (t.acent, t.bcent, t.ccent if name == "ELG" else 0.0))
    if name == "LRG":
        return n_cen_lrg(mass, cut, t.sigma)
    return n_cen_elg(mass, t.p_max, t.q, cut, t.sigma, t.gamma) if name == "ELG" else n_cen_qso(mass, cut, t.sigma)


def assign(u: Column, probabilities: dict[str, Column]) -> Column:
    """First tracer, in the order LRG, ELG, QSO, whose summed probability reaches u; null if none."""
    total, out = None, None
    for name in TRACERS:
        if name in probabilities:
            total = probabilities[name] if total is None else total + probabilities[name]
            out = F.when(u <= total, F.lit(name)) if out is None else out.when(u <= total, F.lit(name))
    return out


def centrals(halos: DataFrame, tracers: dict[str, Tracer]) -> DataFrame:
    """halos (id, mass, u, [multi, deltac, fenv, shear]) that get a central, with its tracer."""
    multi = F.col("multi") if "multi" in halos.columns else F.lit(1.0)
    p = {n: mean_central(n, t, F.col("mass")) * F.lit(t.ic) * multi for n, t in tracers.items()}
    return halos.withColumn("tracer", assign(F.col("u"), p)).where("tracer is not null")


def mean_satellite(name: str, t: Tracer, mass: Column, beside: str | None = None) -> Column:
    logm1, alpha = t.beside.get(beside, (t.logm1, t.alpha))
    cut = _shifted(t.logm_cut, (t.asat, t.bsat, t.csat if name == "ELG" and not beside else 0.0))
    m1 = _shifted(logm1, (t.asat, t.bsat, t.csat if name == "ELG" and not beside else 0.0))
    ten = lambda x: F.pow(F.lit(10.0), x) if isinstance(x, Column) else 10**x
    out = n_sat(mass, ten(cut), t.kappa, ten(m1), alpha, t.a_s if name == "ELG" else 1.0)
    return out * n_cen_lrg(mass, cut, t.sigma) if name == "LRG" else out


def satellites(particles: DataFrame, tracers: dict[str, Tracer], central: DataFrame | None = None) -> DataFrame:
    """particles (halo_id, mass of the halo, u, weight, [ranks, ranksv, ranksp, ranksr]) that get a satellite.

    With a central table (id, tracer), ELG parameters depend on the tracer of the halo's central.
    """
    if central is not None:
        c = central.select(F.col("id").alias("halo_id"), F.col("tracer").alias("central"))
        particles = particles.join(c, "halo_id", "left")
    p = {}
    for n, t in tracers.items():
        mean = mean_satellite(n, t, F.col("mass"))
        if n == "ELG" and central is not None:
            mean = F.when(F.col("central") == "LRG", mean_satellite(n, t, F.col("mass"), "LRG")).when(F.col("central") == "ELG", mean_satellite(n, t, F.col("mass"), "ELG")).otherwise(mean)
        x = mean * F.col("weight") * F.lit(t.ic)
        terms = [(t.s, "ranks"), (t.s_v, "ranksv"), (t.s_p, "ranksp"), (t.s_r, "ranksr")]
        tilt = None
        for c, col in terms:
            if c:
                tilt = (F.lit(1.0) if tilt is None else tilt) + F.lit(c) * F.col(col)
        p[n] = x if tilt is None else x * tilt
    out = particles.withColumn("tracer", assign(F.col("u"), p)).where("tracer is not null")
    return out.drop("central") if central is not None else out


def nfw_satellites(halos: DataFrame, name: str, t: Tracer, box: float, seed: int, most: int = 200, exp_frac: float = 0.0, exp_scale: float = 1.0, nfw_rescale: float = 1.0, f_sigv: float = 1.0) -> DataFrame:
    """Poisson numbers of satellites on NFW profiles (columns x, y, z, vx, vy, vz, mass, r98, conc, sigma_v); tracers are drawn independently.

    The number inverts the Poisson distribution at a uniform number, by its terms up to `most`; a mean over most / 2 is split
    into equal ones below that, whose numbers are summed; the radius inverts the enclosed-mass function by bisection and is
    multiplied by nfw_rescale.  A share exp_frac of the satellites follows an exponential profile instead, with a mean radius of
    exp_scale scale radii (r98 / conc) and no end.  Velocities scatter around the halo's by 0.577 sigma_v f_sigv on each axis.
    With a column `central` (the tracer of the halo's central, or null) ELG means depend on it.
    """
    mean = mean_satellite(name, t, F.col("mass"))
    if name == "ELG" and "central" in halos.columns:
        mean = F.when(F.col("central") == "LRG", mean_satellite(name, t, F.col("mass"), "LRG")).when(F.col("central") == "ELG", mean_satellite(name, t, F.col("mass"), "ELG")).otherwise(mean)
    lam = mean * F.lit(t.ic)
    h = halos.withColumn("_parts", F.greatest(F.lit(1), F.ceil(lam / F.lit(most / 2.0)).cast("int"))).withColumn("_lam", lam / F.col("_parts"))
    h = h.withColumn("_us", F.transform(F.sequence(F.lit(1), F.col("_parts")), lambda i: uniform(F.when(i == 1, F.col("id")).otherwise(F.xxhash64("id", i)), seed)))
    steps = f"""aggregate(_us, 0, (total, _u) -> total + aggregate(sequence(1, {most}), named_struct('p', exp(-_lam), 'cdf', exp(-_lam), 'n', 0),
      (a, k) -> if(_u < a.cdf, a, named_struct('p', a.p * _lam / k, 'cdf', a.cdf + a.p * _lam / k, 'n', k)), a -> a.n))"""
    h = h.withColumn("_n", F.expr(steps)).where("_n > 0").withColumn("sat", F.explode(F.expr("sequence(1, _n)")))
    key = F.xxhash64("id", "sat")
    h = h.withColumn("_m", uniform(key, seed + 1) * F.expr("ln(1 + conc) - conc / (1 + conc)"))
    half = """aggregate(sequence(1, 40), named_struct('lo', 0D, 'hi', cast(conc as double)),
      (a, k) -> if(ln(1 + (a.lo + a.hi) / 2) - (a.lo + a.hi) / 2 / (1 + (a.lo + a.hi) / 2) < _m,
        named_struct('lo', (a.lo + a.hi) / 2, 'hi', a.hi), named_struct('lo', a.lo, 'hi', (a.lo + a.hi) / 2)), a -> (a.lo + a.hi) / 2)"""
    radius = F.expr(half) * F.lit(nfw_rescale)
    if exp_frac:
        radius = F.when(uniform(key, seed + 7) < exp_frac, -F.lit(exp_scale) * F.log(1.0 - uniform(key, seed + 8))).otherwise(radius)
    h = h.withColumn("_r", radius * F.col("r98") / F.col("conc"))
    c = uniform(key, seed + 2) * 2 - 1
    phi = uniform(key, seed + 3) * F.lit(6.283185307179586)
    s = F.sqrt(1 - c * c)
    way = {"x": s * F.cos(phi), "y": s * F.sin(phi), "z": c}
    pos = [F.pmod(F.col(a) + F.col("_r") * d, F.lit(box)).alias(a) for a, d in way.items()]
    vel = [(F.col(f"v{a}") + F.lit(0.577 * f_sigv) * F.col("sigma_v") * normal(key, seed + 4 + i)).alias(f"v{a}") for i, a in enumerate("xyz")]
    return h.select("id", "sat", *pos, *vel, "mass", F.lit(name).alias("tracer"))


def velocity_bias(df: DataFrame, alpha: float | Column, dev: tuple[str, str, str]) -> DataFrame:
    """Centrals: v + alpha * deviation."""
    for a, d in zip("xyz", dev, strict=True):
        df = df.withColumn(f"v{a}", F.col(f"v{a}") + (alpha if isinstance(alpha, Column) else F.lit(alpha)) * F.col(d))
    return df


def redshift_space(df: DataFrame, inv_velz_to_kms: float, box: float, origin: tuple[float, float, float] | None = None) -> DataFrame:
    """Moves z by the line-of-sight velocity and wraps it; with an origin, moves along the direction from it."""
    if origin is None:
        return df.withColumn("z", wrap(F.col("z") + F.col("vz") * F.lit(inv_velz_to_kms), box))
    d = [F.col(a) - F.lit(o) for a, o in zip("xyz", origin, strict=True)]
    n = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    proj = F.lit(inv_velz_to_kms) * (F.col("vx") * d[0] + F.col("vy") * d[1] + F.col("vz") * d[2]) / n
    moved = [(F.col(a) + proj * x / n).alias(a) for a, x in zip("xyz", d, strict=True)]
    return df.select(*[c for c in df.columns if c not in "xyz"], *moved)


def satellite_fraction(mock: DataFrame) -> DataFrame:
    return mock.groupBy("tracer").agg(F.count("*").alias("n"), F.sum(F.col("is_central").cast("long")).alias("n_cent")).withColumn("f_sat", 1 - F.col("n_cent") / F.col("n"))


def mass_histogram(halos: DataFrame, edges: dict[str, list[float]], weight: str) -> DataFrame:
    """Sparse weighted histogram over several columns; bins are closed on the left, the last on both sides."""
    b = [bin_index(F.col(c), e, "left").alias(f"b_{c}") for c, e in edges.items()]
    h = halos.select(*b, weight).na.drop(subset=[f"b_{c}" for c in edges])
    return h.groupBy(*[f"b_{c}" for c in edges]).agg(F.sum(weight).alias("weight"))


def mean_number(hist: DataFrame, name: str, t: Tracer, logm: Column) -> DataFrame:
    """n_cent, n_sat expected from a mass histogram (with deltac and fenv columns where parameters need them); ELG satellites mix both kinds of host."""
    m = F.pow(F.lit(10.0), logm)
    cen = mean_central(name, t, m)
    sat = mean_satellite(name, t, m)
    if name == "ELG" and "ELG" in t.beside:
        sat = sat * (F.lit(1.0) - cen) + mean_satellite(name, t, m, "ELG") * cen
    return hist.agg(F.sum(F.col("weight") * cen * t.ic).alias("n_cent"), F.sum(F.col("weight") * sat * t.ic).alias("n_sat"))


def evolved(t: Tracer, z: float, z_pivot: float, slopes: dict[str, float]) -> Tracer:
    """The tracer at a redshift: each named parameter (logm_cut, logm1) moves by its slope times 1 / (1 + z) - 1 / (1 + z_pivot)."""
    from dataclasses import replace

    step = 1 / (1 + z) - 1 / (1 + z_pivot)
    return replace(t, **{name: getattr(t, name) + slope * step for name, slope in slopes.items()})


def satellite_velocity(df: DataFrame, alpha: float | Column, halo: tuple[str, str, str] = ("hvx", "hvy", "hvz")) -> DataFrame:
    """Satellites: the halo's velocity and alpha times the particle's relative to it."""
    alpha = alpha if isinstance(alpha, Column) else F.lit(alpha)
    return df.withColumns({f"v{a}": F.col(h) + alpha * (F.col(f"v{a}") - F.col(h)) for a, h in zip("xyz", halo, strict=True)})


def stage(halos: DataFrame, particles: DataFrame, downsample: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Staged tables: halos with conc = r98 / r25 and multi, particles (halo_id) with the halo's columns and weight 1 / np / downsample.

    np is the halo's number of particles kept; particles of halos that are not there drop out.
    """
    h = halos.withColumn("conc", F.try_divide("r98", "r25"))
    h = h if "multi" in h.columns else h.withColumn("multi", F.lit(1.0))
    n = particles.groupBy("halo_id").agg(F.count("*").alias("np"))
    of = h.select(F.col("id").alias("halo_id"), *[F.col(c) for c in ("mass", "conc", "multi", "deltac", "fenv", "shear") if c in h.columns])
    p = particles.drop("mass", "weight").join(of, "halo_id").join(n, "halo_id")
    return h, p.withColumn("weight", F.lit(1.0) / F.col("np") / F.lit(downsample))


def stored_draws(halos: DataFrame, sigma: Column, seed: int) -> DataFrame:
    """halos with u and, for each axis, a two-sided exponential and a normal deviation of width sigma / sqrt(3), the same for any parameters."""
    scale = sigma / F.lit(3.0**0.5)
    out = {"u": uniform(F.col("id"), seed)}
    for i, a in enumerate("xyz"):
        v = uniform(F.col("id"), seed + 1 + i) - 0.5
        out[f"exp_{a}"] = -scale * F.signum(v) * F.log(F.lit(1.0) - 2.0 * F.abs(v))
        out[f"gauss_{a}"] = scale * normal(F.col("id"), seed + 10 + i)
    return halos.withColumns(out)


def in_range(parameters: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """parameters with `inside`: every bounded parameter is strictly between its bounds."""
    ok = F.lit(True)
    for name, (lo, hi) in bounds.items():
        ok = ok & (F.col(name) > lo) & (F.col(name) < hi)
    return parameters.withColumn("inside", F.coalesce(ok, F.lit(False)))


def log_likelihood(data: DataFrame, theory: DataFrame, inverse: DataFrame) -> DataFrame:
    """lnl: -1/2 of the residuals times the inverse covariance, summed over tracer pairs.

    data and theory: pair, i, value; inverse: pair, i, j, value.
    """
    r = data.select("pair", "i", F.col("value").alias("a")).join(theory.select("pair", "i", F.col("value").alias("b")), ["pair", "i"]).select("pair", "i", (F.col("b") - F.col("a")).alias("r"))
    s = r.select("pair", F.col("i").alias("j"), F.col("r").alias("s"))
    return r.join(inverse, ["pair", "i"]).join(s, ["pair", "j"]).agg((F.lit(-0.5) * F.sum(F.col("r") * F.col("value") * F.col("s"))).alias("lnl"))


def log_probability(parameters: dict[str, float], bounds: dict[str, tuple[float, float]], statistic, data: DataFrame, inverse: DataFrame) -> float:
    """-inf outside the bounds; else the likelihood of statistic(parameters), a theory table, against the data."""
    if not all(lo < parameters[n] < hi for n, (lo, hi) in bounds.items()):
        return float("-inf")
    return log_likelihood(data, statistic(parameters), inverse).first()[0]
