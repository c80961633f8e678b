"""Many parameter sets at once: expected numbers and likelihoods of a table of samples, each in one aggregate."""

from __future__ import annotations

from dataclasses import fields, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import hod

#: Samples up to which they are sent to every task; more meet the masses in blocks of both sides.
BROADCAST_SAMPLES = 100_000


def tracer_of(samples: DataFrame, base: hod.Tracer) -> hod.Tracer:
    """A tracer whose parameters are the columns of samples; those that are not there are base's."""
    mine = {f.name: F.col(f.name) for f in fields(base) if f.name in samples.columns}
    ranks = ("acent", "bcent", "ccent", "asat", "bsat", "csat")
    if bad := [n for n in mine if n in ranks or n == "beside"]:
        raise ValueError(f"not a parameter of a sample: {bad}")
    return replace(base, **mine)


def expected_numbers(halos: DataFrame, samples: DataFrame, name: str, base: hod.Tracer) -> DataFrame:
    """sample, n_cent, n_sat: what each sample (sample and any of a tracer's parameters) expects of these halos (mass).

    Halos of one mass count the same, and masses are multiples of a particle's: the halos are read once and counted by mass, and
    the samples meet the masses.  A sample gets zeros where there are no halos; null masses do not count.
    """
    masses = halos.where("mass is not null").groupBy("mass").agg(F.count("*").alias("_n"))
    t = tracer_of(samples, base)
    few = samples.count() <= BROADCAST_SAMPLES
    each = masses.crossJoin(F.broadcast(samples) if few else samples)  # the query set against all masses
    cen, sat = hod.mean_central(name, t, F.col("mass")), hod.mean_satellite(name, t, F.col("mass"))
    ic = F.lit(t.ic)
    each = each.select("sample", (F.col("_n") * cen * ic).alias("c"), (F.col("_n") * sat * ic).alias("s"))
    found = each.groupBy("sample").agg(F.sum("c").alias("n_cent"), F.sum("s").alias("n_sat"))
    return samples.select("sample").join(found, "sample", "left").na.fill(0.0, ["n_cent", "n_sat"])


def log_likelihoods(data: DataFrame, theory: DataFrame, inverse: DataFrame) -> DataFrame:
    """sample, lnl: hod.log_likelihood() for each sample of theory (sample, pair, i, value); all samples in one aggregate."""
    r = theory.select("sample", "pair", "i", F.col("value").alias("_b")).join(data.select("pair", "i", F.col("value").alias("_a")), ["pair", "i"]).select("sample", "pair", "i", (F.col("_b") - F.col("_a")).alias("r"))
    s = r.select("sample", "pair", F.col("i").alias("j"), F.col("r").alias("s"))
    return r.join(inverse, ["pair", "i"]).join(s, ["sample", "pair", "j"]).groupBy("sample").agg((F.lit(-0.5) * F.sum(F.col("r") * F.col("value") * F.col("s"))).alias("lnl"))


def log_probabilities(samples: DataFrame, bounds: dict[str, tuple[float, float]], theory: DataFrame, data: DataFrame, inverse: DataFrame) -> DataFrame:
    """sample, lnp of every sample: its log-likelihood if it lies inside the bounds, else minus infinity."""
    inside = hod.in_range(samples, bounds).select("sample", "inside")
    lnl = log_likelihoods(data, theory.join(inside.where("inside").select("sample"), "sample", "left_semi"), inverse)
    return inside.join(lnl, "sample", "left").select("sample", F.when(F.col("inside"), F.coalesce("lnl", F.lit(0.0))).otherwise(F.lit(float("-inf"))).alias("lnp"))
