"""End-to-end plans: prepare subsamples, populate mocks, measure clustering."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.math import uniform
from ..operators import hod
from ..operators.neighbors import environment_mass, multipole, projected, statistics_vector, xi_rp_pi, xi_s_mu
from ..operators.power import power_spectrum
from ..operators.ranks import rank_in_bins
from ..session import checkpointed
from ..sources.storage import Stored


def prepare(halos: DataFrame, box: float, mass_edges: list[float], r_inner: float = 2.0, r_outer: float = 5.0, m_cut: float = 1e11, seed: int = 600) -> DataFrame:
    """halos with fenv, deltac ranks and stored uniform numbers.

    Write the result (sinks.write_prepared) and stage what is read back: its plan is long, and every statistic of every mock
    would analyse and run it again.
    """
    env = checkpointed(environment_mass(halos, r_inner, r_outer, box, m_cut))  # the ranks read it several times
    h = halos.join(env, "id")
    h = rank_in_bins(h, "menv", "mass", mass_edges, "id", "fenv")
    if "conc" in h.columns:
        h = rank_in_bins(h, "conc", "mass", mass_edges, "id", "deltac")
    return h.withColumn("u", uniform(F.col("id"), seed))


@dataclass
class Mocks:
    """Staged halos and particles, from which any parameters make a mock."""

    halos: DataFrame
    particles: DataFrame | None
    box: float
    velz_to_kms: float
    tracers: dict[str, hod.Tracer] = field(default_factory=lambda: {"LRG": hod.LRG, "ELG": hod.ELG})
    keep: bool = True

    def __post_init__(self) -> None:
        """Staged tables are kept, in memory as far as it goes, as every set of parameters and every statistic reads them; close() lets them go.

        Without keep they are read anew each time, as tables stored by halo should be: what is kept in memory has no buckets.
        """
        if not self.keep:
            return
        self.halos = self.halos.persist()
        self.particles = None if self.particles is None else self.particles.persist()

    @classmethod
    def stored(cls, spark: SparkSession, store: Stored, box: float, velz_to_kms: float, **more) -> Mocks:
        """Mocks of tables stored by halo: halos and particles meet bucket by bucket."""
        return cls(*store.tables(spark), box, velz_to_kms, keep=False, **more)

    def close(self) -> None:
        for df in (self.halos, self.particles):
            if df is not None:
                df.unpersist()

    def run(self, rsd: bool = True, reseed: int | None = None, nfw: bool = False, origin: tuple[float, float, float] | None = None, **profile: float) -> DataFrame:
        """id, tracer, x, y, z, vx, vy, vz, mass, is_central.

        Centrals move by alpha_c times the halo's stored deviation (columns exp_x, exp_y, exp_z), satellites are biased by
        alpha_s around the halo's velocity (columns hvx, hvy, hvz of particles); without these columns velocities stay.
        With nfw, satellites are drawn on profiles, whose options (exp_frac, exp_scale, nfw_rescale, f_sigv) may be given.
        """
        h = self.halos if reseed is None else self.halos.withColumn("u", uniform(F.col("id"), reseed))
        cols = ["id", "tracer", "x", "y", "z", "vx", "vy", "vz", "mass"]
        cen = hod.centrals(h, self.tracers)
        out = cen
        if "exp_x" in cen.columns:
            out = hod.velocity_bias(cen, self._by_tracer("alpha_c"), ("exp_x", "exp_y", "exp_z"))
        out = out.select(*cols, F.lit(True).alias("is_central"))
        if nfw:
            around = h.join(cen.select("id", F.col("tracer").alias("central")), "id", "left")
            for i, (n, t) in enumerate(self.tracers.items()):
                s = hod.nfw_satellites(around, n, t, self.box, (reseed or 0) + 100 * (i + 1), **profile)
                out = out.unionByName(s.select(*cols, F.lit(False).alias("is_central")))
        elif self.particles is not None:
            p = self.particles if reseed is None else self.particles.withColumn("u", uniform(F.col("pid"), reseed + 1))
            s = hod.satellites(p, self.tracers, cen).withColumn("id", F.col("halo_id"))
            if "hvx" in s.columns:
                s = hod.satellite_velocity(s, self._by_tracer("alpha_s"))
            out = out.unionByName(s.select(*cols, F.lit(False).alias("is_central")))
        return hod.redshift_space(out, 1 / self.velz_to_kms, self.box, origin) if rsd else out

    def _by_tracer(self, parameter: str):
        out = F.lit(0.0)
        for n, t in self.tracers.items():
            out = F.when(F.col("tracer") == n, F.lit(float(getattr(t, parameter)))).otherwise(out)
        return out

    def clustering(self, mock: DataFrame, kind: str, **args) -> DataFrame:
        """Statistics of all pairs of tracers, with columns t1 and t2 (t1 <= t2 in the tracers' order).

        The mock is kept (persist) as each pair reads it several times; the caller unpersists it.
        """
        mock = mock.persist()
        names = [t for t in hod.TRACERS if t in self.tracers]
        out = None
        for i, a in enumerate(names):
            for b in names[i:]:
                x, y = ((mock.where(F.col("tracer") == t).withColumn("id", F.xxhash64("id", "is_central", "x", "y", "z"))) for t in (a, b))
                if kind == "xirppi":
                    one = xi_rp_pi(x, y, box=self.box, auto=a == b, **args)
                elif kind == "wp":
                    one = projected(xi_rp_pi(x, y, box=self.box, pi_size=1, auto=a == b, **args))
                elif kind == "multipole":
                    n_mu = args.get("n_mu", 50)
                    xi = xi_s_mu(x, y, args["edges"], n_mu, self.box, a == b)
                    one = multipole(xi, n_mu, 0).join(multipole(xi, n_mu, 2), "s_bin")
                elif kind == "vector":
                    one = statistics_vector(projected(xi_rp_pi(x, y, args["rp"], args["pimax"], 1, self.box, a == b)), xi_s_mu(x, y, args["edges"], args.get("n_mu", 50), self.box, a == b), args.get("n_mu", 50), args.get("orders", (0, 2)))
                elif kind == "power":
                    one = power_spectrum(x, self.box, other=None if a == b else y, **args)
                else:
                    raise ValueError(f"unknown statistic {kind}")
                one = one.withColumn("t1", F.lit(a)).withColumn("t2", F.lit(b))
                out = one if out is None else out.unionByName(one)
        return out
