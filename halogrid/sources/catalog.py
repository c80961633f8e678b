"""Catalog scans: halo tables with field sets, filters, cleaning and particle subsamples, as lazy DataFrames."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.decode import decode_pack9, euler16_table, pid_fields, ratio, rvint_position, rvint_velocity, sigma_mid
from .layout import Layout, subsample_fraction

PID_FIELDS = ("pid", "lagr_pos", "tagged", "density", "lagr_idx")
_AXES = "xyz"
#: Fields that come with cleaning, those of its progenitors, and those of a light cone: fixed names of the format.
CLEAN_FIELDS = ("npstartA_merge", "npstartB_merge", "npoutA_merge", "npoutB_merge", "N_total", "N_merge", "haloindex", "is_merged_to")
PROGENITOR_FIELDS = ("N_mainprog", "vcirc_max_L2com_mainprog", "sigmav3d_L2com_mainprog", "haloindex_mainprog", "v_L2com_mainprog")
CONE_FIELDS = ("N", "N_interp", "npstartA", "npoutA", "index_halo", "origin", "pos_avg", "pos_interp", "vel_avg", "vel_interp", "redshift_interp")
_EIGEN = re.compile(r"(sigma[rnv]_eigenvecs)(Min|Mid|Maj)_(com|L2com)$")


def derived_fields(box: float, velz: float) -> dict[str, Column]:
    """User-facing halo fields as expressions of the raw columns; column pruning finds what they need."""
    out: dict[str, Column] = {}
    for c in ("com", "L2com"):
        r100 = F.col(f"r100_{c}")
        s3 = F.col(f"sigmav3d_{c}")
        for r in ("r10", "r25", "r33", "r50", "r67", "r75", "r90", "r95", "r98", "rvcirc_max"):
            out[f"{r}_{c}"] = ratio(F.col(f"{r}_{c}_i16"), r100, box)
        for name, raw in (("Min", "Min"), ("Maj", "Max"), ("rad", "rad"), ("tan", "tan")):
            out[f"sigmav{name}_{c}"] = ratio(F.col(f"sigmav{raw}_to_sigmav3d_{c}_i16"), s3, velz)
        out[f"sigmavMid_{c}"] = sigma_mid(s3 * velz, out[f"sigmavMaj_{c}"], out[f"sigmavMin_{c}"])
        out[f"sigmar_{c}"] = F.transform(F.col(f"sigmar_{c}_i16"), lambda v, r=r100: ratio(v, r, box))
        out[f"sigman_{c}"] = F.transform(F.col(f"sigman_{c}_i16"), lambda v: v / 32000.0)
        out[f"x_{c}"] = F.transform(F.col(f"x_{c}"), lambda v: v * box)
        out[f"r100_{c}"] = r100 * box
        for v in ("v",):
            out[f"{v}_{c}"] = F.transform(F.col(f"{v}_{c}"), lambda x: x * velz)
        for v in ("sigmav3d", "meanSpeed", "sigmav3d_r50", "meanSpeed_r50", "vcirc_max"):
            out[f"{v}_{c}"] = F.col(f"{v}_{c}") * velz
    for s in ("", "_L2max"):
        out[f"SO{s}_central_particle"] = F.transform(F.col(f"SO{s}_central_particle"), lambda v: v * box)
        out[f"SO{s}_radius"] = F.col(f"SO{s}_radius") * box
        out[f"SO{s}_central_density"] = F.col(f"SO{s}_central_density")
    for name in ("id", "npstartA", "npstartB", "npoutA", "npoutB", "ntaggedA", "ntaggedB", "N", "L0_N", "L2_N", "index_halo", "pos_avg", "vel_avg", "redshift_interp", "N_interp", "N_total", "N_merge", "haloindex", "is_merged_to"):
        out[name] = F.col(name)
    out["origin"] = F.pmod(F.col("origin"), F.lit(3))
    averaged = F.exists(F.col("pos_avg"), lambda v: v != 0)
    out["pos_interp"] = F.when(averaged, F.col("pos_avg")).otherwise(F.col("pos_interp"))
    out["vel_interp"] = F.when(averaged, F.col("vel_avg")).otherwise(F.col("vel_interp"))
    return out


def check_unpack_bits(bits: bool | str | list[str]) -> tuple[str, ...]:
    if isinstance(bits, bool):
        return PID_FIELDS if bits else ()
    names = (bits,) if isinstance(bits, str) else tuple(bits)
    if bad := [n for n in names if n not in PID_FIELDS]:
        raise ValueError(f"unknown fields of packed ids: {bad}")
    return names


def subsample_options(subsamples: bool | dict) -> dict[str, bool]:
    """A, B, pos, vel, pid, rvint, packedpid from a flag or a dict; rv means pos and vel."""
    if subsamples is False:
        return {}
    if subsamples is True:
        return {"A": True, "B": True, "pos": True, "vel": True, "pid": True}
    known = {"A", "B", "pos", "vel", "rv", "pid", "rvint", "packedpid"}
    if bad := set(subsamples) - known:
        raise ValueError(f"unknown subsample options: {sorted(bad)}")
    if bad := [k for k, v in subsamples.items() if not isinstance(v, bool)]:
        raise ValueError(f"subsample options are flags: {bad}")
    if "rv" in subsamples and ("pos" in subsamples or "vel" in subsamples):
        raise ValueError("rv cannot be combined with pos or vel")
    out = dict(subsamples)
    if out.pop("rv", False):
        out["pos"] = out["vel"] = True
    if not (out.get("A") or out.get("B")):
        out |= {k: True for k in "AB" if k not in out}
    if not any(out.get(k) for k in ("pos", "vel", "pid", "rvint", "packedpid")):
        out |= {"pos": True, "vel": True, "pid": True}
    return out


@dataclass
class Catalog:
    """Lazy tables of one scan."""

    halos: DataFrame
    header: dict
    particles: DataFrame | None = None

    @classmethod
    def scan(
        cls,
        spark: SparkSession,
        path: str | list[str] | Layout,
        header: dict,
        fields: list[str] | str = "DEFAULT",
        cleaned: str | list[str] | None = None,
        subsamples: bool | dict = False,
        particle_path: str | None = None,
        filter_func: Callable[[DataFrame], Column] | None = None,
        convert_units: bool = True,
        unpack_bits: bool | str | list[str] = False,
        passthrough: bool = False,
        light_cone: bool = False,
        merged_path: str | None = None,
    ) -> Catalog:
        """Halos of Parquet files or of a resolved layout; `cleaned` names the row-aligned cleaning tables (slab, row).

        Duplicate paths are an error.  Cleaned halos have their total mass as N and are 0 when merged away.  filter_func
        sees decoded columns; particles of dropped halos are not joined.  A halo's particles are its own and then, with
        merged_path, those that cleaning merged in; npstart and npout are those of the joined particles.  Fields:
        DEFAULT is every field but those of progenitors, all has them too.  A light cone is clean already, has subsample
        A alone, and its particles are decoded already; fields that it does not have are left out.
        """
        if isinstance(path, Layout):
            cleaned, light_cone = cleaned or path.cleaned or None, light_cone or path.light_cone
            path = path.halos
        paths = [path] if isinstance(path, str) else list(path)
        if len(set(paths)) != len(paths):
            raise ValueError("duplicate paths")
        if light_cone:
            if len(paths) > 1:
                raise ValueError("a light cone is one file")
            cleaned, unpack_bits = None, False
        raw = spark.read.parquet(*paths)
        if cleaned:
            clean = spark.read.parquet(*([cleaned] if isinstance(cleaned, str) else cleaned))
            raw = raw.drop("N").join(clean, ["slab", "row"])
        keys = [c for c in ("slab", "row") if c in raw.columns]
        if passthrough:
            df = raw
        else:
            box, velz = (header["BoxSize"], header["VelZSpace_to_kms"]) if convert_units else (1.0, 1.0)
            known = derived_fields(box, velz)
            names = [fields] if isinstance(fields, str) else list(fields)
            if fields in ("DEFAULT", "all"):
                extra = dict.fromkeys([f"{q}{a}_{c}" for q in ("sigmar_eigenvecs", "sigmav_eigenvecs", "sigman_eigenvecs") for a in ("Min", "Mid", "Maj") for c in ("com", "L2com")])
                extra |= dict.fromkeys(CLEAN_FIELDS + (PROGENITOR_FIELDS if fields == "all" else ()) if cleaned else ())
                names = available(raw, known | extra)
                names = [f for f in names if f not in CLEAN_FIELDS + PROGENITOR_FIELDS or f in extra]
            if light_cone:
                names = [f for f in names if f in CONE_FIELDS or "L2" in f]
            raw = eigenvectors(raw, names)
            if cleaned:
                names = list(dict.fromkeys("N_total" if f == "N" else f for f in names))
            if not light_cone and (bad := [f for f in names if f not in known and f not in raw.columns]):
                raise KeyError(f"unknown fields: {bad}")
            names = [f for f in names if f in known or f in raw.columns]
            if subsamples:
                if "id" not in raw.columns and "index_halo" in raw.columns:
                    raw = raw.withColumn("id", F.col("index_halo"))
                names += [] if "id" in names else ["id"]
                names += [f"{f}{k}{m}" for m in ("", "_merge") for k in "AB" for f in ("npstart", "npout") if f"{f}{k}{m}" in raw.columns and f"{f}{k}{m}" not in names]
            df = raw.select(*keys, *[known.get(f, F.col(f)).alias(f) for f in names if f not in keys])
        if cleaned and "N_total" in df.columns:
            df = df.withColumnRenamed("N_total", "N")
        if filter_func is not None:
            df = df.where(filter_func(df))
        particles = None
        if subsamples and particle_path:
            o = subsample_options(subsamples)
            kinds = ["A"] if light_cone else [k for k in "AB" if o.get(k)]
            merged = spark.read.parquet(merged_path) if merged_path else None
            stored = halo_particles(df, spark.read.parquet(particle_path), kinds, merged)
            ready = [c for c in ("pos", "vel", "pid") if c in stored.columns]
            particles = stored if light_cone and ready else decode_particles(stored, header, o, check_unpack_bits(unpack_bits))
            if merged is not None:
                df = joined_ranges(df, kinds)
        return cls(df, dict(header), particles)

    @property
    def nbytes(self) -> int:
        """Estimated size of the halo table, from its plan."""
        return int(str(self.halos._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    def __repr__(self) -> str:
        parts = "without particles" if self.particles is None else f"with particles ({', '.join(self.particles.columns)})"
        return f"Catalog of {self.header.get('SimName', 'a simulation')}: {len(self.halos.columns)} fields, some {self.nbytes} bytes, {parts}"

    def with_fraction(self, both_in: tuple[str, ...]) -> Catalog:
        return Catalog(self.halos, subsample_fraction(self.header, both_in), self.particles)

    def rows_per_slab(self) -> DataFrame:
        return self.halos.groupBy("slab").agg(F.count("*").alias("n_halos"))

    def header_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(str(k), str(v)) for k, v in self.header.items()], "key string, value string")


def raw_columns(name: str) -> set[str]:
    """The stored columns that a field is made of."""
    if m := _EIGEN.match(name):
        return {f"{m[1]}_{m[3]}_u16"}
    if m := re.match(r"(r10|r25|r33|r50|r67|r75|r90|r95|r98|rvcirc_max|sigmar)_(com|L2com)$", name):
        return {f"{name}_i16", f"r100_{m[2]}"}
    if m := re.match(r"sigmav(Min|Maj|rad|tan)_(com|L2com)$", name):
        return {f"sigmav{'Max' if m[1] == 'Maj' else m[1]}_to_sigmav3d_{m[2]}_i16", f"sigmav3d_{m[2]}"}
    if m := re.match(r"sigmavMid_(com|L2com)$", name):
        return raw_columns(f"sigmavMin_{m[1]}") | raw_columns(f"sigmavMaj_{m[1]}")
    if re.match(r"sigman_(com|L2com)$", name):
        return {f"{name}_i16"}
    return {"pos_avg", name} if name == "pos_interp" else {"pos_avg", "vel_avg", name} if name == "vel_interp" else {name}


def available(raw: DataFrame, known: dict[str, Column]) -> list[str]:
    """The known fields whose stored columns are all there."""
    have = set(raw.columns)
    return [name for name in known if raw_columns(name) <= have]


def eigenvectors(df: DataFrame, fields: list[str]) -> DataFrame:
    """df with the wanted principal axes (arrays of three) of its code columns, by joins with the table of all 65,340 codes."""
    wanted: dict[str, list[re.Match]] = {}
    for m in filter(None, map(_EIGEN.match, fields)):
        wanted.setdefault(f"{m[1]}_{m[3]}_u16", []).append(m)
    for code, some in wanted.items():
        axes = {"Min": "min", "Mid": "mid", "Maj": "maj"}
        t = euler16_table(df.sparkSession).select(F.col("code").alias(code), *[F.array(*[F.col(f"{axes[m[2]]}_{a}") for a in "xyz"]).alias(m[0]) for m in some])
        df = df.join(F.broadcast(t), code, "left")
    return df


def _ranges(halos: DataFrame, kinds: list[str], suffix: str) -> DataFrame:
    """slab, halo_id, ab, row, place: one row for each entry of the halos' ranges [npstart, npstart + npout)."""
    out = None
    for k in kinds:
        n, first = F.col(f"npout{k}{suffix}"), F.col(f"npstart{k}{suffix}")
        if "N" in halos.columns:
            n = F.when(F.col("N") == 0, 0).otherwise(n)  # cleaned away
        r = halos.withColumn("_n", n).where("_n > 0").select("slab", F.col("id").alias("halo_id"), F.lit(k).alias("ab"), first.alias("_first"), F.explode(F.sequence(first, first + F.col("_n") - 1)).alias("row"))
        r = r.withColumn("place", F.col("row") - F.col("_first")).drop("_first")
        out = r if out is None else out.unionByName(r)
    return out


def halo_particles(halos: DataFrame, particles: DataFrame, kinds: list[str], merged: DataFrame | None = None) -> DataFrame:
    """Particles (slab, ab, row) of the halos' ranges: ranges become row keys, joined by equality.

    With merged particles (slab, ab, row), a halo's own come first and those that cleaning gave it after them; `place` is a
    particle's place among its halo's of one kind, `merged_in` says where it is from.
    """
    own = _ranges(halos, kinds, "").join(particles, ["slab", "ab", "row"])
    if merged is None:
        return own.drop("place")
    count = F.create_map(*[x for k in kinds for x in (F.lit(k), F.col(f"npout{k}"))])
    before = halos.select("slab", F.col("id").alias("halo_id"), F.explode(count).alias("ab", "_own"))
    more = _ranges(halos, kinds, "_merge").join(merged, ["slab", "ab", "row"]).join(before, ["slab", "halo_id", "ab"])
    more = more.withColumn("place", F.col("place") + F.col("_own")).drop("_own")
    return own.withColumn("merged_in", F.lit(False)).unionByName(more.withColumn("merged_in", F.lit(True)), allowMissingColumns=True)


def joined_ranges(halos: DataFrame, kinds: list[str]) -> DataFrame:
    """npstart and npout of each halo among all joined particles: own and merged ones, all of A before those of B; the _merge columns go."""
    total, out = None, halos
    for k in kinds:
        n = F.col(f"npout{k}") + F.coalesce(F.col(f"npout{k}_merge"), F.lit(0))
        if "N" in halos.columns:
            n = F.when(F.col("N") == 0, 0).otherwise(n)
        out = particle_ranges(out.withColumn("_n", n.cast("long")), "_n")
        size = F.lit(0).cast("long") if total is None else F.lit(total)
        out = out.withColumn(f"npstart{k}", F.col("npstart") + size).withColumn(f"npout{k}", F.col("_n"))
        if k != kinds[-1]:
            total = (total or 0) + (out.agg(F.sum("_n")).first()[0] or 0)
        out = out.drop("_n", "npstart", f"npstart{k}_merge", f"npout{k}_merge")
    return out


def decode_particles(df: DataFrame, header: dict, options: dict[str, bool], bits: tuple[str, ...]) -> DataFrame:
    """Positions, velocities and id fields of rvint (array of three words) and packedpid columns."""
    box = header["BoxSize"]
    out = [c for c in ("slab", "ab", "row", "halo_id", "place", "merged_in") if c in df.columns]
    cols: list[Column] = []
    if "rvint" in df.columns:
        if options.get("pos"):
            cols += [rvint_position(F.col("rvint")[i], box).alias(a) for i, a in enumerate(_AXES)]
        if options.get("vel"):
            cols += [rvint_velocity(F.col("rvint")[i]).alias(f"v{a}") for i, a in enumerate(_AXES)]
        if options.get("rvint"):
            cols.append(F.col("rvint"))
    if "packedpid" in df.columns and (options.get("pid") or bits):
        f = pid_fields(F.col("packedpid"), box, int(header["ppd"]))
        want = {"pid", *bits} if options.get("pid") else set(bits)
        cols += [c.alias(n) for n, c in f.items() if any(n == w or n.startswith(f"{w}_") for w in want)]
        if options.get("packedpid"):
            cols.append(F.col("packedpid"))
    return df.select(*out, *cols)


def read_particles(spark: SparkSession, path: str, header: dict, load: tuple[str, ...] | None = None, colname: str | None = None) -> DataFrame:
    """Particle files: the encoding is the one column of rvint, packedpid, pid that is there; none or two are an error."""
    df = spark.read.parquet(path)
    kinds = [colname] if colname else [c for c in ("rvint", "pack9", "packedpid", "pid") if c in df.columns]
    if len(kinds) != 1:
        raise ValueError(f"one particle column expected, found {kinds}")
    load = load or (("pos", "vel") if kinds[0] in ("rvint", "pack9") else ("pid",))
    if kinds[0] == "pack9":
        keep = [c for on, cs in (("pos", "xyz"), ("vel", ("vx", "vy", "vz"))) if on in load for c in cs]
        return decode_pack9(df.select("file", "pos", F.col("pack9").alias("raw")), header["BoxSize"], header["VelZSpace_to_kms"]).select("file", "pos", *keep)
    if kinds[0] == "pid":
        return df.select("pid")
    options = {k: k in load for k in ("pos", "vel", "pid")}
    return decode_particles(df, header, options, tuple(x for x in load if x in PID_FIELDS and x != "pid"))


def particle_ranges(halos: DataFrame, n: str = "npout", order: tuple[str, ...] = ("slab", "id")) -> DataFrame:
    """New start of each halo's particles: exclusive prefix sum of n inside each slab, slabs shifted by the totals before them."""
    w = W.partitionBy("slab").orderBy(*[o for o in order if o != "slab"]).rowsBetween(W.unboundedPreceding, -1)
    local = halos.withColumn("_local", F.coalesce(F.sum(n).over(w), F.lit(0).cast("long")))
    totals = halos.groupBy("slab").agg(F.sum(n).alias("_t"))
    before = W.orderBy("slab").rowsBetween(W.unboundedPreceding, -1)  # as many rows as slabs
    totals = totals.withColumn("_before", F.coalesce(F.sum("_t").over(before), F.lit(0).cast("long"))).drop("_t")
    return local.join(F.broadcast(totals), "slab").withColumn("npstart", F.col("_local") + F.col("_before")).drop("_local", "_before")


def clean(halos: DataFrame, merges: DataFrame) -> DataFrame:
    """halos (id, n) with merges (id, merged_to): merged halos get n_total 0, their hosts the sum."""
    gained = merges.join(halos.select("id", "n"), "id").groupBy(F.col("merged_to").alias("id")).agg(F.sum("n").alias("n_merge"))
    gone = merges.select("id", F.lit(True).alias("gone"))
    h = halos.join(gained, "id", "left").join(gone, "id", "left")
    return h.withColumn("n_total", F.when(F.col("gone"), F.lit(0).cast("long")).otherwise(F.col("n") + F.coalesce("n_merge", F.lit(0)))).drop("n_merge", "gone")


def get_meta(meta: DataFrame, sim: str, redshift: float | str) -> dict:
    """Parameters and state of a simulation at a redshift, state over parameters; meta has sim, redshift (z%.3f), param and state maps."""
    z = redshift if isinstance(redshift, str) else f"z{redshift:.3f}"
    z = z if z.startswith("z") else f"z{z}"
    rows = meta.where((F.col("sim") == sim) & (F.col("redshift") == z)).select("param", "state").take(1)
    if not rows:
        raise ValueError(f"no metadata for {sim} at {z}")
    return {**(rows[0].param or {}), **(rows[0].state or {})}
