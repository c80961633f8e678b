"""Where a catalog's files are: redshift folders, lists of files, and the layouts of cleaning tables.

Paths are looked up through the file system that Spark uses for them, so they can be in any store.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass
class Layout:
    """Files of one catalog, in the order of their slabs."""

    group: str
    halos: list[str]
    slabs: list[int]
    cleaned: list[str]
    merged_particles: str | None
    light_cone: bool = False


class Files:
    """The few questions that are asked of a store."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def glob(self, pattern: str) -> list[str]:
        fs, p = self._at(pattern)
        return sorted(s.getPath().toString() for s in fs.globStatus(p) or [])


def parent(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[0]


def name(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[-1]


def is_light_cone(spark: SparkSession, path: str) -> bool:
    return "halo_light_cones" in path or bool(Files(spark).glob(f"{path.rstrip('/')}/lc_*.parquet"))


def resolve(spark: SparkSession, path: str | list[str], cleaned: bool = True, cleaning: str | None = None, light_cone: bool | None = None) -> Layout:
    """Files of a redshift folder, its halo_info folder, one halo_info file or several of one catalog.

    The cleaning folder is the nearest one called `cleaning` above the catalog, unless it is given; below it the tables are at
    the catalog's own place without the `halos` level, in cleaned_halo_info or directly.
    """
    files = Files(spark)
    paths = [p.rstrip("/") for p in ([path] if isinstance(path, str) else path)]
    for p in paths:
        if not files.exists(p):
            raise FileNotFoundError(p)
    if light_cone is None:
        light_cone = is_light_cone(spark, paths[0])
    single = re.search(r"halo_info(_\d+)?\.parquet$", paths[0]) is not None
    if len(paths) > 1 and not all(re.search(r"halo_info(_\d+)?\.parquet$", p) for p in paths):
        raise ValueError("a list must be of halo_info files")
    if single:
        if len(set(paths)) < len(paths):
            raise ValueError("duplicate halo_info files")
        group = parent(paths[0]) if light_cone else parent(parent(paths[0]))
        if any((parent(p) if light_cone else parent(parent(p))) != group for p in paths):
            raise ValueError("files of different catalogs")
        halos = paths
    else:
        group = parent(paths[0]) if name(paths[0]) == "halo_info" else paths[0]
        pattern = f"{group}/lc_halo_info*.parquet" if light_cone else f"{group}/halo_info/halo_info_*.parquet"
        halos = files.glob(pattern)
        if not halos:
            raise FileNotFoundError(pattern)
    slabs = [0] if light_cone else [int(re.search(r"(\d+)\.parquet$", h)[1]) for h in halos]
    clean, merged = [], None
    if cleaned and not light_cone:
        at = group
        while cleaning is None and at != parent(at) and "/" in at:
            at = parent(at)
            cleaning = f"{at}/cleaning" if files.exists(f"{at}/cleaning") else None
        if cleaning is None:
            raise FileNotFoundError(f"no cleaning folder above {group}")
        # The catalog's place below the cleaning folder's parent, without the folder that holds its redshifts.
        own = f"{parent(parent(group))}/{name(group)}"
        base = parent(cleaning)
        place = own[len(base) :].strip("/") if own.startswith(base) else f"{name(parent(parent(group)))}/{name(group)}"
        top = f"{cleaning}/{place}"
        inside = files.exists(f"{top}/cleaned_halo_info")
        clean = [f"{top}/cleaned_halo_info/cleaned_halo_info_{i:03d}.parquet" if inside else f"{top}/cleaned_halo_info_{i:03d}.parquet" for i in slabs]
        merged = f"{top}/cleaned_rvpid" if inside else top
        if missing := [c for c in clean if not files.exists(c)]:
            raise FileNotFoundError(missing[0])
    return Layout(group, halos, slabs, clean, merged, light_cone)


def subsample_fraction(header: dict, both_in: tuple[str, ...]) -> dict:
    """The header of a light cone's particles with the fraction of both subsamples together, for the simulation sets that write both to one file."""
    if header.get("OutputType") == "LightCone" and header.get("SimSet") in both_in:
        return header | {"SubsampleFraction": header["ParticleSubsampleA"] + header["ParticleSubsampleB"]}
    return dict(header)
