"""Decoders of packed words and ratio columns: plain expressions that stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values of the file format.
POS_SCALE, VEL_SCALE, VEL_ZERO = 1_000_000, 6000.0 / 2048, 2048
PID_MASK, AXIS_MASK, DENSITY_MASK = 0x7FFF7FFF7FFF, 0x7FFF, 0x3FF
TAG_BIT, DENSITY_SHIFT = 48, 49
RATIO_SCALE = 32000
EULER_CAPS, EULER_T, EULER_AZ, EULER_NORM = 12, 11, 45, 1.8477590650225735122
PACK_ZERO, PACK_STEP, PACK_CELL = 2048, 0.0005, 2000


def rvint_position(word: Column, box: float) -> Column:
    """Upper 20 bits, signed, in units of box / 10**6."""
    return F.shiftright(word, 12) * F.lit(box / POS_SCALE)


def rvint_velocity(word: Column) -> Column:
    """Lower 12 bits around 2048, scaled to km/s."""
    return (word.bitwiseAND(0xFFF) - VEL_ZERO) * F.lit(VEL_SCALE)


def pid_fields(word: Column, box: float, ppd: int) -> dict[str, Column]:
    """Particle id, lagrangian index and position, tag and density of a packed id."""
    axes = [F.shiftrightunsigned(word, 16 * i).bitwiseAND(AXIS_MASK).cast("int") for i in range(3)]
    root = F.shiftrightunsigned(word, DENSITY_SHIFT).bitwiseAND(DENSITY_MASK)
    out = {"pid": word.bitwiseAND(PID_MASK), "tagged": F.shiftrightunsigned(word, TAG_BIT).bitwiseAND(1).cast("int"), "density": (root * root).cast("float")}
    for name, a in zip("xyz", axes, strict=True):
        out[f"lagr_idx_{name}"] = a
        out[f"lagr_pos_{name}"] = a * F.lit(box / ppd) - F.lit(box / 2)
    return out


def ratio(raw: Column, base: Column, scale: float = 1.0) -> Column:
    """A 16-bit ratio of another column."""
    return raw * base / F.lit(float(RATIO_SCALE)) * F.lit(scale)


def sigma_mid(total: Column, major: Column, minor: Column) -> Column:
    return F.sqrt(total * total - major * major - minor * minor)


def euler16_table(spark: SparkSession) -> DataFrame:
    """Every code of the 16-bit orientation with its three orthonormal axes: a lookup table of 12 * 121 * 45 rows to join.

    A code is (cap * 121 + bin) * 45 + azimuth.  The bin gives the major axis inside its cap by triangle root and rest,
    the azimuth turns the minor axis around it.
    """
    b = spark.range(EULER_CAPS * EULER_T * EULER_T * EULER_AZ).withColumnRenamed("id", "code")
    az = F.col("code") % EULER_AZ
    cell = F.floor(F.col("code") / EULER_AZ)
    cap = F.floor(cell / (EULER_T * EULER_T)).cast("int")
    inner = cell % (EULER_T * EULER_T)
    it = F.floor(F.sqrt(inner.cast("double"))).cast("int")
    b = b.select("code", cap.alias("cap"), it.alias("it"), (inner - it * it).cast("int").alias("ir"), az.cast("int").alias("az"))
    t = (F.col("it") + 0.5) / F.lit(EULER_T * EULER_NORM)
    b = b.withColumn("t", t * F.sqrt(2.0 - t * t) / (1.0 - t * t)).withColumn("r", ((F.col("ir") + 0.5) / (F.col("it") + 0.5) - 1.0) * F.col("t"))
    norm = F.sqrt(1.0 + F.col("r") * F.col("r") + F.col("t") * F.col("t"))
    # The cap says which axis is the longest and where, with which sign, the second component goes.
    g = F.floor(F.col("cap") / 4)
    second = (g + F.when(F.col("cap") % 4 < 2, 1).otherwise(2)) % 3
    sign = F.when(F.col("cap") % 2 == 0, 1.0).otherwise(-1.0)
    major = [F.when(g == i, 1.0).when(second == i, sign * F.col("t")).otherwise(F.col("r")) / norm for i in range(3)]
    b = b.select("code", g.alias("g"), ((F.col("az") + 0.5) * F.lit(math.pi / EULER_AZ)).alias("angle"), *[m.alias(f"maj_{a}") for a, m in zip("xyz", major, strict=True)])
    # The minor axis turns in the plane of the other two coordinates; its last component makes it perpendicular.
    maj = [F.col(f"maj_{a}") for a in "xyz"]
    minor = []
    c, d = F.cos("angle"), F.sin("angle")
    rest = F.when(F.col("g") == 0, -(c * maj[1] + d * maj[2]) / maj[0]).when(F.col("g") == 1, -(c * maj[2] + d * maj[0]) / maj[1]).otherwise(-(c * maj[0] + d * maj[1]) / maj[2])
    for i in range(3):
        minor.append(F.when(F.col("g") == i, rest).when((F.col("g") + 1) % 3 == i, c).otherwise(d))
    b = b.select("code", *[f"maj_{a}" for a in "xyz"], *[m.alias(f"n_{a}") for a, m in zip("xyz", minor, strict=True)])
    n = [F.col(f"n_{a}") for a in "xyz"]
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    b = b.select("code", *[f"maj_{a}" for a in "xyz"], *[(x / size).alias(f"min_{a}") for a, x in zip("xyz", n, strict=True)])
    n = [F.col(f"min_{a}") for a in "xyz"]
    mid = [n[1] * maj[2] - n[2] * maj[1], n[2] * maj[0] - n[0] * maj[2], n[0] * maj[1] - n[1] * maj[0]]
    return b.select("code", *[f"maj_{a}" for a in "xyz"], *[x.alias(f"mid_{a}") for a, x in zip("xyz", mid, strict=True)], *[f"min_{a}" for a in "xyz"])


def pack9_bytes(raw: Column) -> list[Column]:
    """Nine bytes of a binary record as integers."""
    return [F.conv(F.hex(F.substring(raw, i + 1, 1)), 16, 10).cast("int") for i in range(9)]


def pack9_fields(b: list[Column]) -> list[Column]:
    """Six signed 12-bit fields: of each three bytes, the middle one's low half belongs to the first field, its high half to the second."""
    out = []
    for i in (0, 3, 6):
        out.append(b[i] * 16 + b[i + 1].bitwiseAND(15) - PACK_ZERO)
        out.append(F.shiftright(b[i + 1], 4) * 256 + b[i + 2] - PACK_ZERO)
    return out


def decode_pack9(records: DataFrame, box: float, velz_to_kms: float = 1.0) -> DataFrame:
    """Positions and velocities of a record stream (file, pos, raw): a record with first byte 255 is a cell header.

    The header sets the cells per side, the velocity scale and the cell of the particles that follow it in its file.
    Headers are carried forward by a window inside each file, the unit that a stream is ordered in.
    """
    raw = pack9_bytes(F.col("raw"))
    names = [f"f{i}" for i in range(6)]
    r = records.select("file", "pos", (raw[0] == 255).alias("head"), *[x.alias(n) for x, n in zip(pack9_fields(raw), names, strict=True)])
    w = W.partitionBy("file").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    header = F.when(F.col("head"), F.struct(*[(F.col(n) + PACK_CELL).alias(n) for n in names[1:]]))
    r = r.withColumn("cell", F.last(header, ignorenulls=True).over(w)).where("not head and cell is not null")
    return r.select("file", "pos", *_pack9_particle(names, box, velz_to_kms))


def _pack9_particle(names: list[str], box: float, velz_to_kms: float) -> list[Column]:
    """x, y, z, vx, vy, vz from a record's fields and its header's (column cell)."""
    size = F.lit(float(box)) / F.col("cell.f1")
    pos = [F.col(n) * PACK_STEP * size + (F.col(f"cell.{c}") + 0.5) * size - box / 2 for n, c in zip(names[:3], names[3:], strict=True)]
    vel = [F.col(n) * (F.col("cell.f2") * PACK_STEP / F.col("cell.f1") * velz_to_kms) for n in names[3:]]
    return [c.alias(n) for n, c in zip(("x", "y", "z", "vx", "vy", "vz"), pos + vel, strict=True)]


def decode_pack9_records(records: DataFrame, box: float, velz_to_kms: float = 1.0) -> DataFrame:
    """row, x, y, z, vx, vy, vz of records that carry their header (columns row, record, header), as the binary source reads them.

    Nothing is carried from row to row, so ranges of a file decode apart; records before any header are left out.
    """
    names = [f"f{i}" for i in range(6)]
    fields = pack9_fields(pack9_bytes(F.col("record")))
    head = F.struct(*[(x + PACK_CELL).alias(n) for n, x in zip(names[1:], pack9_fields(pack9_bytes(F.col("header")))[1:], strict=True)])
    r = records.where("length(header) = 9").select("row", *[x.alias(n) for n, x in zip(names, fields, strict=True)], head.alias("cell"))
    return r.select("row", *_pack9_particle(names, box, velz_to_kms))
