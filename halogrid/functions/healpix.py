"""HEALPix pixel numbers of directions as expressions, ring and nested order (Gorski et al. 2005)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _check(nside: int, nested: bool) -> None:
    if nside < 1 or nested and nside & (nside - 1):
        raise ValueError("nside must be positive, and a power of two in nested order")


def _long(x: Column) -> Column:
    return F.floor(x).cast("long")


def _direction(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """z of the unit vector, its size, and the longitude in quarter turns, 0 <= t < 4.  The null vector points to the north pole."""
    r = F.sqrt(x * x + y * y + z * z)
    unit = F.when(r > 0, z / r).otherwise(F.lit(1.0))
    t = F.atan2(y, x) / F.lit(math.pi / 2)
    t = F.when(t < 0, t + 4).otherwise(t)
    return unit, F.abs(unit), F.when(t >= 4, F.lit(0.0)).otherwise(t)


def _polar(size: Column, t: Column, nside: int) -> tuple[Column, Column]:
    """Numbers of the two pixel edges that bound a direction near a pole."""
    part = t - F.floor(t)
    reach = F.sqrt(3 * (1 - size)) * nside
    return _long(part * reach), _long((1 - part) * reach)


def _belt(unit: Column, t: Column, nside: int) -> tuple[Column, Column]:
    """Numbers of the rising and the falling pixel edge below a direction near the equator."""
    return _long(nside * (t + 0.5) - nside * 0.75 * unit), _long(nside * (t + 0.5) + nside * 0.75 * unit)


def ring_pixel(x: Column, y: Column, z: Column, nside: int) -> Column:
    """Pixel, counted along rings from the north pole, of the direction (x, y, z), which need not be of unit length."""
    _check(nside, False)
    unit, size, t = _direction(x, y, z)
    up, down = _belt(unit, t, nside)
    ring = up - down + nside  # 0 for the first ring of the belt; every second one starts half a pixel later
    at = F.pmod(F.shiftright(up + down - nside + ring.bitwiseAND(1) + 1 + 8 * nside, 1), F.lit(4 * nside))
    belt = 2 * nside * (nside - 1) + ring * 4 * nside + at
    a, b = _polar(size, t, nside)
    n = a + b + 1
    along = F.pmod(_long(t * n), 4 * n)
    cap = F.when(unit > 0, 2 * n * (n - 1) + along).otherwise(12 * nside * nside - 2 * n * (n + 1) + along)
    return F.when(size <= 2 / 3, belt).otherwise(cap).cast("long")


def _spread(v: Column) -> Column:
    """The bits of a number on the even bits of another: its binary digits read in base four."""
    return F.conv(F.bin(v), 4, 10).cast("long")


def nested_pixel(x: Column, y: Column, z: Column, nside: int) -> Column:
    """Pixel in nested order: face * nside**2 and the interleaved bits of the place in the face; p >> 2 is the pixel at nside / 2."""
    _check(nside, True)
    unit, size, t = _direction(x, y, z)
    up, down = _belt(unit, t, nside)
    to, fro = F.floor(up / nside), F.floor(down / nside)
    face = F.when(to == fro, F.pmod(to, F.lit(4)) + 4).when(to < fro, to).otherwise(fro + 8)
    a, b = (F.least(v, F.lit(nside - 1)) for v in _polar(size, t, nside))
    quarter = F.least(_long(t), F.lit(3))
    near, north = size <= 2 / 3, unit > 0
    face = F.when(near, face).when(north, quarter).otherwise(quarter + 8).cast("long")
    u = F.when(near, F.pmod(down, F.lit(nside))).when(north, nside - 1 - b).otherwise(a).cast("long")
    v = F.when(near, nside - 1 - F.pmod(up, F.lit(nside))).when(north, nside - 1 - a).otherwise(b).cast("long")
    return face * (nside * nside) + _spread(u) + 2 * _spread(v)
