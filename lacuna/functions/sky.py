"""Sky and Cartesian coordinates, in degrees and Mpc/h."""

from __future__ import annotations

import functools
import math
import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def to_xyz(ra: Column, dec: Column, r: Column) -> tuple[Column, Column, Column]:
    a, d = F.radians(ra), F.radians(dec)
    return r * F.cos(a) * F.cos(d), r * F.sin(a) * F.cos(d), r * F.sin(d)


def _each(f: Callable[[float], float], values: pa.Array) -> np.ndarray:
    return np.fromiter((f(v) if math.isfinite(v) else math.nan for v in values.to_numpy(zero_copy_only=False).tolist()), float, len(values))


def _places(ra: pa.Array, dec: pa.Array, r: pa.Array) -> pa.Array:
    a, d = ([_each(f, angle) for f in (math.cos, math.sin)] for angle in (ra, dec))
    r = r.to_numpy(zero_copy_only=False)
    none = np.isnan(r) | np.isnan(a[0]) | np.isnan(d[0])
    return pa.StructArray.from_arrays([pa.array(c, pa.float64(), mask=none) for c in (r * a[0] * d[0], r * a[1] * d[0], r * d[1])], ["x", "y", "z"])


def place(ra: Column, dec: Column, r: Column) -> Column:
    """A struct of x, y, z to the last bit as the C library's functions give it (Java's may differ there): on a border that bit decides. Null without a finite value."""
    made = F.arrow_udf(_places, StructType([StructField(c, DoubleType()) for c in "xyz"]))
    return made(F.radians(ra), F.radians(dec), r.cast("double"))


def to_radec(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """r, ra, dec with the arc tangent's branch: 180 is added where x < 0, so ra may be negative; all 0 at the origin."""
    r = F.sqrt(x * x + y * y + z * z)
    ra = F.when(x == 0, F.when(y > 0, 90.0).when(y < 0, -90.0).otherwise(0.0)).otherwise(F.degrees(F.atan(F.try_divide(y, x))) + F.when(x < 0, 180.0).otherwise(0.0))
    dec = F.when(r == 0, 0.0).otherwise(F.degrees(F.asin(F.try_divide(z, r))))
    return r, ra, dec


def to_radec_unsigned(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """r, ra in [0, 360), dec; on the negative x axis ra is 0, as its sign is that of y."""
    rho = F.sqrt(x * x + y * y)
    r = F.sqrt(x * x + y * y + z * z)
    angle = F.when(rho == 0, 0.0).otherwise(F.degrees(F.acos(F.try_divide(x, rho))) * F.signum(y))
    return r, F.pmod(angle + 360.0, F.lit(360.0)), F.when(r == 0, 0.0).otherwise(F.degrees(F.asin(F.try_divide(z, r))))


def mask_angles(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """ra in [0, 360) and dec by which sky masks are indexed: arc tangent, plus 180 where x < 0 and y is not 0, plus 360 where negative."""
    r = F.sqrt(x * x + y * y + z * z)
    ra = F.when(x == 0, F.when(y > 0, 90.0).when(y < 0, -90.0).otherwise(0.0)).otherwise(F.degrees(F.atan(F.try_divide(y, x))) + F.when((x < 0) & (y != 0), 180.0).otherwise(0.0))
    return F.when(ra < 0, ra + 360.0).otherwise(ra), F.when(r == 0, 0.0).otherwise(F.degrees(F.asin(F.try_divide(z, r))))


def _least(holds: Callable[[float], bool], low: float, high: float) -> float:
    """The least double from ``low`` to ``high`` at which a condition that never turns false again holds; ``high`` if none before."""

    def rank(v: float) -> int:
        n = struct.unpack("<q", struct.pack("<d", v))[0]
        return n if n >= 0 else -(n & 0x7FFFFFFFFFFFFFFF)

    def double(n: int) -> float:
        return math.copysign(struct.unpack("<d", struct.pack("<q", abs(n)))[0], n)

    a, b = rank(low), rank(high)
    while a < b:
        middle = (a + b) // 2
        a, b = (a, middle) if holds(double(middle)) else (middle + 1, b)
    return double(a)


@functools.lru_cache
def cell_limits(resolution: int) -> tuple[str, str]:
    """Where cells of a degree over ``resolution`` begin, by the C library's arc functions, comma-joined.

    First y / x: the least that reaches border k, for x > 0, y >= 0 at k, x < 0 at k + 1, and x > 0, y < 0 at k + 2.
    Then |z| / r at the borders from 0.
    """
    n, top = resolution, 1.7976931348623157e308
    turns = ((0, 90, 0.0), (90, 270, 180.0), (270, 360, 360.0))
    around = [_least(lambda t: (math.degrees(math.atan(t)) + turn) * n >= k, -top, top) for first, last, turn in turns for k in range(first * n, last * n + 1)]
    up = [_least(lambda s: math.degrees(math.asin(s)) * n >= k, 0.0, 1.0) for k in range(90 * n + 1)]
    return ",".join(map(repr, around)), ",".join(map(repr, up))
