"""HEALPix pixels in the RING scheme (Gorski et al. 2005), as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def pixel_count(nside: int) -> int:
    return 12 * nside * nside


def pixel_area_degrees(nside: int) -> float:
    return 4.0 * math.pi / pixel_count(nside) * (180.0 / math.pi) ** 2


def ang2pix(ra: Column, dec: Column, nside: int) -> Column:
    """RING pixel of a direction in degrees."""
    z = F.sin(F.radians(dec))
    za = F.abs(z)
    tt = F.pmod(ra / 90.0, F.lit(4.0))
    npix = pixel_count(nside)
    # between the polar caps
    up = F.floor(nside * (0.5 + tt - z * 0.75))
    down = F.floor(nside * (0.5 + tt + z * 0.75))
    ring = nside + 1 + up - down
    shift = 1 - F.pmod(ring, F.lit(2))
    place = F.pmod(F.floor((up + down - nside + shift + 1) / 2), F.lit(4 * nside))
    belt = 2 * nside * (nside - 1) + (ring - 1) * 4 * nside + place
    # in the caps
    tp = tt - F.floor(tt)
    tmp = nside * F.sqrt(3.0 * (1.0 - za))
    jp, jm = F.floor(tp * tmp), F.floor((1.0 - tp) * tmp)
    k = jp + jm + 1
    ip = F.pmod(F.floor(tt * k), 4 * k)
    cap = F.when(z > 0, 2 * k * (k - 1) + ip).otherwise(npix - 2 * k * (k + 1) + ip)
    return F.when(za <= 2.0 / 3.0, belt).otherwise(cap).cast("long")


def pix2ang(pixel: Column, nside: int) -> tuple[Column, Column]:
    """ra and dec in degrees of the centres of RING pixels."""
    npix = pixel_count(nside)
    ncap = 2 * nside * (nside - 1)
    p = pixel.cast("long")
    k = F.floor((1 + F.sqrt(1 + 2 * p.cast("double"))) / 2)
    j = p - 2 * k * (k - 1)
    north_z, north_ra = 1 - k * k / F.lit(3.0 * nside * nside), (j + 0.5) * 90.0 / k
    q = npix - 1 - p
    ks = F.floor((1 + F.sqrt(1 + 2 * q.cast("double"))) / 2)
    js = 4 * ks - 1 - (q - 2 * ks * (ks - 1))
    south_z, south_ra = -(1 - ks * ks / F.lit(3.0 * nside * nside)), (js + 0.5) * 90.0 / ks
    e = p - ncap
    ring = F.floor(e / F.lit(4 * nside)) + nside
    je = F.pmod(e, F.lit(4 * nside))
    odd = F.pmod(ring - nside, F.lit(2))
    belt_z = (2 * nside - ring) * F.lit(2.0 / (3.0 * nside))
    belt_ra = (je + F.when(odd == 0, 0.5).otherwise(0.0)) * 90.0 / nside
    north, south = p < ncap, p >= npix - ncap
    z = F.when(north, north_z).when(south, south_z).otherwise(belt_z)
    ra = F.when(north, north_ra).when(south, south_ra).otherwise(belt_ra)
    return ra, F.degrees(F.asin(z))


def pixel_of(ra: float, dec: float, nside: int) -> int:
    """:func:`ang2pix` of one direction, for kernels."""
    z, tt = math.sin(math.radians(dec)), (ra / 90.0) % 4.0
    if abs(z) <= 2.0 / 3.0:
        up, down = math.floor(nside * (0.5 + tt - z * 0.75)), math.floor(nside * (0.5 + tt + z * 0.75))
        ring = nside + 1 + up - down
        shift = 1 - ring % 2
        return 2 * nside * (nside - 1) + (ring - 1) * 4 * nside + ((up + down - nside + shift + 1) // 2) % (4 * nside)
    tp, tmp = tt % 1.0, nside * math.sqrt(3.0 * (1.0 - abs(z)))
    k = math.floor(tp * tmp) + math.floor((1.0 - tp) * tmp) + 1
    ip = math.floor(tt * k) % (4 * k)
    return 2 * k * (k - 1) + ip if z > 0 else pixel_count(nside) - 2 * k * (k + 1) + ip
