"""Survey footprints: sky masks by cells of right ascension and declination, boxes, and edges.

A sky mask is a table of cells (ra_idx, dec_idx) at ``resolution`` cells a degree; it has at most
360 n by 180 n rows, whatever the survey, which bounds what a join may broadcast.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions import healpix, sky
from lacuna.operators.grid import XYZ

BROADCAST_CELLS = 4_000_000
CLOSE = 1e-6  # of a cell, to its border


@dataclass
class InsidePixels:
    """HEALPix pixels between two distances, both excluded."""

    pixels: frozenset
    nside: int
    rmin: float
    rmax: float

    def __call__(self, p: np.ndarray) -> bool:
        x, y, z = map(float, p)
        r = math.sqrt(x * x + y * y + z * z)
        if not self.rmin < r < self.rmax:
            return False
        return healpix.pixel_of(math.degrees(math.atan2(y, x)) % 360.0, math.degrees(math.asin(z / r)), self.nside) in self.pixels


@dataclass
class Inside:
    """A footprint as arrays."""

    mode: str
    bitmap: np.ndarray | None
    resolution: int
    rmin: float
    rmax: float
    low: tuple
    high: tuple

    def __call__(self, p: np.ndarray) -> bool:
        if self.mode == "periodic":
            return True
        x, y, z = map(float, p)
        if self.mode == "box":
            return all(a <= c <= b for c, a, b in zip((x, y, z), self.low, self.high, strict=True))
        r = math.sqrt(x * x + y * y + z * z)
        if r == 0 or not self.rmin <= r <= self.rmax:
            return False
        ra = math.degrees(math.atan(y / x)) if x else 90.0 * (y > 0) - 90.0 * (y < 0)
        ra += 180.0 * (x < 0 and y != 0)
        ra += 360.0 * (ra < 0)
        i, j = int(ra % 360.0 * self.resolution), int(math.degrees(math.asin(z / r)) * self.resolution) + 90 * self.resolution
        return 0 <= i < self.bitmap.shape[0] and 0 <= j < self.bitmap.shape[1] and bool(self.bitmap[i, j])


@dataclass
class Footprint:
    """``mode``: sky (cells within distances), box (inclusive), or periodic (everywhere)."""

    mode: str = "sky"
    cells: DataFrame | None = None
    resolution: int = 1
    rmin: float = -math.inf
    rmax: float = math.inf
    low: tuple[float, float, float] = (0.0, 0.0, 0.0)
    high: tuple[float, float, float] = (0.0, 0.0, 0.0)
    strict: bool = False  # exclude points at the distance limits

    def flag(self, points: DataFrame, name: str = "inside", coords: tuple[str, str, str] = XYZ) -> DataFrame:
        """``points`` with a boolean column."""
        x, y, z = (F.col(c) for c in coords)
        if self.mode == "periodic":
            return points.withColumn(name, F.lit(True))
        if self.mode == "box":
            test = F.lit(True)
            for c, a, b in zip((x, y, z), self.low, self.high, strict=True):
                test = test & (c >= float(a)) & (c <= float(b))
            return points.withColumn(name, test)
        r2 = x * x + y * y + z * z
        near = (r2 > self.rmin * abs(self.rmin)) & (r2 < self.rmax * abs(self.rmax)) if self.strict else (r2 >= self.rmin * abs(self.rmin)) & (r2 <= self.rmax * abs(self.rmax))
        angled = points.withColumns(dict(zip(("__a", "__d"), sky.mask_angles(x, y, z), strict=True)))
        keyed = angled.withColumns(dict(zip(("__ra", "__dec"), place_cell(x, y, z, F.col("__a"), F.col("__d"), self.resolution), strict=True)))
        cells = self.cells.select(F.col("ra_idx").alias("__ra"), F.col("dec_idx").alias("__dec"), F.lit(True).alias("__in"))
        if 360 * 180 * self.resolution**2 <= BROADCAST_CELLS:
            cells = F.broadcast(cells)
        out = keyed.join(cells, ["__ra", "__dec"], "left")
        return out.withColumn(name, F.coalesce("__in", F.lit(False)) & near & (r2 > 0)).select(*points.columns, name)

    def inside(self, points: DataFrame, coords: tuple[str, str, str] = XYZ) -> DataFrame:
        return self.flag(points, "__inside", coords).filter("__inside").drop("__inside")

    def near_edge(self, points: DataFrame, distance: float, name: str = "near_edge", id_col: str = "gal") -> DataFrame:
        """``points`` with whether one of the six points at ``distance`` along the axes is outside."""
        steps = F.array(*(F.struct(*(F.lit(float(v)).alias(f"__d{c}") for v, c in zip(step, XYZ, strict=True))) for step in _axes(distance)))
        around = points.select(id_col, *XYZ).withColumn("__s", F.explode(steps))
        moved = around.select(id_col, *((F.col(c) + F.col(f"__s.__d{c}")).alias(c) for c in XYZ))
        outside = self.flag(moved, "__inside").filter("not __inside").select(F.col(id_col).alias("__out")).distinct()
        return points.join(outside.hint("merge"), points[id_col] == F.col("__out"), "left").withColumn(name, F.col("__out").isNotNull()).select(*points.columns, name)

    def kernel(self) -> Inside:
        """The footprint for kernels; at most 360 n by 180 n bytes."""
        return Inside(self.mode, self.bitmap() if self.mode == "sky" else None, self.resolution, self.rmin, self.rmax, self.low, self.high)

    def bitmap(self) -> np.ndarray:
        """The cells as an array, for kernels."""
        n = self.resolution
        out = np.zeros((360 * n, 180 * n), bool)
        for r in self.cells.select("ra_idx", "dec_idx").toLocalIterator():
            out[r["ra_idx"], r["dec_idx"]] = True
        return out


def _axes(distance: float) -> list[tuple[float, float, float]]:
    return [(distance, 0, 0), (-distance, 0, 0), (0, distance, 0), (0, -distance, 0), (0, 0, distance), (0, 0, -distance)]


def mask_cell(ra: Column, dec: Column, resolution: int) -> tuple[Column, Column]:
    """Cell indices, truncated toward zero before the shift of declinations."""
    return (F.pmod(ra, F.lit(360.0)) * resolution).cast("int"), (dec * resolution).cast("int") + 90 * resolution


def place_cell(x: Column, y: Column, z: Column, ra: Column, dec: Column, resolution: int) -> tuple[Column, Column]:
    """:func:`mask_cell` of a place with these angles; next to a border the side is taken from y / x and z / r, as the angles' last bits differ by library."""
    n = resolution
    around, up = (F.split(F.lit(limits), ",").cast("array<double>") for limits in sky.cell_limits(n))
    plain_a, plain_d = mask_cell(ra, dec, n)
    turned, raised = F.round(ra * n).cast("int"), F.round(F.abs(dec) * n).cast("int")
    half = F.when(x < 0, 1).when(y < 0, 2).otherwise(0)
    border = F.when((half == 2) & (turned == 0), 360 * n).otherwise(turned)
    a = F.pmod(F.when(F.try_divide(y, x) >= F.get(around, border + half), border).otherwise(border - 1), F.lit(360 * n))
    height = F.abs(F.try_divide(z, F.sqrt(x * x + y * y + z * z)))
    d = F.when(height >= F.get(up, raised), raised).otherwise(raised - 1)
    by_a = (x != 0) & (y != 0) & (F.abs(ra * n - turned) < CLOSE)
    by_d = (raised > 0) & (F.abs(F.abs(dec) * n - raised) < CLOSE)
    return F.when(by_a, a).otherwise(plain_a), F.when(by_d, F.when(dec < 0, -d).otherwise(d) + 90 * n).otherwise(plain_d)


def mask_resolution(r_max: float, min_maximal_radius: float = 10.0) -> int:
    return 1 + int(math.pi / 180.0 * r_max / min_maximal_radius)


def sky_mask(galaxies: DataFrame, resolution: int = 1, smooth: bool = True, ra: str = "ra", dec: str = "dec") -> DataFrame:
    """Cells that hold a galaxy; smoothing adds inner cells of which at least three of four neighbours do."""
    a, d = mask_cell(F.col(ra), F.col(dec), resolution)
    cells = galaxies.select(a.alias("ra_idx"), d.alias("dec_idx")).distinct()
    if not smooth:
        return cells
    around = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))))
    shifted = cells.withColumn("s", F.explode(around)).select((F.col("ra_idx") + F.col("s.i")).alias("ra_idx"), (F.col("dec_idx") + F.col("s.j")).alias("dec_idx"))
    inner = (F.col("ra_idx") > 0) & (F.col("ra_idx") < 360 * resolution - 1) & (F.col("dec_idx") > 0) & (F.col("dec_idx") < 180 * resolution - 1)
    added = shifted.filter(inner).groupBy("ra_idx", "dec_idx").agg(F.count("*").alias("n")).filter("n >= 3").select("ra_idx", "dec_idx")
    return cells.unionByName(added).distinct()


def generate_mask(galaxies: DataFrame, r_max: float, smooth: bool = True, min_maximal_radius: float = 10.0) -> tuple[DataFrame, int]:
    """The mask, and its resolution."""
    n = mask_resolution(r_max, min_maximal_radius)
    return sky_mask(galaxies, n, smooth), n


def sky_coverage(spark: SparkSession, cells: DataFrame, resolution: int) -> tuple[float, float]:
    """Steradians and square degrees that the mask covers, by HEALPix centres in it, at about as many pixels as cells."""
    nside = max(1, round(math.sqrt(360 * resolution * 180 * resolution / 12)))
    ra, dec = healpix.pix2ang(F.col("id"), nside)
    a, d = mask_cell(ra, dec, resolution)
    pixels = spark.range(healpix.pixel_count(nside)).select(a.alias("ra_idx"), d.alias("dec_idx"))
    n = pixels.join(F.broadcast(cells) if 360 * 180 * resolution**2 <= BROADCAST_CELLS else cells, ["ra_idx", "dec_idx"], "left_semi").count()
    degrees = n * healpix.pixel_area_degrees(nside)
    return degrees * (math.pi / 180.0) ** 2, degrees


def select_mask(table: DataFrame, footprint: Footprint, distance: str = "Rgal") -> DataFrame:
    """Rows at positive distance inside the footprint."""
    return footprint.inside(table.filter(F.col(distance) > 0))
