"""Void catalogues with their surveys: flags, membership and overlaps as calls, for one catalogue, two, or several stacked."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions import cosmology, sky
from lacuna.operators import membership
from lacuna.operators.grid import XYZ
from lacuna.operators.mask import Footprint, select_mask
from lacuna.operators.volume import lattice
from lacuna.sources.tables import stack


def whole_sky(spark: SparkSession) -> Footprint:
    """Every direction, at any distance."""
    cells = spark.range(360 * 181).select(F.expr("cast(id div 181 as int)").alias("ra_idx"), F.expr("cast(id % 181 as int)").alias("dec_idx"))
    return Footprint("sky", cells, 1)


def sky_points(points: DataFrame, omega_m: float = 0.3, h: float = 1.0) -> DataFrame:
    """``points`` with x, y, z: their own, or from ra, dec and Rgal, or from ra, dec and redshift."""
    columns = set(points.columns)
    if set(XYZ) <= columns:
        if {"ra", "dec"} <= columns:
            raise ValueError("give sky or Cartesian coordinates, not both")
        return points
    if not {"ra", "dec"} <= columns or not {"Rgal", "redshift"} & columns:
        raise ValueError("give x, y, z, or ra, dec and Rgal or redshift")
    r = F.col("Rgal") if "Rgal" in columns else cosmology.comoving_distance(F.col("redshift"), omega_m, h)
    return points.withColumn("__p", sky.place(F.col("ra"), F.col("dec"), r)).withColumns({c: F.col(f"__p.{c}") for c in XYZ}).drop("__p")


@dataclass
class VoidCatalog:
    """``footprint``: the survey; ``galaxies``: gal, x, y, z, Rgal, rabsmag; ``info``: header values."""

    footprint: Footprint
    galaxies: DataFrame | None = None
    info: dict = field(default_factory=dict)

    def flags(self, points: DataFrame, edge_distance: float = membership.EDGE_DISTANCE, id_col: str = "gal") -> DataFrame:
        raise NotImplementedError

    def in_void(self, points: DataFrame, id_col: str = "id") -> DataFrame:
        raise NotImplementedError

    def galaxy_membership(self, magnitude_limit: float, edge_buffer: float = membership.EDGE_BUFFER) -> DataFrame:
        """n_void, n_wall of the survey's bright galaxies away from its edge."""
        bright = select_mask(self.galaxies, self.footprint).filter(F.col("rabsmag") < magnitude_limit)
        clear = self.footprint.near_edge(bright, edge_buffer, "near").filter("not near")
        return self.flags(clear).agg(F.count_if(F.col("vflag") == 1).alias("n_void"), F.count_if(F.col("vflag") == 0).alias("n_wall"))

    def void_galaxies(self) -> DataFrame:
        """Ids of the survey's galaxies in voids."""
        return self.flags(self.galaxies).filter("vflag = 1").select("gal")

    def coords_in_void(self, points: DataFrame, id_col: str = "id", **cosmology_of) -> DataFrame:
        """id, vflag of places that need not be galaxies, in sky or Cartesian coordinates (see :func:`sky_points`)."""
        return self.flags(sky_points(points, **cosmology_of).select(id_col, *XYZ), id_col=id_col)


@dataclass
class SphereCatalog(VoidCatalog):
    """Voids of spheres. ``holes``: x, y, z, radius, void; ``maximals``: the same with edge."""

    holes: DataFrame | None = None
    maximals: DataFrame | None = None

    def flags(self, points: DataFrame, edge_distance: float = membership.EDGE_DISTANCE, id_col: str = "gal", full_sky: bool = False) -> DataFrame:
        """id, vflag; ``full_sky``: nothing is outside or near an edge."""
        survey = whole_sky(points.sparkSession) if full_sky else self.footprint
        return membership.void_flags(points, self.holes, survey, edge_distance, id_col)

    def in_void(self, points: DataFrame, id_col: str = "id") -> DataFrame:
        return membership.in_sphere_voids(points, self.holes, id_col=id_col)

    def void_stats(self) -> DataFrame:
        return membership.void_stats(self.maximals)


@dataclass
class WatershedCatalog(VoidCatalog):
    """Voids of zones. ``galzone``: gal, x, y, z, zone; ``zonevoid``: zone, void0, void1; ``voids``: radius, tot_area, edge_area."""

    galzone: DataFrame | None = None
    zonevoid: DataFrame | None = None
    voids: DataFrame | None = None

    def flags(self, points: DataFrame, edge_distance: float = membership.EDGE_DISTANCE, id_col: str = "gal", flag_void_near_edge: bool = False) -> DataFrame:
        return membership.watershed_flags(points, self.galzone, self.zonevoid, self.footprint, edge_distance, flag_void_near_edge, id_col)

    def in_void(self, points: DataFrame, id_col: str = "id") -> DataFrame:
        return membership.in_watershed_voids(points, self.galzone, self.zonevoid, id_col)

    def void_stats(self) -> DataFrame:
        """An edge void has more than a tenth of its surface at the survey's edge."""
        return membership.void_stats(self.voids, edge=membership.area_edge())


def _places(spark: SparkSession, footprint: Footprint, low, high, step: float, offset: tuple[float, float, float] | float, edge_buffer: float) -> DataFrame:
    """Lattice points inside the footprint away from its edge, then moved by one offset for all, as a part of the step."""
    inner = footprint.inside(lattice(spark, low, high, step, 0.0))
    clear = footprint.near_edge(inner, edge_buffer, "near", "id").filter("not near").select("id", *XYZ)
    moves = offset if isinstance(offset, tuple) else (offset,) * 3
    return clear.withColumns({c: F.col(c) + float(m) * step for c, m in zip(XYZ, moves, strict=True)})


def _box(footprint: Footprint, rmax: float) -> tuple[tuple[float, ...], tuple[float, ...]]:
    if footprint.mode == "box":
        return tuple(footprint.low), tuple(footprint.high)
    return (-rmax,) * 3, (rmax,) * 3


def single_overlap(catalog: VoidCatalog, low=None, high=None, step: float = 1.0, offset: tuple[float, float, float] | float = 0.5, edge_buffer: float = membership.EDGE_BUFFER, spark: SparkSession | None = None) -> DataFrame:
    """n, inside, inside_share of lattice points of a catalogue's survey that lie in its voids."""
    spark = spark or SparkSession.getActiveSession()
    box = _box(catalog.footprint, catalog.footprint.rmax) if low is None else (low, high)
    points = _places(spark, catalog.footprint, *box, step, offset, edge_buffer)
    found = catalog.in_void(points).agg(F.count("*").alias("n"), F.count_if("in_void").alias("inside"))
    return found.withColumn("inside_share", F.try_divide("inside", "n"))


def overlap(a: VoidCatalog, b: VoidCatalog, low=None, high=None, step: float = 1.0, offset: tuple[float, float, float] | float = 0.5, edge_buffer: float = membership.EDGE_BUFFER, spark: SparkSession | None = None) -> DataFrame:
    """Counts and shares of lattice points in both catalogues' voids, in one's, in neither's, over the first's mask between the greater of the near limits and the lesser of the far ones."""
    spark = spark or SparkSession.getActiveSession()
    x, y = a.footprint, b.footprint
    common = Footprint(x.mode, x.cells, x.resolution, max(x.rmin, y.rmin), min(x.rmax, y.rmax), x.low, x.high, x.strict)
    box = _box(common, common.rmax) if low is None else (low, high)
    if any(not math.isfinite(v) for side in box for v in side):
        raise ValueError("a survey without a far limit needs a box")
    points = _places(spark, common, *box, step, offset, edge_buffer)
    return membership.overlap(a.in_void(points), b.in_void(points))


class Stacked:
    """Catalogues of several surveys under their names; a method is called on each, and the answers stand under each other with the name in ``catalog``."""

    def __init__(self, catalogs: dict[str, VoidCatalog]):
        self.catalogs = catalogs

    def map(self, call: Callable[[VoidCatalog], DataFrame]) -> DataFrame:
        return stack({name: call(c) for name, c in self.catalogs.items()})

    def galaxy_membership(self, magnitude_limit: float, edge_buffer: float = membership.EDGE_BUFFER) -> DataFrame:
        return self.map(lambda c: c.galaxy_membership(magnitude_limit, edge_buffer))

    def void_stats(self) -> DataFrame:
        return self.map(lambda c: c.void_stats())

    def combined_stats(self, edge: Column | None = None) -> DataFrame:
        """Statistics of all surveys' voids as one catalogue."""
        tables = {n: c.maximals if isinstance(c, SphereCatalog) else c.voids for n, c in self.catalogs.items()}
        area = all(isinstance(c, WatershedCatalog) for c in self.catalogs.values())
        return membership.void_stats(stack(tables), edge=edge if edge is not None else membership.area_edge() if area else None)

    def overlap(self, other: Stacked, **options) -> DataFrame:
        """Overlaps of catalogues of the same name, added up."""
        return membership.combine_overlaps(*(overlap(c, other.catalogs[n], **options) for n, c in self.catalogs.items()))


def common_galaxies(a: VoidCatalog, b: VoidCatalog) -> DataFrame:
    """Ids of galaxies that both catalogues have in voids."""
    return a.void_galaxies().join(b.void_galaxies().hint("merge"), "gal", "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that ``b`` doesn't have."""
    return a.distinct().exceptAll(b.select(*a.columns).distinct())
