"""Which points lie in voids, catalogue statistics, and the overlap of catalogues."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.operators.grid import XYZ
from lacuna.operators.mask import Footprint, select_mask
from lacuna.operators.neighbors import in_any_sphere, k_nearest, nearest_sphere
from lacuna.operators.volume import lattice

EDGE_DISTANCE = 10.0
EDGE_BUFFER = 30.0


def void_flags(points: DataFrame, holes: DataFrame, footprint: Footprint, edge_distance: float = EDGE_DISTANCE, id_col: str = "gal") -> DataFrame:
    """id, vflag: 1 in a hole (even outside the footprint), else 9 outside it, else 2 within ``edge_distance`` of its edge, else 0."""
    points = points.select(id_col, *XYZ)
    flagged = footprint.near_edge(footprint.flag(points, "inside"), edge_distance, "near", id_col)
    inner = in_any_sphere(points, holes, id_col).withColumn("__v", F.lit(True))
    joined = flagged.join(inner.hint("merge"), id_col, "left")
    return joined.select(id_col, F.when(F.col("__v"), 1).when(~F.col("inside"), 9).when(F.col("near"), 2).otherwise(0).alias("vflag"))


def with_void(galzone: DataFrame, zonevoid: DataFrame) -> DataFrame:
    """galzone with void0, void1 of its zone (-1 if none) and in_void."""
    joined = galzone.join(zonevoid, "zone", "left")
    none = F.lit(-1).cast("long")
    out = joined.withColumns({"void0": F.coalesce("void0", none), "void1": F.coalesce("void1", none)})
    return out.withColumn("in_void", F.col("void0") != -1)


def watershed_flags(points: DataFrame, galzone: DataFrame, zonevoid: DataFrame, footprint: Footprint, edge_distance: float = EDGE_DISTANCE, flag_void_near_edge: bool = False, id_col: str = "gal") -> DataFrame:
    """id, vflag: 9 outside, 2 near the edge, 0 elsewhere; 1 wherever the nearest galaxy is in a void (-1 near the edge or outside, if asked for)."""
    points = points.select(id_col, *XYZ)
    flagged = footprint.near_edge(footprint.flag(points, "inside"), edge_distance, "near", id_col)
    near = k_nearest(points, galzone, 1, id_col, "gal").select(id_col, F.col("neighbour").alias("__g"))
    own = with_void(galzone, zonevoid).select(F.col("gal").alias("__g"), "in_void")
    joined = flagged.join(near.join(own.hint("merge"), "__g").hint("merge"), id_col)
    clear = F.col("inside") & ~F.col("near")
    in_void = F.when(~clear, -1).otherwise(1) if flag_void_near_edge else F.lit(1)
    return joined.select(id_col, F.when(F.col("in_void"), in_void).when(~F.col("inside"), 9).when(F.col("near"), 2).otherwise(0).alias("vflag"))


def galaxy_membership(galaxies: DataFrame, footprint: Footprint, magnitude_limit: float, edge_buffer: float = EDGE_BUFFER) -> DataFrame:
    """n_void, n_wall of bright galaxies inside the footprint and not near its edge (galaxies: gal, x, y, z, Rgal, rabsmag, vflag)."""
    bright = select_mask(galaxies, footprint).filter(F.col("rabsmag") < magnitude_limit)
    clear = footprint.near_edge(bright, edge_buffer, "near").filter("not near")
    return clear.agg(F.count_if(F.col("vflag") == 1).alias("n_void"), F.count_if(F.col("vflag") == 0).alias("n_wall"))


def void_stats(voids: DataFrame, radius: str = "radius", edge: Column | None = None, fiducial: Column | None = None) -> DataFrame:
    """One row: counts by edge flag, and mean, median and largest radius of the fiducial voids. The errors divide by the number of all voids."""
    flag = edge if edge is not None else F.col("edge")
    chosen = F.when(fiducial if fiducial is not None else F.lit(True), F.col(radius))
    error = F.stddev_pop(chosen) / F.sqrt(F.count("*"))
    return voids.agg(
        F.count("*").alias("voids"),
        F.count_if(flag == 1).alias("edge"),
        F.count_if(flag == 2).alias("near_edge"),
        F.count_if(flag == 0).alias("interior"),
        F.avg(chosen).alias("mean"),
        error.alias("mean_error"),
        F.median(chosen).alias("median"),
        (error * math.sqrt(math.pi / 2.0)).alias("median_error"),
        F.max(chosen).alias("largest"),
    )


def area_edge() -> Column:
    """Edge flag of a watershed void: more than a tenth of its surface is at the survey's edge."""
    return F.when(F.try_divide(F.col("edge_area"), F.col("tot_area")) > 0.1, 1).otherwise(0)


def in_sphere_voids(points: DataFrame, holes: DataFrame, mode: str = "any", id_col: str = "id") -> DataFrame:
    """id, in_void; ``mode`` any asks all holes, nearest only the one with the nearest centre."""
    points = points.select(id_col, *XYZ)
    if mode == "nearest":
        return nearest_sphere(points, holes, id_col, "hole").select(id_col, F.col("inside").alias("in_void"))
    inner = in_any_sphere(points, holes, id_col).withColumn("__v", F.lit(True))
    return points.select(id_col).join(inner.hint("merge"), id_col, "left").select(id_col, F.coalesce("__v", F.lit(False)).alias("in_void"))


def in_watershed_voids(points: DataFrame, galzone: DataFrame, zonevoid: DataFrame, id_col: str = "id") -> DataFrame:
    """id, in_void of the nearest galaxy."""
    near = k_nearest(points.select(id_col, *XYZ), galzone, 1, id_col, "gal").select(id_col, F.col("neighbour").alias("__g"))
    return near.join(with_void(galzone, zonevoid).select(F.col("gal").alias("__g"), "in_void").hint("merge"), "__g").select(id_col, "in_void")


def overlap_points(spark, footprint: Footprint, low, high, step: float = 1.0, offset: float = 0.5, edge_buffer: float = EDGE_BUFFER) -> DataFrame:
    """Lattice points inside the footprint and away from its edge."""


    inner = footprint.inside(lattice(spark, low, high, step, offset))
    return footprint.near_edge(inner, edge_buffer, "near", "id").filter("not near").drop("near")


def overlap(a: DataFrame, b: DataFrame, id_col: str = "id") -> DataFrame:
    """One row of counts and fractions of points in both catalogues' voids, in one's only, in neither's (a, b: id, in_void)."""
    both = a.select(id_col, F.col("in_void").alias("a")).join(b.select(id_col, F.col("in_void").alias("b")).hint("merge"), id_col)
    counts = both.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("a") & F.col("b")).alias("both"),
        F.count_if(~F.col("a") & ~F.col("b")).alias("neither"),
        F.count_if(F.col("a") & ~F.col("b")).alias("only_a"),
        F.count_if(~F.col("a") & F.col("b")).alias("only_b"),
    )
    return counts.select("*", *(F.try_divide(F.col(c), F.col("n")).alias(f"{c}_share") for c in ("both", "neither", "only_a", "only_b")))


def combine_overlaps(*counts: DataFrame) -> DataFrame:
    """Overlap counts of several surveys, added up."""
    names = ("n", "both", "neither", "only_a", "only_b")
    out = counts[0].select(*names)
    for c in counts[1:]:
        out = out.unionByName(c.select(*names))
    summed = out.agg(*(F.sum(c).alias(c) for c in names))
    return summed.select("*", *(F.try_divide(F.col(c), F.col("n")).alias(f"{c}_share") for c in names[1:]))


def common_void_galaxies(a: DataFrame, b: DataFrame, id_col: str = "gal") -> DataFrame:
    """Ids that both catalogues flag 1."""
    return a.filter("vflag = 1").select(id_col).join(b.filter("vflag = 1").select(id_col).hint("merge"), id_col, "left_semi")
