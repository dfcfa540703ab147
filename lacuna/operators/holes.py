"""Holes into voids: the survey-boundary cut, duplicate removal, maximal spheres, joining, edge flags."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.geometry import ball_mesh, cap_volume, lens_volume, sphere_volume, spiral_sphere
from lacuna.operators.grid import CELL_KEY, XYZ, with_cell, with_neighbours
from lacuna.operators.mask import Footprint
from lacuna.operators.neighbors import overlapping_spheres
from lacuna.sources.tables import with_row_numbers

SURFACE_POINTS = 20
RUN_BLOCK = 100_000


def _literal_points(points: np.ndarray, radius: np.ndarray | None = None):
    names = (*XYZ, "r")
    rows = np.column_stack((points, radius if radius is not None else np.ones(len(points))))
    return F.array(*(F.struct(*(F.lit(float(v)).alias(n) for v, n in zip(row, names, strict=True))) for row in rows))


def check_bounds(holes: DataFrame, footprint: Footprint, max_overlap: float = 0.1, points_per_volume: float = 0.01) -> DataFrame:
    """Holes with ``boundary``, without those of which too much lies outside.

    A hole is a boundary hole if one of SURFACE_POINTS points of its surface is outside; it
    goes if ceil(max_overlap * N) of the N mesh points within its radius are. A hole too small to hold a mesh point stays.
    """
    if footprint.mode == "periodic":
        return holes.withColumn("boundary", F.lit(False))
    keyed = holes.select("hole", *XYZ, "radius")
    surface = keyed.withColumn("p", F.explode(_literal_points(spiral_sphere(SURFACE_POINTS))))
    surface = surface.select("hole", *((F.col(c) + F.col("radius") * F.col(f"p.{c}")).alias(c) for c in XYZ))
    out = footprint.flag(surface, "inside").filter("not inside").select("hole").distinct()
    boundary = keyed.join(out, "hole", "left_semi")
    largest = boundary.agg(F.max("radius")).first()[0]
    flagged = holes.join(out.withColumn("boundary", F.lit(True)), "hole", "left").withColumn("boundary", F.coalesce("boundary", F.lit(False)))
    if largest is None:
        return flagged
    points, radius = ball_mesh(largest, points_per_volume)
    spark = holes.sparkSession
    mesh = spark.createDataFrame([(*map(float, p), float(r)) for p, r in zip(points, radius, strict=True)], "px double, py double, pz double, pr double")
    inner = boundary.join(F.broadcast(mesh), F.col("pr") <= F.col("radius"))  # the mesh is that of one ball
    inner = inner.select("hole", *((F.col(c) + F.col(f"p{c}")).alias(c) for c in XYZ))
    counts = footprint.flag(inner, "inside").groupBy("hole").agg(F.count("*").alias("n"), F.count_if(~F.col("inside")).alias("outside"))
    gone = counts.filter(F.col("outside") >= F.ceil(F.col("n") * max_overlap)).select("hole")
    return flagged.join(gone, "hole", "left_anti")


def cut_by_axis_caps(holes: DataFrame, footprint: Footprint, max_overlap: float = 0.1) -> DataFrame:
    """The plainer cut: along each axis, either way, the first whole step from the centre that is outside bounds a cap; holes with a cap of more than ``max_overlap`` of their volume go."""
    ways = F.array(*(F.struct(*(F.lit(float(v)).alias(c) for v, c in zip(way, XYZ, strict=True))) for way in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))))
    steps = holes.select("hole", *XYZ, "radius").withColumn("way", F.explode(ways)).withColumn("step", F.explode(F.sequence(F.lit(1), F.ceil("radius").cast("int"))))
    reached = steps.filter(F.col("step") <= F.col("radius")).select("hole", "radius", "way", "step", *((F.col(c) + F.col("step") * F.col(f"way.{c}")).alias(c) for c in XYZ))
    first = footprint.flag(reached, "inside").filter("not inside").groupBy("hole", "radius", "way").agg(F.min("step").alias("step"))
    cap = cap_volume(F.col("radius"), F.col("radius") - F.col("step"))
    gone = first.filter(cap > max_overlap * sphere_volume(F.col("radius"))).select("hole").distinct()
    return holes.join(gone, "hole", "left_anti")


def _fold(table: pa.Table, tolerance: float) -> pa.Table:
    """A run of holes in order: those that are kept."""
    table = table.sort_by("nth")
    keep, last = [], None
    for row in zip(*(table.column(c).to_pylist() for c in (*XYZ, "radius")), strict=True):
        ok = last is None or math.dist(row[:3], last[:3]) > tolerance or last[3] - row[3] > tolerance
        last = row if ok else last
        keep.append(ok)
    return table.filter(pa.array(keep, pa.bool_())).select(["nth"])


def remove_duplicates(holes: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """By falling radius, holes that are farther than the tolerance from the last kept one, or smaller than it by more.

    A hole that no hole before it is near, in place and radius, is kept whatever was before: it starts a run. Near ones are looked
    for in cells of place and radius, of which only the first hole counts. Each run is then gone through by itself.
    """
    ordered = with_row_numbers(holes.withColumn("fall", -F.col("radius")), "nth", ["fall", *XYZ]).drop("fall")
    numbered = _checkpointed(ordered)
    places = numbered.select("nth", *XYZ, F.floor(F.col("radius") / tolerance).alias("size"))
    firsts = with_cell(places, tolerance).groupBy(*CELL_KEY, "size").agg(F.min("nth").alias("first"))
    around = with_neighbours(places, tolerance).withColumn("size", F.explode(F.array("size", F.col("size") + 1)))
    near = around.join(firsts, [*CELL_KEY, "size"]).filter("first < nth").select("nth").distinct()
    flagged = numbered.select("nth").join(near.withColumn("near", F.lit(True)), "nth", "left").withColumn("own", F.when(F.col("near").isNull(), F.col("nth")))
    flagged = flagged.withColumn("block", F.expr(f"nth div {RUN_BLOCK}"))
    within = F.max("own").over(Window.partitionBy("block").orderBy("nth"))
    lasts = flagged.groupBy("block").agg(F.max("own").alias("last"))  # a row for RUN_BLOCK holes
    before = lasts.select("block", F.max("last").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    runs = flagged.withColumn("within", within).join(before, "block").select("nth", F.coalesce("within", "before").alias("run"))
    kept = numbered.select("nth", *XYZ, "radius").join(runs, "nth").groupBy("run").applyInArrow(lambda table: _fold(table, tolerance), "nth long")
    return numbered.join(kept, "nth", "left_semi").select(*holes.columns)


def _checkpointed(df: DataFrame) -> DataFrame:
    return df.checkpoint()


def find_maximals(holes: DataFrame, min_radius: float = 10.0, overlap: float = 0.1) -> DataFrame:
    """hole, void: the maximal spheres, numbered from 0 by falling radius.

    Of spheres larger than ``min_radius`` the largest is accepted first; one that lies in an accepted
    sphere, or shares more than ``overlap`` of its volume with one, is rejected. Decided in
    rounds: a sphere without undecided larger rivals is settled by the accepted ones among them, which
    gives what the sequential pass gives.
    """
    candidates = holes.filter(F.col("radius") > min_radius).select("hole", *XYZ, "radius")
    largest = candidates.agg(F.max("radius")).first()[0]
    if largest is None:
        return candidates.select("hole").withColumn("void", F.lit(0).cast("long")).limit(0)
    pairs = overlapping_spheres(candidates, candidates, largest)
    before = F.struct(-F.col("radius_b"), "x_b", "y_b", "z_b", "hole_b") < F.struct(-F.col("radius"), "x", "y", "z", "hole")
    rival = lens_volume(F.col("radius"), F.col("radius_b"), F.col("d")) > overlap * sphere_volume(F.col("radius"))
    rivals = _checkpointed(pairs.filter(before & ((F.col("radius_b") - F.col("radius") >= F.col("d")) | rival)).select("hole", F.col("hole_b").alias("rival")))
    undecided = _checkpointed(candidates.select("hole"))
    accepted = None
    while not undecided.isEmpty():
        blocked = rivals.join(undecided.withColumnRenamed("hole", "rival"), "rival", "left_semi").select("hole").distinct()
        new = _checkpointed(undecided.join(blocked, "hole", "left_anti"))
        accepted = new if accepted is None else accepted.unionByName(new)
        beaten = rivals.join(new.withColumnRenamed("hole", "rival"), "rival", "left_semi").select("hole").distinct()
        undecided = _checkpointed(undecided.join(new, "hole", "left_anti").join(beaten, "hole", "left_anti"))
    chosen = candidates.join(accepted, "hole", "left_semi").withColumn("fall", -F.col("radius"))
    return with_row_numbers(chosen, "void", ["fall", *XYZ, "hole"]).select("hole", "void")


def join_holes(holes: DataFrame, maximals: DataFrame, fraction: float = 0.5) -> DataFrame:
    """hole, void: the maximals, and the holes that share more than ``fraction`` of their volume with exactly one of them, in the order of the voids before the first that contains the hole."""
    spheres = holes.join(maximals, "hole").select("void", *XYZ, "radius")
    largest = holes.agg(F.max("radius")).first()[0] or 1.0
    others = holes.join(maximals, "hole", "left_anti").select("hole", *XYZ, "radius")
    pairs = overlapping_spheres(others, spheres, largest)
    contained = F.col("radius_b") - F.col("radius") >= F.col("d")
    shared = lens_volume(F.col("radius"), F.col("radius_b"), F.col("d")) > fraction * sphere_volume(F.col("radius"))
    marked = pairs.select("hole", F.col("void_b").alias("void"), contained.alias("contained"), shared.alias("shared"))
    stop = F.min(F.when(F.col("contained"), F.col("void"))).over(Window.partitionBy("hole"))
    matches = marked.withColumn("stop", stop).filter("shared and not contained and (stop is null or void < stop)")
    single = matches.groupBy("hole").agg(F.count("*").alias("n"), F.min("void").alias("void")).filter("n = 1").select("hole", "void")
    return maximals.select("hole", "void").unionByName(single)


def edge_flags(holes: DataFrame, footprint: Footprint, distance: float) -> DataFrame:
    """void, edge: 1 if a hole of the void is a boundary hole, else 2 if a point at ``distance`` along an axis from a hole's centre is outside, else 0."""
    near = footprint.near_edge(holes.select("hole", "void", *XYZ, "boundary"), distance, id_col="hole")
    return near.groupBy("void").agg(F.when(F.bool_or("boundary"), 1).when(F.bool_or("near_edge"), 2).otherwise(0).alias("edge"))


def combine_holes(holes: DataFrame, footprint: Footprint, min_maximal_radius: float = 10.0, dup_tol: float = 0.1, maximal_overlap_frac: float = 0.1, hole_join_frac: float = 0.5, maximal_spheres_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Maximals (x, y, z, radius, void, edge) and holes (x, y, z, radius, void) from holes with ``boundary``."""
    unique = _checkpointed(remove_duplicates(holes, dup_tol))
    maximals = _checkpointed(find_maximals(unique, min_maximal_radius, maximal_overlap_frac))
    joined = maximals if maximal_spheres_only else join_holes(unique, maximals, hole_join_frac)
    members = _checkpointed(unique.join(joined, "hole"))
    edges = edge_flags(members, footprint, min_maximal_radius)
    top = unique.join(maximals, "hole").join(edges, "void").select(*XYZ, "radius", "void", "edge")
    own = members.select(*XYZ, "radius", "void")
    return top, own.limit(0) if maximal_spheres_only else own
