"""Neighbour queries as equi-joins on grid cells: k nearest, radius, containment and overlap.

Both sides of such joins may be large, and Spark takes exploded or well compressed ones for small: they are marked to be
merged, so none is collected on the driver for a broadcast.

A join on cells finds every pair closer than one cell edge. The k nearest are exact once the k-th
is no farther than the edge; rows for which it isn't are searched again with doubled edges, so
each pass keeps only the rows that still need it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from lacuna.operators.grid import CELL_KEY, XYZ, bounds, with_cell, with_neighbours
from lacuna.session import ensure_checkpoints

PASSES = 24
SWEEP_ROWS = 10_000
CLEAR = 1e-9  # of the lengths compared: far above rounding


def _side(df: DataFrame, suffix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{c}{suffix}") for c in df.columns))


def _distance2(a: str = "", b: str = "_b") -> Column:
    out = F.lit(0.0)
    for c in XYZ:
        out = out + (F.col(f"{c}{a}") - F.col(f"{c}{b}")) * (F.col(f"{c}{a}") - F.col(f"{c}{b}"))
    return out


def typical_edge(points: DataFrame, per_cell: float) -> float:
    """Cell edge at which a cell of the points' bounding box holds ``per_cell`` points on average."""
    low, high = bounds(points)
    n = points.count()
    volume = math.prod(max(b - a, 1e-9) for a, b in zip(low, high, strict=True))
    widest = max((b - a for a, b in zip(low, high, strict=True)), default=1.0)
    return max((volume * per_cell / max(n, 1)) ** (1.0 / 3.0), widest / 1e6, 1e-12)


def pairs_within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """All pairs no farther apart than ``radius``, with ``d2``; the right side's columns carry ``_b``."""
    a = with_cell(left, radius)
    b = with_neighbours(_side(right, "_b"), radius, coords=tuple(f"{c}_b" for c in XYZ))
    found = a.join(b.hint("merge"), CELL_KEY).withColumn("d2", _distance2())
    return found.filter(F.col("d2") <= radius * radius).drop(*CELL_KEY)


def k_nearest(queries: DataFrame, points: DataFrame, k: int, query_id: str = "gal", point_id: str = "gal", per_cell: float | None = None) -> DataFrame:
    """query_id, rank from 1, neighbour, d2: the k nearest points of each query, ties by the neighbours' ids. A point of the same table is its own first neighbour."""
    queries = queries.select(F.col(query_id).alias("q"), *XYZ)
    points = points.select(F.col(point_id).alias("neighbour"), *XYZ)
    total = points.count()
    k = min(k, total)
    edge = typical_edge(points, per_cell or max(2.0, float(k)))  # a ball of one edge then holds about 4 k points
    left, parts = queries, []
    order = Window.partitionBy("q").orderBy("d2", "neighbour")
    right = _side(points, "_b").withColumnRenamed("neighbour_b", "neighbour")
    low, high = bounds(points.select(*XYZ).unionByName(queries.select(*XYZ)))
    span = math.sqrt(sum((b - a) ** 2 for a, b in zip(low, high, strict=True))) + 1e-9
    for _ in range(PASSES):
        last = edge >= span
        near = with_neighbours(left, edge).join(with_cell(right, edge, tuple(f"{c}_b" for c in XYZ)).hint("merge"), CELL_KEY).withColumn("d2", _distance2())
        ranked = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("q", "rank", "neighbour", "d2")
        if last:
            parts.append(ranked)
            break
        ensure_checkpoints(left.sparkSession)
        ranked = ranked.checkpoint()
        done = ranked.groupBy("q").agg(F.max("rank").alias("r"), F.max("d2").alias("m")).filter((F.col("r") == k) & (F.col("m") <= edge * edge)).select("q").hint("merge")
        parts.append(ranked.join(done, "q", "left_semi"))
        left = left.join(done, "q", "left_anti")
        if left.isEmpty():
            break
        edge *= 2.0
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.col("q").alias(query_id), "rank", "neighbour", "d2")


def nth_neighbour_distance(points: DataFrame, n: int, id_col: str = "gal") -> DataFrame:
    """id, dist: distance to the n-th nearest other point."""
    found = k_nearest(points, points, n + 1, id_col, id_col)
    return found.filter(F.col("rank") == n + 1).select(id_col, F.sqrt("d2").alias("dist"))


def without_duplicates(points: DataFrame) -> DataFrame:
    """Points whose coordinates no other point has: all copies of a repeated point go."""
    once = points.groupBy(*XYZ).agg(F.count("*").alias("n")).filter("n = 1").select(*XYZ)
    return points.join(once, list(XYZ), "left_semi").select(*points.columns)


def overlapping_spheres(left: DataFrame, right: DataFrame, largest: float) -> DataFrame:
    """Pairs of spheres nearer than the sum of their radii, with ``d``; cells have twice the largest radius, so neighbours suffice."""
    found = pairs_within(left, right, 2.0 * largest).filter(F.sqrt("d2") < F.col("radius") + F.col("radius_b"))
    return found.withColumn("d", F.sqrt("d2"))


def sphere_members(points: DataFrame, spheres: DataFrame, largest: float) -> DataFrame:
    """Pairs of a point and a sphere that holds it (d < r), the spheres' columns with ``_b``."""
    if largest <= 0:
        largest = 1.0
    return pairs_within(points, spheres, largest).filter(F.col("d2") < F.col("radius_b") * F.col("radius_b"))


def in_any_sphere(points: DataFrame, spheres: DataFrame, id_col: str = "gal") -> DataFrame:
    """Ids of the points that lie in a sphere."""
    largest = spheres.agg(F.max("radius")).first()[0] or 0.0
    return sphere_members(points.select(id_col, *XYZ), spheres.select(*XYZ, "radius"), largest).select(id_col).distinct()


def nearest_sphere(points: DataFrame, spheres: DataFrame, id_col: str = "gal", sphere_id: str = "hole") -> DataFrame:
    """id, sphere_id, inside: the sphere with the nearest centre, and whether it holds the point; a larger one farther off may hold it too."""
    found = k_nearest(points, spheres, 1, id_col, sphere_id)
    radii = spheres.select(F.col(sphere_id).alias("neighbour"), "radius")
    return found.join(radii.hint("merge"), "neighbour").select(id_col, F.col("neighbour").alias(sphere_id), (F.sqrt("d2") < F.col("radius")).alias("inside"))


def _clearly_contained(xyz: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Which spheres lie in another by more than rounding can undo. By falling radius; what lies in such a sphere lies in the one that holds it."""
    out = np.zeros(len(radius), bool)
    for i in np.argsort(-radius, kind="stable"):
        if not out[i]:
            d = np.sqrt(((xyz - xyz[i]) ** 2).sum(axis=1))
            out |= d + radius + CLEAR * (d + np.abs(radius) + abs(radius[i])) < radius[i]
    return out


def _sweep(batches):
    for batch in batches:
        for at in range(0, len(batch), SWEEP_ROWS):
            part = batch.slice(at, SWEEP_ROWS)
            xyz = np.stack([np.asarray(part.column(c), float) for c in XYZ], axis=1)
            gone = _clearly_contained(xyz, np.asarray(part.column("radius"), float))
            yield part.append_column("gone", pa.array(gone))


def contained_spheres(spheres: DataFrame, id_col: str = "hole") -> DataFrame:
    """Ids of the spheres that lie wholly in another (of equal ones, all but the least id).

    Batches are swept first: a sphere clearly in another of its batch is contained, and holds nothing that the other doesn't.
    The rest meet each other by classes of the radius: a sphere in one of a class is no farther from it than the greatest radius there
    less the least of its own class.
    """
    ensure_checkpoints(spheres.sparkSession)
    own = spheres.select(id_col, *XYZ, F.col("radius").cast("double").alias("radius"))
    own = own.select(id_col, *(F.col(c).cast("double").alias(c) for c in XYZ), "radius").dropna(subset=[*XYZ, "radius"])
    swept = own.mapInArrow(_sweep, StructType([*own.schema.fields, StructField("gone", BooleanType())])).checkpoint()
    left = swept.filter("not gone").drop("gone").withColumn("size", F.when(F.col("radius") > 0, F.floor(F.log2("radius"))).otherwise(-2000))
    found = swept.filter("gone").select(id_col)
    sizes = sorted(tuple(r) for r in left.groupBy("size").agg(F.min("radius"), F.max("radius")).collect())  # a row for each doubling of the radius
    for own_size, least, _ in sizes:
        for size, _, greatest in sizes:
            if size >= own_size:
                small, large = left.filter(F.col("size") == own_size).drop("size"), left.filter(F.col("size") == size).drop("size")
                reach = max((greatest - least) * (1.0 + CLEAR), greatest * 1e-6, 1e-12)
                both = pairs_within(small, large, reach).filter(F.col(id_col) != F.col(f"{id_col}_b"))
                inside = F.sqrt("d2") + F.col("radius") <= F.col("radius_b")
                tie = (F.col("radius") < F.col("radius_b")) | (F.col(id_col) > F.col(f"{id_col}_b"))
                found = found.unionByName(both.filter(inside & tie).select(id_col))
    return found.distinct()


def periodic_images(points: DataFrame, sides: tuple[float, float, float], depth: float) -> DataFrame:
    """The points and their images in the neighbouring boxes that lie within ``depth`` of the box [0, side); ``image`` tells them apart."""
    steps = F.array(*(F.array(*(F.lit(float(s * n)) for s, n in zip(step, sides, strict=True))) for step in [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]))
    out = points.withColumn("__s", F.explode(steps))
    moved = [(F.col(c) + F.col("__s")[k]).alias(c) for k, c in enumerate(XYZ)]
    out = out.select(*(c for c in points.columns if c not in XYZ), *moved, (F.aggregate("__s", F.lit(0.0), lambda a, x: a + F.abs(x)) > 0).alias("image"))
    for c, n in zip(XYZ, sides, strict=True):
        out = out.filter((F.col(c) >= -depth) & (F.col(c) <= n + depth))
    return out


def periodic_shell(points: DataFrame, sides: tuple[float, float, float], width: float, n: int) -> DataFrame:
    """Images of points of the box [0, side) whose farthest coordinate lies between ``width`` n and ``width`` (n + 1) outside it, both excluded."""
    images = periodic_images(points, sides, width * (n + 1)).filter("image").drop("image")
    out = F.greatest(*(F.abs(F.col(c) - side / 2.0) - side / 2.0 for c, side in zip(XYZ, sides, strict=True)))
    return images.filter((out > width * n) & (out < width * (n + 1)))
