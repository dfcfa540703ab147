"""Selections of galaxies, and their split into wall and field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions import cosmology, sky
from lacuna.operators.grid import XYZ
from lacuna.operators.neighbors import nth_neighbour_distance, without_duplicates

MAGNITUDE_LIMIT = -20.09


def magnitude_cut(df: DataFrame, limit: float = MAGNITUDE_LIMIT, col: str = "rabsmag", strict: bool = False) -> DataFrame:
    """Galaxies at least as bright as ``limit`` (brighter, if strict)."""
    return df.filter(F.col(col) < limit if strict else F.col(col) <= limit)


def distance_cut(df: DataFrame, low: float | None, high: float | None, metric: str = "comoving", h: float = 1.0) -> DataFrame:
    """Both ends belong to it; ``metric`` redshift takes c z / 100h instead of Rgal."""
    r = F.col("Rgal") if metric == "comoving" else cosmology.redshift_distance(F.col("redshift"), h)
    if low is not None:
        df = df.filter(r >= low)
    return df if high is None else df.filter(r <= high)


def redshift_cut(df: DataFrame, low: float, high: float, col: str = "redshift") -> DataFrame:
    """Neither end belongs to it."""
    return df.filter((F.col(col) > low) & (F.col(col) < high))


def box_cut(df: DataFrame, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Strictly between the limits in each column named."""
    for c, (low, high) in limits.items():
        df = df.filter((F.col(c) > low) & (F.col(c) < high))
    return df


def with_xyz(df: DataFrame, metric: str = "comoving", h: float = 1.0) -> DataFrame:
    """x, y, z from ra, dec and Rgal (or c z / 100h)."""
    r = F.col("Rgal") if metric == "comoving" else cosmology.redshift_distance(F.col("redshift"), h)
    return df.withColumns(dict(zip(XYZ, sky.to_xyz(F.col("ra"), F.col("dec"), r), strict=True)))


def split_by(df: DataFrame, col: str, limit: float) -> tuple[DataFrame, DataFrame]:
    """Rows below the limit, and the others."""
    return df.filter(F.col(col) < limit), df.filter(F.col(col) >= limit)


def separation_limit(distances: DataFrame, col: str = "dist") -> DataFrame:
    """One row: avsep, sd (population), limit = avsep + 1.5 sd."""
    return distances.agg(F.avg(col).alias("avsep"), F.stddev_pop(col).alias("sd")).withColumn("limit", F.col("avsep") + 1.5 * F.col("sd"))


def wall_field(points: DataFrame, neighbour: int = 3, id_col: str = "gal") -> DataFrame:
    """Points without repeated places, with ``dist`` to the n-th neighbour and ``wall``: nearer than the limit."""
    points = without_duplicates(points)
    dist = nth_neighbour_distance(points, neighbour, id_col)
    limit = F.broadcast(separation_limit(dist).select("limit"))  # one row
    flagged = dist.crossJoin(limit).select(id_col, "dist", (F.col("dist") < F.col("limit")).alias("wall"))
    return points.join(flagged, id_col)


def filter_galaxies(galaxies: DataFrame, dist_limits: tuple[float, float] | None = None, mag_cut: bool = True, rm_isolated: bool = True, dist_metric: str = "comoving", sep_neighbor: int = 3, magnitude_limit: float = MAGNITUDE_LIMIT, h: float = 1.0, id_col: str = "gal") -> tuple[DataFrame, DataFrame]:
    """Wall and field galaxies with x, y, z: cut in magnitude and distance, converted, and split. Without the split all are wall galaxies."""
    df = magnitude_cut(galaxies, magnitude_limit) if mag_cut else galaxies
    if dist_limits:
        df = distance_cut(df, *dist_limits, dist_metric, h)
    df = with_xyz(df, dist_metric, h).select(id_col, *XYZ)
    if not rm_isolated:
        return df, df.limit(0)
    split = wall_field(df, sep_neighbor, id_col)
    return split.filter("wall").select(id_col, *XYZ), split.filter("not wall").select(id_col, *XYZ)
