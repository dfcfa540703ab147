"""Regular grids over point sets: shapes, cells, and equi-join keys for spatial joins."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


@dataclass(frozen=True)
class Grid:
    origin: tuple[float, float, float]
    edge: float
    shape: tuple[int, int, int]

    @property
    def cells(self) -> int:
        return self.shape[0] * self.shape[1] * self.shape[2]


def bounds(points: DataFrame) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Least and greatest coordinates; zeros for no points."""
    row = points.agg(*(f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in XYZ)).first()
    return tuple(row[f"min_{c}"] or 0.0 for c in XYZ), tuple(row[f"max_{c}"] or 0.0 for c in XYZ)


def hole_grid(points: DataFrame, edge: float, low=None, high=None) -> Grid:
    """The grid of search cells: from the least coordinates, as many edges as cover the box, or the box given."""
    if low is None:
        low, high = bounds(points)
    return Grid(tuple(map(float, low)), edge, tuple(max(1, math.ceil((b - a) / edge)) for a, b in zip(low, high, strict=True)))


def cell_of(grid: Grid, clamp: bool = True) -> list[Column]:
    """Cell of a point, truncated toward zero; the last cell also holds points on the far side."""
    out = []
    for c, o, n in zip(XYZ, grid.origin, grid.shape, strict=True):
        k = ((F.col(c) - o) / grid.edge).cast("int")
        out.append(F.least(F.greatest(k, F.lit(0)), F.lit(n - 1)) if clamp else k)
    return out


def occupancy(points: DataFrame, grid: Grid) -> DataFrame:
    """i, j, k, n: counts of points in the cells that have any."""
    return points.select(*(c.alias(a) for c, a in zip(cell_of(grid), "ijk", strict=True))).groupBy("i", "j", "k").agg(F.count("*").alias("n"))


def all_cells(spark, grid: Grid) -> DataFrame:
    """cell, i, j, k of every cell, generated where they are used."""
    nx, ny, nz = grid.shape
    cells = spark.range(grid.cells).withColumnRenamed("id", "cell")
    return cells.select("cell", (F.expr(f"cell div {ny * nz}")).cast("int").alias("i"), F.expr(f"(cell div {nz}) % {ny}").cast("int").alias("j"), F.expr(f"cell % {nz}").cast("int").alias("k"))


def empty_cells(points: DataFrame, grid: Grid) -> DataFrame:
    """Cells without a point, with their centres."""
    cells = all_cells(points.sparkSession, grid).join(occupancy(points, grid).select("i", "j", "k"), ["i", "j", "k"], "left_anti")
    return cells.select("cell", "i", "j", "k", *((F.col(a) + 0.5).__mul__(grid.edge).__add__(o).alias(c) for a, c, o in zip("ijk", XYZ, grid.origin, strict=True)))


def key(cols: list[Column] | tuple[Column, ...], edge: float | Column) -> list[Column]:
    """Cell numbers of coordinates in an unbounded grid."""
    return [F.floor(c / edge).alias(f"cell_{n}") for c, n in zip(cols, XYZ, strict=True)]


CELL_KEY = [f"cell_{c}" for c in XYZ]


def with_neighbours(df: DataFrame, edge: float, reach: int = 1, coords=XYZ) -> DataFrame:
    """Each row once for each of the (2 reach + 1)^3 cells around its own, under the columns of CELL_KEY."""
    steps = F.array(*(F.struct(*(F.lit(s).alias(n) for s, n in zip(step, XYZ, strict=True))) for step in itertools.product(range(-reach, reach + 1), repeat=3)))
    out = df.withColumn("__step", F.explode(steps))
    return out.select(*df.columns, *((F.floor(F.col(c) / edge) + F.col(f"__step.{n}")).alias(f"cell_{n}") for c, n in zip(coords, XYZ, strict=True)))


def with_cell(df: DataFrame, edge: float, coords=XYZ) -> DataFrame:
    return df.select("*", *key([F.col(c) for c in coords], edge))


def typical(low, high, n: int, per_cell: float) -> float:
    """Cell edge at which a cell of the box holds ``per_cell`` of n points on average."""
    sides = [max(b - a, 1e-9) for a, b in zip(low, high, strict=True)]
    return max((math.prod(sides) * per_cell / max(n, 1)) ** (1.0 / 3.0), max(sides) / 1e6, 1e-12)
