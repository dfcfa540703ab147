"""Void flags for galaxies that arrive in a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.operators.grid import CELL_KEY, XYZ, with_cell, with_neighbours


def flag_stream(galaxies: DataFrame, holes: DataFrame, largest: float) -> DataFrame:
    """gal, hole for each arriving galaxy (gal, x, y, z) and each hole that holds it: a stateless join of the stream with the holes' cells. ``largest``: of the holes' radii."""
    side = holes.select("hole", *(F.col(c).alias(f"{c}_b") for c in XYZ), "radius")
    cells = with_neighbours(side, largest, coords=tuple(f"{c}_b" for c in XYZ))
    found = with_cell(galaxies, largest).join(cells, CELL_KEY)
    d2 = sum(((F.col(c) - F.col(f"{c}_b")) * (F.col(c) - F.col(f"{c}_b")) for c in XYZ), F.lit(0.0))
    return found.filter(d2 < F.col("radius") * F.col("radius")).select("gal", "hole")
