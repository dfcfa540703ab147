"""The sphere-growing void finder, end to end."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions import sky
from lacuna.operators.grid import XYZ, empty_cells, hole_grid
from lacuna.operators.growth import grow_spheres
from lacuna.operators.holes import check_bounds, combine_holes
from lacuna.operators.mask import Footprint
from lacuna.session import ensure_checkpoints
from lacuna.sources.tables import in_batches


@dataclass
class Voids:
    maximals: DataFrame
    holes: DataFrame
    info: dict = field(default_factory=dict)


def find_voids(
    wall: DataFrame,
    footprint: Footprint,
    field_galaxies: DataFrame | None = None,
    hole_grid_edge_length: float = 5.0,
    min_maximal_radius: float = 10.0,
    max_hole_mask_overlap: float = 0.1,
    pts_per_unit_volume: float = 0.01,
    check_only_empty_cells: bool = True,
    maximal_spheres_only: bool = False,
    resume_path: str | None = None,
    batch_cells: int = 1_000_000,
) -> Voids:
    """Voids of wall galaxies (columns x, y, z). The grid spans wall and field galaxies, or the box of the footprint.

    With ``resume_path`` cells grow in batches of ``batch_cells`` that are kept there, and a run that was broken off goes on where it stopped.
    """
    ensure_checkpoints(wall.sparkSession)
    span = wall.select(*XYZ) if field_galaxies is None else wall.select(*XYZ).unionByName(field_galaxies.select(*XYZ))
    grid = hole_grid(span, hole_grid_edge_length, *((footprint.low, footprint.high) if footprint.mode != "sky" else (None, None)))
    cells = empty_cells(wall, grid) if check_only_empty_cells else empty_cells(wall.limit(0), grid)
    grow = lambda some: grow_spheres(some, wall, footprint, grid.edge)
    if resume_path:
        batched = cells.withColumn("batch", F.expr(f"cell div {batch_cells}"))
        grown = in_batches(batched, "cell", "batch", resume_path, lambda some: grow(some.drop("batch"))).drop("batch")
    else:
        grown = grow(cells).checkpoint()
    holes = check_bounds(grown.withColumnRenamed("cell", "hole"), footprint, max_hole_mask_overlap, pts_per_unit_volume).checkpoint()
    maximals, members = combine_holes(holes, footprint, min_maximal_radius, maximal_spheres_only=maximal_spheres_only)
    if not maximal_spheres_only:
        r, ra, dec = sky.to_radec(*(F.col(c) for c in XYZ))
        maximals = maximals.withColumns({"r": r, "ra": ra, "dec": dec})
    info = {"HGEL": hole_grid_edge_length, "MMR": min_maximal_radius, "MHMO": max_hole_mask_overlap, "PPUV": pts_per_unit_volume, "CHKE": check_only_empty_cells, "GOX": grid.origin[0], "GOY": grid.origin[1], "GOZ": grid.origin[2]}
    return Voids(maximals, members, info)
