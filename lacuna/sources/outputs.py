"""Where the finders' results go: names of catalogues, header values, and the tables beside them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.operators.mask import Footprint, sky_coverage
from lacuna.operators.prune import METHODS
from lacuna.operators.select import separation_limit
from lacuna.sources.tables import Catalog


def catalogue_path(folder: str, survey: str, method: int | str | None = None) -> str:
    """The folder of a survey's catalogue: of spheres, or of zones by the pruning method (the variants of one method share it)."""
    if method is None:
        return f"{folder}/{survey}_spheres"
    names = {v: k for k, v in METHODS.items()}
    name = method.upper() if isinstance(method, str) else names[int(method)]
    return f"{folder}/{survey}_zones_{name.rstrip('23')}"


def save_preprocessing(spark: SparkSession, path: str, info: dict) -> None:
    """Limits and cosmology of the input (see :func:`lacuna.sources.tables.preprocess`)."""
    Catalog(info=info).update(spark, path)


def separation_info(distances: DataFrame, neighbour: int = 3, col: str = "dist") -> dict:
    row = separation_limit(distances, col).first()
    return {"SEPNEI": neighbour, "AVSEP": row["avsep"], "SD": row["sd"], "SEPLIM": row["limit"]}


def save_selection(path: str, wall: DataFrame, field: DataFrame, separation: dict | None = None, magnitude_limit: float | None = None) -> None:
    """Tables wall and field, and the cuts that made them."""
    cuts = {} if magnitude_limit is None else {"MAGLIM": magnitude_limit}
    Catalog({"wall": wall, "field": field}, cuts | (separation or {})).update(wall.sparkSession, path)


def survey_volume(footprint: Footprint, spark: SparkSession) -> dict:
    """COVSTR, COVDEG (of the sky, for a sky mask) and VOLUME."""
    if footprint.mode == "sky":
        steradians, degrees = sky_coverage(spark, footprint.cells, footprint.resolution)
        return {"COVSTR": steradians, "COVDEG": degrees, "VOLUME": steradians / 3.0 * (footprint.rmax**3 - max(footprint.rmin, 0.0) ** 3)}
    return {"VOLUME": math.prod(b - a for a, b in zip(footprint.low, footprint.high, strict=True))}


def save_mask(spark: SparkSession, path: str, footprint: Footprint) -> None:
    """Table mask (cells of a sky mask) with its resolution, limits and coverage."""
    limits = {"MSKRES": footprint.resolution, "DLIML": footprint.rmin, "DLIMU": footprint.rmax}
    tables = {"mask": footprint.cells} if footprint.mode == "sky" else {}
    Catalog(tables, (limits if tables else {}) | survey_volume(footprint, spark)).update(spark, path)


def void_info(maximals: DataFrame, holes: DataFrame) -> dict:
    row = maximals.agg(F.count("*").alias("n"), *(F.count_if(F.col("edge") == k).alias(f"e{k}") for k in (0, 1, 2))).first()
    return {"VOID": row["n"], "VOID0": row["e0"], "VOID1": row["e1"], "VOID2": row["e2"], "HOLE": holes.count()}


def save_voids(path: str, maximals: DataFrame, holes: DataFrame, footprint: Footprint, info: dict | None = None) -> None:
    """Tables maximals and holes, with counts, the settings of the run and the survey's volume."""
    spark = maximals.sparkSession
    Catalog({"maximals": maximals, "holes": holes}, (info or {}) | void_info(maximals, holes) | survey_volume(footprint, spark)).update(spark, path)
