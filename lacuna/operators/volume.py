"""Volumes of unions and intersections of spheres."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.geometry import effective_radius
from lacuna.operators.grid import XYZ
from lacuna.operators.neighbors import sphere_members

SAMPLES = 10_000


def bounding_box(spheres: DataFrame) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Least x - r and greatest x + r."""
    row = spheres.agg(*(F.min(F.col(c) - F.col("radius")).alias(f"a{c}") for c in XYZ), *(F.max(F.col(c) + F.col("radius")).alias(f"b{c}") for c in XYZ)).first()
    return tuple(row[f"a{c}"] or 0.0 for c in XYZ), tuple(row[f"b{c}"] or 0.0 for c in XYZ)


def lattice(spark, low, high, step: float = 1.0, offset: float = 0.5) -> DataFrame:
    """id, x, y, z of the lattice points low + (k + offset) step below high, made where they are used."""
    n = [max(0, math.ceil((b - a) / step - offset)) for a, b in zip(low, high, strict=True)]
    points = spark.range(n[0] * n[1] * n[2])
    place = (F.expr(f"id div {max(1, n[1] * n[2])}"), F.expr(f"(id div {max(1, n[2])}) % {max(1, n[1])}"), F.expr(f"id % {max(1, n[2])}"))
    return points.select("id", *((F.lit(float(a)) + (p + offset) * float(step)).alias(c) for p, a, c in zip(place, low, XYZ, strict=True)))


def union_volume_grid(spheres: DataFrame, step: float = 1.0, offset: float = 0.5) -> float:
    """Volume of the union, by lattice points strictly inside a sphere."""
    low, high = bounding_box(spheres)
    largest = spheres.agg(F.max("radius")).first()[0]
    if not largest:
        return 0.0
    points = lattice(spheres.sparkSession, low, high, step, offset)
    return sphere_members(points, spheres.select(*XYZ, "radius"), largest).select("id").distinct().count() * step**3


def _samples(xyzr: np.ndarray, samples: int, seed: int) -> tuple[float, float, float, float]:
    """Union and intersection volumes with their binomial errors, by uniform points in the bounding box; a point on a sphere is in it."""
    low = (xyzr[:, :3] - xyzr[:, 3:]).min(axis=0)
    high = (xyzr[:, :3] + xyzr[:, 3:]).max(axis=0)
    points = np.random.default_rng(seed).uniform(low, high, (samples, 3))
    any_, all_ = np.zeros(samples, bool), np.ones(samples, bool)
    for row in xyzr:
        inside = ((points - row[:3]) ** 2).sum(axis=1) <= row[3] ** 2
        any_ |= inside
        all_ &= inside
    box = float(np.prod(high - low))
    out = []
    for hits in (any_, all_):
        p = hits.mean()
        out += [box * p, box * math.sqrt(p * (1 - p) / samples)]
    return tuple(out)


def sphere_volumes(spheres: DataFrame, by: str = "void", samples: int = SAMPLES, seed: int = 1) -> DataFrame:
    """by, union, union_error, common, common_error of each group of spheres, from seeded samples of its bounding box."""

    def volumes(table: pa.Table) -> pa.Table:
        xyzr = np.stack([table.column(c).to_numpy() for c in (*XYZ, "radius")], axis=1)
        key = table.column(by)[0].as_py()
        return pa.table({by: pa.array([key], pa.int64()), **{n: [v] for n, v in zip(("union", "union_error", "common", "common_error"), _samples(xyzr, samples, seed + key), strict=True)}})

    return spheres.select(F.col(by).cast("long").alias(by), *XYZ, "radius").groupBy(by).applyInArrow(volumes, f"{by} long, union double, union_error double, common double, common_error double")


def effective_radii(holes: DataFrame, samples: int = SAMPLES, seed: int = 1) -> DataFrame:
    """void, r_eff, r_eff_uncert: radius of the sphere of the same volume as the void's union of holes."""
    v = sphere_volumes(holes, "void", samples, seed)
    r = effective_radius(F.col("union"))
    return v.select("void", r.alias("r_eff"), (F.col("union_error") / (4.0 * math.pi * r * r)).alias("r_eff_uncert"))


def volume_of_spheres(spheres: DataFrame, samples: int = SAMPLES, seed: int = 1) -> DataFrame:
    """The one row of :func:`sphere_volumes` for all spheres together: the sample is a table that is joined with the spheres, so none of them meets all points. Zeros without spheres."""
    low, high = bounding_box(spheres)
    row = spheres.agg(F.count("*").alias("n"), F.max("radius").alias("r")).first()
    box = math.prod(b - a for a, b in zip(low, high, strict=True))
    part = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 53)) / float(1 << 53)
    points = spheres.sparkSession.range(samples).select("id", *((F.lit(a) + part(k) * (b - a)).alias(c) for k, (c, a, b) in enumerate(zip(XYZ, low, high, strict=True))))
    held = sphere_members(points, spheres.select(*XYZ, "radius"), row["r"] or 0.0).groupBy("id").agg(F.count("*").alias("c"))
    shares = held.agg((F.count("*") / float(samples)).alias("p"), (F.count_if(F.col("c") == row["n"]) / float(samples)).alias("q"))
    spread = lambda c: F.sqrt(F.col(c) * (1.0 - F.col(c)) / float(samples)) * box
    return shares.select((F.col("p") * box).alias("union"), spread("p").alias("union_error"), (F.col("q") * box).alias("common"), spread("q").alias("common_error"))
