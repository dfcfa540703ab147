"""Slices through void catalogues: circles, outlines and segments, as data."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions import sky
from lacuna.operators.grid import XYZ


def cone_circles(holes: DataFrame, dec0: float) -> DataFrame:
    """holes with r, ra, dec, distance of the centre from the cone of declination ``dec0``, and radius of the circle there (0 if it misses)."""
    r, ra, dec = sky.to_radec_unsigned(*(F.col(c) for c in XYZ))
    placed = holes.withColumns({"r": r, "ra": ra, "dec": dec})
    d = F.abs(F.col("r") * F.sin(F.radians(F.col("dec") - dec0)))
    return placed.withColumn("distance", d).withColumn("circle", _cut(F.col("radius"), F.col("distance")))


def plane_circles(holes: DataFrame, axis: str, height: float) -> DataFrame:
    """The same for the plane where ``axis`` equals ``height``."""
    return holes.withColumn("distance", F.abs(F.col(axis) - height)).withColumn("circle", _cut(F.col("radius"), F.col("distance")))


def _cut(radius: Column, d: Column) -> Column:
    return F.when(d > radius, 0.0).otherwise(F.sqrt(F.greatest(radius * radius - d * d, F.lit(0.0))))


def near_cone(galaxies: DataFrame, dec0: float, width: float, magnitude_limit: float | None = None) -> DataFrame:
    """Galaxies (Rgal, dec) nearer than ``width`` to the cone, and brighter than the limit if there is one."""
    d = F.col("Rgal") * F.sin(F.radians(F.col("dec") - dec0))
    out = galaxies.filter(d * d < width * width)
    return out if magnitude_limit is None else out.filter(F.col("rabsmag") < magnitude_limit)


def near_plane(galaxies: DataFrame, axis: str, height: float, width: float) -> DataFrame:
    return galaxies.filter((F.col(axis) - height) * (F.col(axis) - height) < width * width)


def outlines(circles: DataFrame, by: str = "void", points: int = 100) -> DataFrame:
    """by, nth, u, v: the points of each group's circles (u, v, circle) that no other circle holds, chained by nearest neighbours."""

    def chain(table: pa.Table) -> pa.Table:
        u, v, r = (table.column(c).to_numpy() for c in ("u", "v", "circle"))
        angle = np.arange(points) * 2.0 * np.pi / points
        x = (u[:, None] + r[:, None] * np.cos(angle)).reshape(-1)
        y = (v[:, None] + r[:, None] * np.sin(angle)).reshape(-1)
        owner = np.repeat(np.arange(len(u)), points)
        keep = np.ones(len(x), bool)
        for k in range(len(u)):
            keep &= (owner == k) | ((x - u[k]) ** 2 + (y - v[k]) ** 2 >= r[k] ** 2 * (1 - 1e-12))
        x, y = x[keep], y[keep]
        order, left = [], np.ones(len(x), bool)
        at = 0
        while left.any():
            if order:
                d = np.where(left, (x - x[at]) ** 2 + (y - y[at]) ** 2, np.inf)
                at = int(np.argmin(d))
            order.append(at)
            left[at] = False
        key = [table.column(by)[0].as_py()] * len(order)
        return pa.table({by: pa.array(key, pa.int64()), "nth": pa.array(range(len(order)), pa.int64()), "u": x[order], "v": y[order]})

    flat = circles.filter("circle > 0").select(F.col(by).cast("long").alias(by), "u", "v", "circle")
    return flat.groupBy(by).applyInArrow(chain, f"{by} long, nth long, u double, v double")


def plane_segments(triangles: DataFrame, axis: int, height: float) -> DataFrame:
    """Segments (a, b) in which triangles (p1, p2, p3) cross the plane where coordinate ``axis`` is ``height``."""
    h = [F.col(f"p{k}")[axis] - height for k in (1, 2, 3)]

    def cross(i: int, j: int) -> Column:
        t = F.try_divide(h[i], h[i] - h[j])
        return F.when((h[i] < 0) != (h[j] < 0), F.array(*(F.col(f"p{i + 1}")[c] + t * (F.col(f"p{j + 1}")[c] - F.col(f"p{i + 1}")[c]) for c in range(3))))

    ends = F.array_compact(F.array(cross(0, 1), cross(1, 2), cross(2, 0)))
    return triangles.withColumn("__e", ends).filter(F.size("__e") == 2).withColumns({"a": F.col("__e")[0], "b": F.col("__e")[1]}).drop("__e")


def cone_segments(triangles: DataFrame, dec0: float) -> DataFrame:
    """Segments (a, b), and r and ra of their ends, in which triangles (p1, p2, p3) cross the cone of declination ``dec0``.

    Along an edge, x^2 + y^2 - (z / tan dec0)^2 is a quadratic; the root that lies on the edge, on the cone's side, is the crossing.
    """
    if dec0 == 0:
        return _polar(plane_segments(triangles, 2, 0.0))
    k2 = 1.0 / np.tan(np.radians(dec0)) ** 2
    side = float(np.sign(dec0))
    above = [F.degrees(F.atan2(F.col(f"p{k}")[2], F.sqrt(F.col(f"p{k}")[0] ** 2 + F.col(f"p{k}")[1] ** 2))) > dec0 for k in (1, 2, 3)]

    def form(u, v) -> Column:
        return u[0] * v[0] + u[1] * v[1] - k2 * u[2] * v[2]

    def cross(i: int, j: int) -> Column:
        p, q = F.col(f"p{i + 1}"), F.col(f"p{j + 1}")
        d = [q[c] - p[c] for c in range(3)]
        a, b, c = form(d, d), 2.0 * form(p, d), form(p, p)
        root = F.sqrt(F.greatest(b * b - 4.0 * a * c, F.lit(0.0)))
        tries = F.array(F.try_divide(-b - root, 2.0 * a), F.try_divide(-b + root, 2.0 * a), F.try_divide(-c, b))
        t = F.filter(tries, lambda x: x.isNotNull() & (x >= -1e-12) & (x <= 1 + 1e-12) & ((p[2] + x * d[2]) * side >= 0))
        t = F.try_element_at(t, F.lit(1))
        return F.when(above[i] != above[j], F.array(*(p[n] + t * d[n] for n in range(3))))

    ends = F.filter(F.array(cross(0, 1), cross(1, 2), cross(2, 0)), lambda e: e.isNotNull() & e[0].isNotNull())
    cut = triangles.withColumn("__e", ends).filter(F.size("__e") == 2).withColumns({"a": F.col("__e")[0], "b": F.col("__e")[1]}).drop("__e")
    return _polar(cut)


def _polar(segments: DataFrame) -> DataFrame:
    for end in "ab":
        r, ra, _ = sky.to_radec_unsigned(*(F.col(end)[k] for k in range(3)))
        segments = segments.withColumns({f"r_{end}": r, f"ra_{end}": ra})
    return segments


def chain_segments(segments: DataFrame, by: str = "void", tolerance: float = 1e-9) -> DataFrame:
    """by, loop, nth, x, y, z: segments (a, b) of each group joined end to end into loops."""

    def chain(table: pa.Table) -> pa.Table:
        a, b = (np.array(table.column(c).to_pylist(), float) for c in "ab")
        left, rows, loop = set(range(len(a))), [], 0
        while left:
            k = min(left)
            left.remove(k)
            path = [a[k], b[k]]
            while left:
                rest = np.array(sorted(left))
                d = np.stack((np.linalg.norm(a[rest] - path[-1], axis=1), np.linalg.norm(b[rest] - path[-1], axis=1)))
                side, j = np.unravel_index(np.argmin(d), d.shape)
                if d[side, j] > tolerance:
                    break
                left.remove(int(rest[j]))
                path.append(b[rest[j]] if side == 0 else a[rest[j]])
            rows += [(loop, n, *map(float, p)) for n, p in enumerate(path)]
            loop += 1
        columns = list(zip(*rows, strict=True))
        key = [table.column(by)[0].as_py()] * len(rows)
        return pa.table({by: pa.array(key, pa.int64()), "loop": pa.array(columns[0], pa.int64()), "nth": pa.array(columns[1], pa.int64()), **{c: pa.array(columns[2 + k], pa.float64()) for k, c in enumerate(XYZ)}})

    return segments.select(F.col(by).cast("long").alias(by), "a", "b").groupBy(by).applyInArrow(chain, f"{by} long, loop long, nth long, x double, y double, z double")
