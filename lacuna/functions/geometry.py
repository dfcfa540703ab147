"""Spheres, caps, and the small arithmetic of void catalogues."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def sphere_volume(r: Column) -> Column:
    return F.lit(4.0 * math.pi / 3.0) * F.pow(r, F.lit(3.0))


def effective_radius(volume: Column) -> Column:
    return F.pow(volume * (3.0 / (4.0 * math.pi)), F.lit(1.0 / 3.0))


def cap_volume(radius: Column, height: Column) -> Column:
    return F.lit(math.pi / 3.0) * height * height * (3.0 * radius - height)


def cap_height(radius: Column, other: Column, distance: Column) -> Column:
    """Height of the cap of the sphere of ``other`` that lies in the sphere of ``radius``."""
    return F.try_divide((radius - other + distance) * (radius + other - distance), 2.0 * distance)


def lens_volume(r1: Column, r2: Column, d: Column) -> Column:
    """Common volume of two spheres: 0 apart, the smaller sphere when contained, else two caps."""
    small = F.least(r1, r2)
    return (
        F.when(d >= r1 + r2, 0.0)
        .when(d <= F.abs(r1 - r2), sphere_volume(small))
        .otherwise(cap_volume(r1, cap_height(r2, r1, d)) + cap_volume(r2, cap_height(r1, r2, d)))
    )


def distance2(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    out = F.lit(0.0)
    for p, q in zip(a, b, strict=True):
        out = out + (p - q) * (p - q)
    return out


def fake_void_probability(ratio: Column) -> Column:
    """Chance that Poisson noise makes a void of this density contrast."""
    return F.exp(-5.12 * (ratio - 1.0) - 0.28 * F.pow(ratio - 1.0, F.lit(2.8)))


def fake_void_chance(ratio: float) -> float:
    return math.exp(-5.12 * (ratio - 1.0) - 0.28 * (ratio - 1.0) ** 2.8)


def significance(p: float) -> float:
    """Two-sided normal significance of a chance."""
    if p <= 0.0:
        return math.inf
    return -NormalDist().inv_cdf(p / 2.0) if p / 2.0 > 5e-324 else math.inf


def spiral_sphere(n: int) -> np.ndarray:
    """n points spread over the unit sphere along a golden spiral."""
    i = np.arange(n) + 0.5
    phi, theta = np.arccos(1.0 - 2.0 * i / n), np.pi * (1.0 + math.sqrt(5.0)) * i
    return np.stack((np.cos(theta) * np.sin(phi), np.sin(theta) * np.sin(phi), np.cos(phi)), axis=1)


def ball_mesh(largest: float, points_per_volume: float) -> tuple[np.ndarray, np.ndarray]:
    """Lattice points within 1.05 times the largest radius, by distance, and their distances; the step is 1 / points_per_volume ** 0.33."""
    step = 1.0 / points_per_volume**0.33
    n = math.ceil(1.05 * largest / step)
    axis = np.arange(-n, n + 1) * step
    grid = np.stack(np.meshgrid(axis, axis, axis, indexing="ij"), axis=-1).reshape(-1, 3)
    radius = np.sqrt((grid**2).sum(axis=1))
    order = np.argsort(radius, kind="stable")
    order = order[radius[order] <= 1.05 * largest]
    return grid[order], radius[order]


def header_number(value: float) -> float:
    """Rounding of numbers in catalogue headers: 3 significant digits below 1, otherwise 2 decimals."""
    if value == 0 or abs(value) >= 1:
        return round(float(value), 2)
    return float(f"{value:.3g}")


def common_divisors(sides: list[int]) -> list[int]:
    """Whole divisors that the sides of a box share, from 1 to below half the shortest."""
    return [d for d in range(1, math.ceil(min(sides) / 2)) if all(s % d == 0 for s in sides)]


def flatten(nested) -> list:
    """The leaves of nested lists, in order."""
    return [y for x in nested for y in (flatten(x) if isinstance(x, list | tuple | np.ndarray) else [x])]


def into_plane(polygon: np.ndarray) -> np.ndarray:
    """A planar polygon in coordinates of its own plane (third coordinate dropped)."""
    points = np.asarray(polygon, float)
    u = points[1] - points[0]
    u /= np.linalg.norm(u)
    normal = np.cross(u, points[2] - points[0])
    normal /= np.linalg.norm(normal)
    return np.stack(((points - points[0]) @ u, (points - points[0]) @ np.cross(normal, u)), axis=1)


def polygon_area(points: np.ndarray) -> float:
    """Area of a planar polygon in space, by a fan of triangles."""
    a = points[1:-1] - points[0]
    b = points[2:] - points[0]
    return float(np.linalg.norm(np.cross(a, b).sum(axis=0)) / 2.0) if len(points) > 2 else 0.0
