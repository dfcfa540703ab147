"""Distances in flat matter-plus-vacuum cosmologies, as Column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The speeds of light (km/s) that the two void finders use.
C_SPHERES = 299792.0
C_WATERSHED = 299792.458
NODES = 32


def _quadrature() -> list[tuple[float, float]]:
    x, w = np.polynomial.legendre.leggauss(NODES)
    return [(float(a), float(b)) for a, b in zip(0.5 * (x + 1), 0.5 * w, strict=True)]


def comoving_distance(z: Column, omega_m: float = 0.3, h: float = 1.0, c: float = C_SPHERES) -> Column:
    """Comoving distance in Mpc/h (``h`` = 1) or Mpc: (c / 100h) times the integral of dz / E(z), by Gauss-Legendre quadrature on NODES nodes."""
    z = z.cast("double")
    total = F.lit(0.0)
    for x, w in _quadrature():
        e = F.sqrt(F.lit(omega_m) * F.pow(z * x + 1.0, F.lit(3.0)) + (1.0 - omega_m))
        total = total + F.lit(w) / e
    return total * z * (c / (100.0 * h))


def redshift_at(distance: Column, omega_m: float = 0.3, h: float = 1.0, c: float = C_WATERSHED, steps: int = 8) -> Column:
    """Inverse of :func:`comoving_distance` by Newton's method from the linear law; converges to rounding for redshifts of surveys (below about 5)."""
    unit = c / (100.0 * h)
    r = distance.cast("double")

    def refine(z: Column, _: Column) -> Column:
        e = F.sqrt(F.lit(omega_m) * F.pow(z + 1.0, F.lit(3.0)) + (1.0 - omega_m))
        return z + (r - comoving_distance(z, omega_m, h, c)) * e / unit

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), r / unit, refine)


def redshift_distance(z: Column, h: float = 1.0, c: float = C_SPHERES) -> Column:
    """The linear law c z / 100h."""
    return z.cast("double") * c / (100.0 * h)


def absolute_magnitude(m: Column, distance_mpc: Column) -> Column:
    return m - 5.0 * F.log10(distance_mpc * 1e6) + 5.0


def distances(z: np.ndarray, omega_m: float = 0.3, h: float = 1.0, c: float = C_SPHERES) -> np.ndarray:
    """:func:`comoving_distance` of an array."""
    z = np.asarray(z, float)
    x, w = np.array(_quadrature()).T
    return (w / np.sqrt(omega_m * (1 + z[..., None] * x) ** 3 + 1 - omega_m)).sum(-1) * z * c / (100 * h)
