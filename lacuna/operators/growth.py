"""Growth of spheres from empty cells until four galaxies bound them.

From the centre of a cell the sphere first touches the nearest galaxy, then moves away from it, then away
from the middle of two, then along the normal of three, each time until the next galaxy
bounds it. A sphere that is moved along a ray while it keeps touching its galaxies sweeps only balls that
contain it, so the first galaxy to bound it is found in the ball of a trial step, doubled until one is there.

Up to ``BROADCAST_POINTS`` galaxies are shipped to all executors. Beyond, space is cut into
blocks that get the galaxies within a halo; cells whose search leaves the halo are searched again
with a doubled one.
"""

from __future__ import annotations

import functools
import math
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.operators.grid import CELL_KEY, XYZ, bounds, with_cell
from lacuna.operators.mask import Footprint, Inside

BROADCAST_POINTS = 5_000_000
SCHEMA = "cell long, x double, y double, z double, radius double, unfinished boolean"


class Unfinished(Exception):
    """A search left the region whose galaxies are known."""


class PointIndex:
    """Points sorted by cell; ``low`` and ``high`` bound the region in which all points are known."""

    def __init__(self, xyz: np.ndarray, edge: float, low=None, high=None):
        self.edge = edge
        self.origin = xyz.min(axis=0) if len(xyz) else np.zeros(3)
        self.shape = (np.floor(((xyz.max(axis=0) if len(xyz) else self.origin) - self.origin) / edge)).astype(np.int64) + 1
        cell = np.floor((xyz - self.origin) / edge).astype(np.int64)
        key = (cell[:, 0] * self.shape[1] + cell[:, 1]) * self.shape[2] + cell[:, 2]
        order = np.argsort(key, kind="stable")
        self.xyz, self.key, self.order = xyz[order], key[order], order
        self.low, self.high = low, high

    def ball(self, centre: np.ndarray, radius: float) -> np.ndarray:
        """Indices of points in the cells that meet the ball's bounding box."""
        if self.low is not None and ((centre - radius < self.low) | (centre + radius > self.high)).any():
            raise Unfinished
        a = np.maximum(np.floor((centre - radius - self.origin) / self.edge).astype(np.int64), 0)
        b = np.minimum(np.floor((centre + radius - self.origin) / self.edge).astype(np.int64), self.shape - 1)
        if (b < a).any():
            return np.zeros(0, np.int64)
        i, j = np.arange(a[0], b[0] + 1), np.arange(a[1], b[1] + 1)
        rows = ((i[:, None] * self.shape[1] + j) * self.shape[2]).reshape(-1)
        first, last = np.searchsorted(self.key, rows + a[2]), np.searchsorted(self.key, rows + b[2], "right")
        some = last > first
        if not some.any():
            return np.zeros(0, np.int64)
        return np.concatenate([np.arange(s, e) for s, e in zip(first[some].tolist(), last[some].tolist(), strict=True)])


def _nearest(index: PointIndex, p: np.ndarray, reach: float) -> int:
    radius = index.edge
    while True:
        found = index.ball(p, radius)
        if len(found):
            d2 = ((index.xyz[found] - p) ** 2).sum(axis=1)
            k = int(np.argmin(d2))
            if d2[k] <= radius * radius:
                return int(found[k])
        if radius > reach:
            return -1
        radius *= 2.0


def _step(index: PointIndex, p: np.ndarray, u: np.ndarray, used: list[int], reach: float) -> tuple[int, float]:
    """The next galaxy that bounds a sphere moved from p along u, and how far it moves; -1 if none does."""
    first = index.xyz[used[0]]
    trial = index.edge
    while trial <= reach:
        centre = p + trial * u
        found = index.ball(centre, float(np.linalg.norm(centre - first)) * (1 + 1e-12))
        found = found[~np.isin(found, used)]
        q = index.xyz[found]
        down = 2.0 * ((q - first) @ u)
        up = ((q - p) ** 2).sum(axis=1) - ((first - p) ** 2).sum()
        with np.errstate(divide="ignore", invalid="ignore"):
            x = np.where(down != 0, up / down, -1.0)
        good = (x >= 0) & (x <= trial)
        if good.any():
            k = np.flatnonzero(good)[np.argmin(x[good])]
            return int(found[k]), float(x[k])
        trial *= 2.0
    return -1, 0.0


def _unit(v: np.ndarray) -> np.ndarray | None:
    n = float(np.linalg.norm(v))
    return v / n if n > 0 else None


def grow_one(index: PointIndex, inside: Inside, p: np.ndarray, reach: float) -> tuple[np.ndarray, float] | None:
    """Centre and radius of the sphere grown from p, or None."""
    if not inside(p):
        return None
    start = p
    g1 = _nearest(index, p, reach)
    if g1 < 0:
        return None
    a = index.xyz[g1]
    u = _unit(p - a)
    if u is None:
        u = np.array([0.0, 0.0, 1.0])
    g2, x = _step(index, p, u, [g1], reach)
    if g2 < 0 or not inside(p := p + x * u):
        return None
    b = index.xyz[g2]
    u = _unit(p - (a + b) / 2.0)
    if u is None:
        u = _unit(np.cross(a - b, np.array([0.0, 0.0, 1.0])))
        if u is None:
            u = np.array([1.0, 0.0, 0.0])
    g3, x = _step(index, p, u, [g1, g2], reach)
    if g3 < 0 or not inside(p := p + x * u):
        return None
    c = index.xyz[g3]
    u = _unit(np.cross(a - b, c - b))
    if u is None:
        return None
    side = float((p - (a + b + c) / 3.0) @ u)
    tries = [u, -u] if abs(side) <= 1e-12 * max(1.0, float(np.linalg.norm(p - start))) else [u if side > 0 else -u]
    found = [(x, g, v) for v in tries for g, x in [_step(index, p, v, [g1, g2, g3], reach)] if g >= 0]
    if not found:
        return None
    x, _, u = min(found, key=lambda f: f[0])
    if not inside(p := p + x * u):
        return None
    return p, float(np.linalg.norm(p - a))


def _grow_rows(index: PointIndex, inside: Inside, cells: np.ndarray, centres: np.ndarray, reach: float) -> pa.RecordBatch:
    rows = []
    for cell, p in zip(cells.tolist(), centres, strict=True):
        try:
            found = grow_one(index, inside, p, reach)
            if found:
                rows.append((cell, *map(float, found[0]), found[1], False))
        except Unfinished:
            rows.append((cell, *map(float, p), 0.0, True))
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    types = [pa.int64(), *[pa.float64()] * 4, pa.bool_()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _table(columns) -> np.ndarray:
    return np.stack([np.asarray(c, float) for c in columns], axis=1) if len(columns[0]) else np.zeros((0, 3))


def _grow_all(batches, points, inside, reach: float):
    index = None
    for batch in batches:
        if index is None:
            index = PointIndex(points.value[0], points.value[1])
        yield _grow_rows(index, inside.value, np.asarray(batch.column(0)), _table(batch.columns[1:4]), reach)


def known_box(key, block: float, halo: float, low, high) -> tuple[np.ndarray, np.ndarray]:
    """The region around a block in which all points are known; it has no end where it reaches the survey's."""
    key = np.array(key, float)
    a, b = key * block - halo, (key + 1) * block + halo
    return np.where(a <= np.array(low), -np.inf, a), np.where(b >= np.array(high), np.inf, b)


def with_halo(points: DataFrame, blocks: DataFrame, block: float, halo: float) -> DataFrame:
    """Each point (x, y, z) once for each of the ``blocks`` (columns of CELL_KEY) that it lies within ``halo`` of; nothing else is made on the way but the blocks of their bounding box."""
    span = blocks.agg(*(F.min(k).alias(f"a{k}") for k in CELL_KEY), *(F.max(k).alias(f"b{k}") for k in CELL_KEY)).first()
    out = points
    for c, k in zip(XYZ, CELL_KEY, strict=True):
        first, last = F.greatest(F.floor((F.col(c) - halo) / block), F.lit(span[f"a{k}"])), F.least(F.floor((F.col(c) + halo) / block), F.lit(span[f"b{k}"]))
        out = out.withColumns({"first": first, "last": last}).filter("first <= last").withColumn(k, F.explode(F.sequence("first", "last"))).drop("first", "last")
    return out.join(blocks.select(*CELL_KEY).distinct(), CELL_KEY, "left_semi")


def grow_spheres(cells: DataFrame, points: DataFrame, footprint: Footprint, edge: float, broadcast_points: int = BROADCAST_POINTS, block: float | None = None) -> DataFrame:
    """cell, x, y, z, radius of the spheres grown from the cells' centres (columns cell, x, y, z). A centre outside the footprint grows nothing."""
    spark = points.sparkSession
    low, high = bounds(points)
    reach = 4.0 * math.dist(low, high) + edge
    inside = spark.sparkContext.broadcast(footprint.kernel())
    start = footprint.inside(cells.select("cell", *XYZ))
    parts = max(spark.sparkContext.defaultParallelism * 4, 1)
    if points.count() <= broadcast_points:
        table = points.select(*XYZ).toArrow()
        xyz = _table([table.column(c) for c in XYZ])
        shared = spark.sparkContext.broadcast((xyz, edge))  # 24 bytes a point, at most broadcast_points of them
        out = start.repartition(parts, "cell").mapInArrow(functools.partial(_grow_all, points=shared, inside=inside, reach=reach), SCHEMA)
        return out.drop("unfinished")
    return _by_blocks(start, points, inside, edge, reach, block or 20.0 * edge, low, high)


def _by_blocks(start: DataFrame, points: DataFrame, inside, edge: float, reach: float, block: float, low, high) -> DataFrame:
    """Blocks with the points around them; cells whose search leaves what is known go on with doubled halos."""
    left, halo, done = start, block / 2.0, None
    side = points.select(*XYZ)
    while True:
        own = halo  # the round's own name: the kernel runs before the next round changes halo

        def kernel(key, a: pa.Table, b: pa.Table) -> pa.Table:
            if not len(a):
                return pa.Table.from_batches([_grow_rows(PointIndex(np.zeros((0, 3)), edge), inside.value, np.zeros(0, np.int64), np.zeros((0, 3)), reach)])
            index = PointIndex(_table([b.column(c) for c in XYZ]), edge, *known_box([k.as_py() for k in key], block, own, low, high))
            rows = _grow_rows(index, inside.value, np.asarray(a.column("cell")), _table([a.column(c) for c in XYZ]), reach)
            return pa.Table.from_batches([rows])

        keyed = with_cell(left, block).checkpoint()
        if keyed.isEmpty():
            return done if done is not None else start.withColumn("radius", F.lit(0.0)).limit(0)
        near = with_halo(side, keyed, block, own)
        out = keyed.groupBy(*CELL_KEY).cogroup(near.groupBy(*CELL_KEY)).applyInArrow(kernel, SCHEMA).checkpoint()
        found = out.filter("not unfinished").drop("unfinished")
        done = found if done is None else done.unionByName(found)
        left = out.filter("unfinished").select("cell", *XYZ)
        halo *= 2.0
