"""Voronoi cells by clipping: volumes, faces and neighbours.

A cell starts as a box around its point and is cut by the bisector planes of its neighbours in rising
distance, until the next neighbour is more than twice as far as the cell's farthest vertex. A cell
that still touches the start box is unbounded and has volume 0, as has one with a vertex outside the
survey, unless the box is the survey itself.

Cells are cut in batches (:mod:`lacuna.operators.cell_batches`); those with four planes (nearly) through one corner, as in
lattices, one by one as above.

Up to ``BROADCAST_POINTS`` points, images included, are shipped to all executors. More are cut into blocks with the points
around each; a cell whose search leaves what its block knows goes on with a doubled halo.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions.geometry import polygon_area
from lacuna.operators.cell_batches import BATCH, Faces, Leaves, cells_of, offsets, ragged
from lacuna.operators.grid import CELL_KEY, XYZ, bounds, typical, with_cell
from lacuna.operators.growth import PointIndex, Unfinished, known_box, with_halo
from lacuna.operators.mask import Footprint
from lacuna.session import ensure_checkpoints

BROADCAST_POINTS = 5_000_000
BLOCK_POINTS = 20_000.0  # of a block, about
SCHEMA = "gal long, volume double, bounded boolean, valid boolean, neighbours array<struct<gal:long,area:double,polygon:array<array<double>>>>"


def _box_faces(low: np.ndarray, high: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The six sides of a box, corners in order around each, labelled -1 to -6."""
    out = []
    for axis in range(3):
        u, v = [a for a in range(3) if a != axis]
        for k, side in enumerate((low, high)):
            corners = []
            for a, b in ((low[u], low[v]), (high[u], low[v]), (high[u], high[v]), (low[u], high[v])):
                p = np.empty(3)
                p[axis], p[u], p[v] = side[axis], a, b
                corners.append(p)
            out.append((-1 - 2 * axis - k, np.array(corners)))
    return out


def _cut(faces: list, label: int, normal: np.ndarray, offset: float, tiny: float) -> list | None:
    """Faces of the part with normal . p <= offset; None if the plane misses the cell."""
    heights = [f @ normal - offset for _, f in faces]
    if all((h <= tiny).all() for h in heights):
        return None
    out, rim = [], []
    for (name, points), h in zip(faces, heights, strict=True):
        inside = h <= tiny
        if inside.all():
            out.append((name, points))
            on = np.abs(h) <= tiny
            if on.sum() >= 2:
                rim.extend(points[on])
            continue
        if not inside.any():
            continue
        kept = []
        for k in range(len(points)):
            j = (k + 1) % len(points)
            if inside[k]:
                kept.append(points[k])
                if abs(h[k]) <= tiny:
                    rim.append(points[k])
            if inside[k] != inside[j] and abs(h[k]) > tiny and abs(h[j]) > tiny:
                p = points[k] + (points[j] - points[k]) * (h[k] / (h[k] - h[j]))
                kept.append(p)
                rim.append(p)
        if len(kept) >= 3:
            out.append((name, np.array(kept)))
    if len(rim) >= 3:
        rim = np.array(rim)
        centre = rim.mean(axis=0)
        u = rim[np.argmax(((rim - centre) ** 2).sum(axis=1))] - centre
        u /= np.linalg.norm(u) or 1.0
        v = np.cross(normal / np.linalg.norm(normal), u)
        angle = np.arctan2((rim - centre) @ v, (rim - centre) @ u)
        rim = rim[np.argsort(angle)]
        apart = np.linalg.norm(rim - np.roll(rim, 1, axis=0), axis=1) > 10 * tiny
        if apart.sum() >= 3:
            out.append((label, rim[apart]))
    return out


def voronoi_cell(index: PointIndex, me: int, p: np.ndarray, low: np.ndarray, high: np.ndarray) -> list:
    """Faces (neighbour's place in the index, or below 0 for the box; corners) of the cell of p."""
    faces = _box_faces(low, high)
    span = float(np.linalg.norm(high - low))
    tiny = 1e-12 * span
    reach, done = index.edge, 0.0
    farthest = max(float(np.sqrt(((f - p) ** 2).sum(axis=1)).max()) for _, f in faces)
    while True:
        found = index.ball(p, reach)
        d2 = ((index.xyz[found] - p) ** 2).sum(axis=1)
        fresh = (d2 > done * done) & (d2 <= reach * reach) & (found != me)
        for k in np.argsort(d2[fresh], kind="stable"):
            other, dist = found[fresh][k], np.sqrt(d2[fresh][k])
            if dist > 2.0 * farthest:
                return faces
            q = index.xyz[other]
            cut = _cut(faces, int(other), q - p, float((q @ q - p @ p) / 2.0), tiny * dist)
            if cut is not None:
                faces = cut
                farthest = max(float(np.sqrt(((f - p) ** 2).sum(axis=1)).max()) for _, f in faces)
        if reach > 2.0 * farthest or reach > 2.0 * span:
            return faces
        done, reach = reach, 2.0 * reach


def cell_volume(p: np.ndarray, faces: list) -> float:
    """Sum of the pyramids over the faces."""
    total = 0.0
    for _, f in faces:
        a, b = f[1:-1] - f[0], f[2:] - f[0]
        total += abs(float((np.cross(a, b) @ (f[0] - p)).sum())) / 6.0
    return total


def _rows(index, home, low, high, whole_box: bool, inside, points: np.ndarray, gals: np.ndarray, places: np.ndarray):
    for gal, place, p in zip(gals.tolist(), places.tolist(), points, strict=True):
        faces = voronoi_cell(index, place, p, low, high)
        bounded = whole_box or all(name >= 0 for name, _ in faces)
        corners = np.concatenate([f for _, f in faces]) if faces else np.zeros((0, 3))
        valid = bounded and (inside is None or all(inside(c) for c in corners))
        near = {}
        for name, f in faces:
            if name >= 0 and (other := int(home[name])) != gal:
                near.setdefault(other, []).append(f)
        listed = [{"gal": g, "area": sum(polygon_area(f) for f in fs), "polygon": fs[0].tolist()} for g, fs in near.items()]
        yield {"gal": gal, "volume": cell_volume(p, faces) if valid else 0.0, "bounded": bounded, "valid": valid, "neighbours": listed}


_ARROW = pa.schema([("gal", pa.int64()), ("volume", pa.float64()), ("bounded", pa.bool_()), ("valid", pa.bool_()), ("neighbours", pa.list_(pa.struct([("gal", pa.int64()), ("area", pa.float64()), ("polygon", pa.list_(pa.list_(pa.float64())))])))])


def _flagged(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, _ARROW.append(pa.field("unfinished", pa.bool_())))


def _all_inside(inside, corners: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """For each of n cells whether all its corners are in the footprint."""
    if inside is None:
        return np.ones(n, bool)
    if getattr(inside, "mode", None) == "box":
        good = ((corners >= np.array(inside.low)) & (corners <= np.array(inside.high))).all(axis=1)
    else:
        good = np.array([inside(c) for c in corners], bool)
    return np.bincount(of, ~good, minlength=n) == 0


def _batch(leaves: Leaves, home: np.ndarray, gals: np.ndarray, places: np.ndarray, low: np.ndarray, high: np.ndarray, whole_box: bool, inside, index) -> pa.Table:
    """Cells of the points at these places of ``leaves.points``, whose gals are ``home``; ``index()``: the points' index, for cells that are cut one by one and for the region known."""
    cells = cells_of(leaves, places, low, high)
    n = len(places)
    known = index()
    unfinished = np.zeros(n, bool)
    if known.low is not None:  # a corner is one as far as the ball around it is known
        at, r = cells.xyz + cells.p[cells.own], np.linalg.norm(cells.xyz, axis=1)[:, None]
        unfinished[cells.own[((at - r < known.low) | (at + r > known.high)).any(axis=1)]] = True
    by_one = []
    for k in np.flatnonzero(cells.hard).tolist():
        try:
            by_one += [row | {"unfinished": False} for row in _rows(known, home[leaves.rank[known.order]], low, high, whole_box, inside, cells.p[k : k + 1], gals[k : k + 1], np.flatnonzero(known.order == leaves.order[places[k]]))]
        except Unfinished:
            by_one.append({"gal": int(gals[k]), "volume": 0.0, "bounded": False, "valid": False, "neighbours": [], "unfinished": True})
    faces = Faces(cells)
    bounded = np.bincount(faces.cell, faces.label < 0, minlength=n) == 0 if not whole_box else np.ones(n, bool)
    valid = bounded.copy()
    look = np.flatnonzero(bounded[cells.own])
    valid &= _all_inside(inside, cells.xyz[look] + cells.p[cells.own[look]], cells.own[look], n)
    volume = np.where(valid, np.bincount(faces.cell, faces.area * faces.height, minlength=n) / 3.0, 0.0)
    other = np.where(faces.label >= 0, home[np.maximum(faces.label, 0)], -1) if len(home) else faces.label
    near = np.flatnonzero((faces.label >= 0) & (other != gals[faces.cell]) & ~unfinished[faces.cell])
    order = near[np.lexsort((near, other[near], faces.cell[near]))]  # faces of one cell against one home are one neighbour
    new = np.concatenate(([True], (faces.cell[order][1:] != faces.cell[order][:-1]) | (other[order][1:] != other[order][:-1]))) if len(order) else np.zeros(0, bool)
    first = order[new]
    area = np.bincount(np.cumsum(new) - 1, faces.area[order], minlength=len(first)) if len(order) else np.zeros(0)
    flat = ragged(faces.corners, faces.first[first], faces.count[first])
    polygon = pa.ListArray.from_arrays(pa.array(offsets(faces.count[first]), pa.int32()), pa.ListArray.from_arrays(pa.array(3 * np.arange(len(flat) + 1), pa.int32()), pa.array(flat.reshape(-1))))
    easy = np.flatnonzero(~cells.hard)
    size = np.bincount(faces.cell[first], minlength=n)[easy]
    neighbours = pa.ListArray.from_arrays(pa.array(offsets(size), pa.int32()), pa.StructArray.from_arrays([pa.array(other[first], pa.int64()), pa.array(area), polygon], ["gal", "area", "polygon"]))
    unfinished = unfinished[easy]
    made = pa.table([pa.array(gals[easy], pa.int64()), pa.array(np.where(unfinished, 0.0, volume[easy])), pa.array(bounded[easy] & ~unfinished), pa.array(valid[easy] & ~unfinished), neighbours, pa.array(unfinished)], names=[*_ARROW.names, "unfinished"])
    return pa.concat_tables([made.cast(_ARROW.append(pa.field("unfinished", pa.bool_()))), _flagged(by_one)])


def _batches(xyz: np.ndarray, home: np.ndarray, edge: float, known: tuple, gals: np.ndarray, points: np.ndarray, low, high, whole_box: bool, inside) -> Iterator[pa.Table]:
    leaves = Leaves(xyz)
    index = functools.cache(lambda: PointIndex(xyz, edge, *known))
    places = leaves.places(points)
    order = np.argsort(places)  # neighbours beside each other
    for k in range(0, len(order), BATCH):
        own = order[k : k + BATCH]
        yield _batch(leaves, home[leaves.order], gals[own], places[own], np.array(low), np.array(high), whole_box, inside, index)


def _cells(batches, shared, low, high, whole_box: bool, inside):
    own = [b for b in batches if b.num_rows]
    if not own:
        return
    xyz, home, edge = shared.value
    gals, *points = (np.concatenate([np.asarray(b.column(k)) for b in own]) for k in range(4))
    for made in _batches(xyz, home, edge, (), gals, np.stack(points, axis=1), low, high, whole_box, inside.value if inside else None):
        yield from made.drop_columns("unfinished").combine_chunks().to_batches()


def _block_cells(own: pa.Table, near: pa.Table, edge: float, known, low, high, whole_box: bool, inside) -> pa.Table:
    if not len(own):
        return _flagged([])
    xyz, points = (np.stack([np.asarray(t.column(c), float) for c in XYZ], axis=1) for t in (near, own))
    return pa.concat_tables(_batches(xyz, np.asarray(near.column("gal")), edge, known, np.asarray(own.column("gal")), points, low, high, whole_box, inside))


def _by_blocks(points: DataFrame, everything: DataFrame, n: int, low: tuple, high: tuple, whole_box: bool, footprint: Footprint | None, block: float | None) -> DataFrame:
    spark = points.sparkSession
    ensure_checkpoints(spark)
    a, b = bounds(everything)
    edge = typical(a, b, n, 2.0)
    block = block or typical(a, b, n, BLOCK_POINTS)
    inside = spark.sparkContext.broadcast(footprint.kernel() if footprint else None)
    left, halo, done = points, block / 2.0, None
    while True:
        own_halo = halo  # the round's own name: the kernel runs before the next round changes halo

        def kernel(key, own: pa.Table, near: pa.Table) -> pa.Table:
            return _block_cells(own, near, edge, known_box([k.as_py() for k in key], block, own_halo, a, b), low, high, whole_box, inside.value)

        keyed = with_cell(left, block).checkpoint()
        if keyed.isEmpty():
            return done
        near = with_halo(everything, keyed, block, own_halo).select(*CELL_KEY, *(F.col(c).alias(c) for c in ("gal", *XYZ)))  # columns of its own: the points are on both sides
        out = keyed.groupBy(*CELL_KEY).cogroup(near.groupBy(*CELL_KEY)).applyInArrow(kernel, f"{SCHEMA}, unfinished boolean").checkpoint()
        found = out.filter("not unfinished").drop("unfinished")
        done = found if done is None else done.unionByName(found)
        left = points.join(out.filter("unfinished").select("gal"), "gal", "left_semi")
        halo *= 2.0


def voronoi(points: DataFrame, low, high, footprint: Footprint | None = None, whole_box: bool = False, images: DataFrame | None = None, max_points: int = BROADCAST_POINTS, block: float | None = None) -> DataFrame:
    """gal, volume, bounded, valid, neighbours (gal, area, polygon of the shared face) of each point (gal, x, y, z).

    ``whole_box``: the box is the survey, and its sides are sides of cells. ``images``:
    further points (gal, x, y, z) that bound cells under their home point's gal, as in periodic boxes. Points of one
    place share a cell that none of them bounds; remove duplicates first.
    """
    spark = points.sparkSession
    points = points.select(F.col("gal").cast("long").alias("gal"), *XYZ)
    everything = points if images is None else points.unionByName(images.select(F.col("gal").cast("long").alias("gal"), *XYZ))
    n = everything.count()
    if n > max_points:
        return _by_blocks(points, everything, n, tuple(low), tuple(high), whole_box, footprint, block)
    table = everything.toArrow()
    xyz = np.stack([np.asarray(table.column(c)) for c in XYZ], axis=1) if n else np.zeros((0, 3))
    edge = typical(low, high, max(n, 1), 2.0)
    shared = spark.sparkContext.broadcast((xyz, np.asarray(table.column("gal")).astype(np.int64), edge))  # 32 bytes a point, at most max_points
    inside = spark.sparkContext.broadcast(footprint.kernel()) if footprint else None
    cut = functools.partial(_cells, shared=shared, low=tuple(low), high=tuple(high), whole_box=whole_box, inside=inside)
    return points.repartitionByRange(4 * spark.sparkContext.defaultParallelism, *XYZ).mapInArrow(cut, SCHEMA)


def adjacency(cells: DataFrame) -> DataFrame:
    """src, dst, area of the neighbour graph; each face from both sides."""
    return cells.select(F.col("gal").alias("src"), F.explode("neighbours").alias("n")).select("src", F.col("n.gal").alias("dst"), F.col("n.area").alias("area"))


def triangles(cells: DataFrame) -> DataFrame:
    """src, dst, p1, p2, p3: faces as fans of triangles."""
    faces = cells.select(F.col("gal").alias("src"), F.explode("neighbours").alias("n")).select("src", F.col("n.gal").alias("dst"), F.col("n.polygon").alias("p"))
    k = faces.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("p") - 2)))
    return k.select("src", "dst", F.col("p")[0].alias("p1"), F.col("p")[F.col("k")].alias("p2"), F.col("p")[F.col("k") + 1].alias("p3"))


def horizon(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """gal, hzn: whether a neighbour has volume 0."""
    flat = edges.join(cells.select(F.col("gal").alias("dst"), (F.col("volume") == 0).alias("flat")), "dst").groupBy(F.col("src").alias("gal")).agg(F.bool_or("flat").alias("hzn"))
    return cells.select("gal").join(flat, "gal", "left").select("gal", F.coalesce("hzn", F.lit(False)).alias("hzn"))
