"""Voronoi cells of many points at once, as lists of corners.

A cell is kept by its corners, each with the three planes that meet there, in order around the corner. A plane
that cuts the cell takes the corners beyond it; each edge from one that goes to one that stays gets a new corner.
All cells of a batch are cut by one plane each at a time.

After the nearest points' planes, each new corner is held against the points that are nearer to it than the cell's own
point: these cut it, and where there are none it is a corner of the cell for good. Such points are looked for
in boxes of some tens of points, the nearest boxes first.

Cells with four planes (nearly) through one corner are left to :func:`lacuna.operators.voronoi.voronoi_cell`.
"""

from __future__ import annotations

import numpy as np

LEAF_POINTS = 24  # of a box, about
BATCH = 256  # cells
NEAREST = 20  # points whose planes cut first, and in a round at most
ROUNDS = 100
SOFT = 1e-10  # of the box's diagonal: corners nearer to a plane aren't told apart from ones on it
FLAT = 1e-9  # determinant of unit normals of planes that meet in no clear point
PAIRS = 1 << 19


def offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``flat[s : s + n]`` for each s, n, concatenated."""
    shift = starts - (np.cumsum(sizes) - sizes)
    return flat[np.repeat(shift, sizes) + np.arange(int(sizes.sum()))]


class Leaves:
    """Points in boxes: slabs by x, each cut by y, each of these by z, of about as many points each."""

    def __init__(self, xyz: np.ndarray):
        n = len(xyz)
        s = max(1, round((n / LEAF_POINTS) ** (1.0 / 3.0)))
        group = np.zeros(n, np.int64)
        order = np.arange(n)
        for axis in range(3):
            order = np.lexsort((xyz[:, axis], group))
            own = group[order]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if n else np.zeros(0, np.int64)
            size = np.diff(np.append(first, n))
            group[order] = own * s + (np.arange(n) - np.repeat(first, size)) * s // np.repeat(size, size)
        own = group[order]
        self.order, self.points = order, xyz[order]
        self.first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if n else np.zeros(0, np.int64)
        self.size = np.diff(np.append(self.first, n))
        self.low, self.high = (f.reduceat(self.points, self.first) if n else np.zeros((0, 3)) for f in (np.minimum, np.maximum))
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)

    def places(self, points: np.ndarray) -> np.ndarray:
        """Where these points, each one of the leaves', stand in ``points``."""
        order = np.lexsort(self.points.T[::-1])
        x, y, z = self.points[order].T
        at, last = np.searchsorted(x, points[:, 0]), len(order) - 1
        while True:
            other = np.flatnonzero((x[np.minimum(at, last)] == points[:, 0]) & ((y[np.minimum(at, last)] != points[:, 1]) | (z[np.minimum(at, last)] != points[:, 2])) & (at < last))
            if not len(other):
                return order[at]
            at[other] += 1

    def distance2(self, low: np.ndarray, high: np.ndarray, boxes: np.ndarray) -> np.ndarray:
        """Squared distances between the boxes [low, high] (rows) and these boxes (columns)."""
        out = np.zeros((len(low), len(boxes)))
        for axis in range(3):
            d = np.maximum(self.low[boxes, axis] - high[:, axis, None], low[:, axis, None] - self.high[boxes, axis])
            np.maximum(d, 0.0, out=d)
            out += d * d
        return out


class Cells:
    """Cells around the points ``p``, begun as the box; coordinates of corners and planes count from the cell's point.

    Corners: ``own`` (the cell), ``planes``, ``xyz``, ``fresh`` (not held against the points yet). Planes: ``normal``, ``offset``, ``label``, ``cell``.
    """

    def __init__(self, p: np.ndarray, low: np.ndarray, high: np.ndarray):
        m = len(p)
        self.p, self.span = p, float(np.linalg.norm(high - low))
        self.hard = np.zeros(m, bool)
        self.normal = np.tile(np.array([[s if a == k else 0.0 for a in range(3)] for k in range(3) for s in (-1.0, 1.0)]), (m, 1))
        self.offset = np.stack([x[:, k] for k in range(3) for x in (p - low, high - p)], axis=1).reshape(-1)
        self.label, self.cell = np.tile(-1 - np.arange(6), m), np.repeat(np.arange(m), 6)
        signs = np.array([(i, j, k) for i in (0, 1) for j in (0, 1) for k in (0, 1)])
        planes = signs + np.array([0, 2, 4])
        turned = signs.sum(axis=1) % 2 == 0
        planes[turned] = planes[turned][:, [0, 2, 1]]
        self.own = np.repeat(np.arange(m), 8)
        self.planes = (np.tile(planes, (m, 1)) + 6 * self.own[:, None]).astype(np.int64)
        corners = np.where(signs == 1, high, low)
        self.xyz = (corners[None] - p[:, None]).reshape(-1, 3)
        self.fresh = np.ones(8 * m, bool)

    def cut(self, cell: np.ndarray, normal: np.ndarray, label: np.ndarray) -> None:
        """Cut each of these cells (distinct ones) by the plane halfway to a point, at ``normal`` from its own."""
        m = len(self.p)
        offset = (normal * normal).sum(axis=1) / 2.0
        at = np.full(m, -1)
        at[cell] = np.arange(len(cell))
        rows = np.flatnonzero(at[self.own] >= 0)
        k = at[self.own[rows]]
        h = np.einsum("ij,ij->i", normal[k], self.xyz[rows]) - offset[k]
        self.hard[self.own[rows[np.abs(h) <= SOFT * self.span * np.sqrt(2.0 * offset[k])]]] = True
        gone = rows[h > 0]
        if not len(gone):
            return
        base = len(self.offset)
        self.normal, self.offset, self.label, self.cell = (np.concatenate(x) for x in ((self.normal, normal), (self.offset, offset), (self.label, label), (self.cell, cell)))
        a, b, owner = self.planes[gone].reshape(-1), self.planes[gone][:, [1, 2, 0]].reshape(-1), np.repeat(self.own[gone], 3)
        key = np.minimum(a, b) << 32 | np.maximum(a, b)
        order = np.argsort(key)
        other = key[order][1:] != key[order][:-1]
        edge = order[np.concatenate(([True], other)) & np.concatenate((other, [True]))]  # of one corner that goes only
        a, b, owner = a[edge], b[edge], owner[edge]
        ring = np.sort(a)
        self.hard[self.cell[ring[1:][ring[1:] == ring[:-1]]]] = True  # a plane twice around what goes
        new = np.stack((a, b, base + at[owner]), axis=1)
        n, d = self.normal[new], self.offset[new]
        sides = np.cross(n[:, [1, 2, 0]], n[:, [2, 0, 1]])
        det = np.einsum("ij,ij->i", n[:, 0], sides[:, 0])
        flat = np.abs(det) <= FLAT * np.prod(np.linalg.norm(n, axis=2), axis=1)
        self.hard[owner[flat]] = True
        xyz = np.einsum("ij,ijk->ik", d, sides) / np.where(flat, 1.0, det)[:, None]
        stays = np.ones(len(self.own), bool)
        stays[gone] = False
        self.own = np.concatenate((self.own[stays], owner))
        easy = ~self.hard[self.own]
        self.own = self.own[easy]
        self.planes, self.xyz, self.fresh = (np.concatenate((x[stays], y))[easy] for x, y in ((self.planes, new), (self.xyz, xyz), (self.fresh, np.ones(len(new), bool))))

    def cut_all(self, cell: np.ndarray, place: np.ndarray, points: np.ndarray) -> None:
        """Cut by the NEAREST of these points of each cell, in rising distance."""
        normal = points[place] - self.p[cell]
        order = np.lexsort(((normal * normal).sum(axis=1), cell))
        cell, place, normal = cell[order], place[order], normal[order]
        first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, np.int64)
        step = np.arange(len(cell)) - np.repeat(first, np.diff(np.append(first, len(cell))))
        for k in range(min(NEAREST, int(step.max()) + 1 if len(step) else 0)):
            now = np.flatnonzero((step == k) & ~self.hard[cell])
            self.cut(cell[now], normal[now], place[now])

    def cutters(self, leaves: Leaves, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, point) where a point is nearer to a corner than the cell's own, for each of these corners some if there are any; the corners without."""
        r2 = (self.xyz[rows] ** 2).sum(axis=1) * (1.0 + 1e-9) + 1e-30
        rows, r2 = (x[np.argsort(r2)] for x in (rows, r2))  # so corners that reach far have few others beside them
        at, r = self.xyz[rows] + self.p[self.own[rows]], np.sqrt(r2)[:, None]
        found, none = [], []
        stop = 0
        while stop < len(rows):
            some = np.arange(stop, min(stop + 512, len(rows)))
            boxes = np.flatnonzero(((leaves.low <= (at + r)[some].max(axis=0)) & (leaves.high >= (at - r)[some].min(axis=0))).all(axis=1))
            some = some[: max(1, PAIRS // max(1, len(boxes)))]
            stop += len(some)
            d2 = leaves.distance2(at[some], at[some], boxes)
            i, j = np.nonzero(d2 <= r2[some][:, None])
            near = np.lexsort((d2[i, j], i))
            i, j = i[near], boxes[j[near]]
            count = np.bincount(i, minlength=len(some))
            begin, done, left, width = offsets(count)[:-1], np.zeros(len(some), np.int64), np.arange(len(some)), 6
            while len(left):
                take = np.minimum(count[left] - done[left], width)
                hit = np.zeros(len(left), bool)
                slot = np.repeat(np.arange(len(left)), take)
                box = ragged(j, begin[left] + done[left], take)
                for a, b in _slices(leaves.size[box], PAIRS):
                    size = leaves.size[box[a:b]]
                    point = ragged(np.arange(len(leaves.points)), leaves.first[box[a:b]], size)
                    which = np.repeat(slot[a:b], size)
                    row = rows[some[left[which]]]
                    own = self.own[row]
                    to = leaves.points[point] - self.p[own]
                    far2 = (to * to).sum(axis=1)
                    h = np.einsum("ij,ij->i", to, self.xyz[row]) - far2 / 2.0
                    soft = SOFT * self.span * np.sqrt(far2)
                    close = np.flatnonzero((np.abs(h) <= soft) & (far2 > 0))
                    known = (self.label[self.planes[row[close]]] == point[close][:, None]).any(axis=1)
                    self.hard[own[close[~known]]] = True
                    beyond = np.flatnonzero(h > soft)
                    found.append((row[beyond], point[beyond]))
                    hit[which[beyond]] = True
                done[left] += take
                over = ~hit & (done[left] >= count[left])
                none.append(rows[some[left[over]]])
                left = left[~hit & ~over]
                width *= 8
        row, point = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        return row, point, np.concatenate(none) if none else np.zeros(0, np.int64)


def _slices(sizes: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Ranges of about ``limit`` in all each."""
    total = offsets(sizes)
    cuts = np.unique(np.append(np.searchsorted(total, np.arange(0, int(total[-1]), limit)), len(sizes)))
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


class Faces:
    """The faces of finished cells, one after the other by cell: ``cell``, ``label``, ``area``, the first of its corners and how many; and all corners, in order around each face."""

    def __init__(self, cells: Cells):
        corner, plane = np.repeat(np.arange(len(cells.own)), 3), cells.planes.reshape(-1)
        easy = ~cells.hard[cells.own[corner]]
        corner, plane = corner[easy], plane[easy]
        sides, of = np.unique(plane, return_inverse=True)
        n = len(sides)
        count = np.bincount(of, minlength=n)
        xyz = cells.xyz[corner]
        away = xyz - np.stack([np.bincount(of, xyz[:, k], minlength=n) / count for k in range(3)], axis=1)[of] if n else xyz
        normal = cells.normal[sides] / np.linalg.norm(cells.normal[sides], axis=1)[:, None]
        u = np.cross(normal, np.eye(3)[np.abs(normal).argmin(axis=1)])
        v = np.cross(normal, u)
        angle = np.arctan2(np.einsum("ij,ij->i", away, v[of]), np.einsum("ij,ij->i", away, u[of]))
        order = np.lexsort((angle, of, cells.cell[plane]))
        side = np.lexsort((np.arange(n), cells.cell[sides]))
        sides, count = sides[side], count[side]
        self.cell, self.label, self.count, self.first = cells.cell[sides], cells.label[sides], count, offsets(count)[:-1]
        xyz = xyz[order]
        self.corners = xyz + cells.p[np.repeat(self.cell, count)]
        a = xyz - np.repeat(xyz[self.first], count, axis=0)
        cross = np.zeros_like(a)
        cross[:-1] = np.cross(a[:-1], a[1:])  # 0 at the first and, by the next face's first, at the last corner
        total = np.stack([np.bincount(np.repeat(np.arange(n), count), cross[:, k], minlength=n) for k in range(3)], axis=1)
        self.area = np.linalg.norm(total, axis=1) / 2.0
        self.height = np.abs(np.einsum("ij,ij->i", normal[side], xyz[self.first])) if n else np.zeros(0)


def cells_of(leaves: Leaves, places: np.ndarray, low: np.ndarray, high: np.ndarray) -> Cells:
    """Cells of the points at these places in ``leaves.points``; labels of planes are such places, or below 0 for the box. Cells flagged ``hard`` aren't finished."""
    p = leaves.points[places]
    made = Cells(p, low, high)
    box = p.min(axis=0)[None], p.max(axis=0)[None]
    every = np.arange(len(leaves.first))
    distance = leaves.distance2(*box, every)[0]
    near = np.argpartition(distance, min(48, len(every) - 1))[:48] if len(every) > 48 else every
    point = ragged(np.arange(len(leaves.points)), leaves.first[near], leaves.size[near])
    to = leaves.points[point][None] - p[:, None]
    d2 = (to * to).sum(axis=2)
    d2[d2 == 0] = np.inf
    first = np.argpartition(d2, NEAREST, axis=1)[:, :NEAREST] if len(point) > NEAREST else np.tile(np.arange(len(point)), (len(p), 1))
    cell = np.repeat(np.arange(len(p)), first.shape[1])
    first = first.reshape(-1)
    apart = np.isfinite(d2[cell, first])
    made.cut_all(cell[apart], point[first[apart]], leaves.points)
    for _ in range(ROUNDS):
        rows = np.flatnonzero(made.fresh)
        if not len(rows):
            break
        row, point, final = made.cutters(leaves, rows)
        made.fresh[final] = False
        cell = made.own[row]
        pair = np.unique(cell << 40 | point)
        made.cut_all(pair >> 40, pair & ((1 << 40) - 1), leaves.points)
        easy = ~made.hard[made.own]
        made.own, made.planes, made.xyz, made.fresh = made.own[easy], made.planes[easy], made.xyz[easy], made.fresh[easy]
    made.hard[made.own[made.fresh]] = True
    sides = np.unique(made.planes)  # of one cell each
    made.hard |= np.bincount(made.own, minlength=len(p)) != 2 * np.bincount(made.cell[sides], minlength=len(p)) - 4
    return made
