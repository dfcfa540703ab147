"""Zones, links and nested voids of a watershed over cell volumes."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.session import ensure_checkpoints
from lacuna.sources.tables import with_row_numbers

NONE = -1


def parents(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """gal, volume, parent: the largest neighbour if it is larger (ties by least gal), else the point itself. Cells without volume have none."""
    solid = cells.filter("volume > 0").select("gal", "volume")
    side = solid.select(F.col("gal").alias("dst"), F.col("volume").alias("dv"))
    near = edges.select("src", "dst").join(side, "dst").groupBy(F.col("src").alias("gal")).agg(F.max(F.struct(F.col("dv").alias("v"), (-F.col("dst")).alias("g"))).alias("best"))
    joined = solid.join(near, "gal", "left")
    higher = F.struct(F.col("best.v").alias("v"), F.col("best.g").alias("g")) > F.struct(F.col("volume").alias("v"), (-F.col("gal")).alias("g"))
    return joined.select("gal", "volume", F.when(F.col("best").isNotNull() & higher, -F.col("best.g")).otherwise(F.col("gal")).alias("parent"))


def basins(parent: DataFrame) -> DataFrame:
    """gal, volume, core, depth: the end of the chain of parents, and its length, by pointer jumping (rounds grow with the logarithm of the longest chain)."""
    ensure_checkpoints(parent.sparkSession)
    at = parent.select("gal", "volume", F.col("parent").alias("core"), (F.col("gal") != F.col("parent")).cast("long").alias("depth")).checkpoint()
    while True:
        up = at.select(F.col("gal").alias("core"), F.col("core").alias("next"), F.col("depth").alias("more"))
        jumped = at.join(up, "core").select("gal", "volume", F.col("next").alias("core"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("core") != F.col("next")).alias("moved")).checkpoint()
        at = jumped.drop("moved")
        if not jumped.agg(F.coalesce(F.bool_or("moved"), F.lit(False))).first()[0]:
            return at


def zones(cells: DataFrame, edges: DataFrame, hzn: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Members (gal, zone, depth, volume) and zones (zone, core, zvol, zhzn, cells), numbered from 0 by falling core volume. Cells without volume have zone -1, depth 0."""
    found = basins(parents(cells, edges))
    cores = found.filter("gal = core").select("core", F.col("volume").alias("zvol"))
    numbered = with_row_numbers(cores.withColumn("fall", -F.col("zvol")), "zone", ["fall", "core"]).drop("fall")
    members = found.join(numbered.select("core", "zone"), "core").select("gal", "zone", "depth", "volume")
    flat = cells.filter("volume <= 0").select("gal", F.lit(NONE).cast("long").alias("zone"), F.lit(0).cast("long").alias("depth"), "volume")
    members = members.unionByName(flat).checkpoint()
    flags = members if hzn is None else members.join(hzn, "gal")
    edge = F.lit(0).cast("long") if hzn is None else F.count_if("hzn")
    attributes = flags.filter("zone >= 0").groupBy("zone").agg(edge.alias("zhzn"), F.count("*").alias("cells"))
    return members, numbered.join(attributes, "zone").select("zone", "core", "zvol", "zhzn", "cells").checkpoint()


def zone_links(members: DataFrame, edges: DataFrame) -> DataFrame:
    """z1, z2, link: for each pair of touching zones the greatest, over their border cells, of the smaller volume; both ways round."""
    a = members.filter("zone >= 0").select(F.col("gal").alias("src"), F.col("zone").alias("z1"), F.col("volume").alias("v1"))
    b = members.filter("zone >= 0").select(F.col("gal").alias("dst"), F.col("zone").alias("z2"), F.col("volume").alias("v2"))
    pairs = edges.select("src", "dst").join(a, "src").join(b, "dst").filter("z1 <> z2")
    both = pairs.select("z1", "z2", F.least("v1", "v2").alias("v")).unionByName(pairs.select(F.col("z2").alias("z1"), F.col("z1").alias("z2"), F.least("v1", "v2").alias("v")))
    return both.groupBy("z1", "z2").agg(F.max("v").alias("link"))


def zone_areas(members: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """zone, total, edge areas of zones' surfaces (edge: against cells without volume), and z1, z2, area shared by pairs."""
    a = members.select(F.col("gal").alias("src"), F.col("zone").alias("z1"))
    b = members.select(F.col("gal").alias("dst"), F.col("zone").alias("z2"))
    faces = edges.join(a, "src").join(b, "dst").filter("z1 >= 0 and z1 <> z2")
    total = faces.groupBy(F.col("z1").alias("zone")).agg(F.sum("area").alias("total_area"), F.sum(F.when(F.col("z2") < 0, F.col("area")).otherwise(0.0)).alias("edge_area"))
    return total, faces.filter("z2 >= 0").groupBy("z1", "z2").agg(F.sum("area").alias("area"))


class MergeTree:
    """Which set of zones joined which, and at what volume.

    Zones are flooded from the greatest link volume down. When a volume joins several flooded sets, each but the one
    with the largest core is joined to that one: its first zone (the one of its core) becomes a child of the other's at this volume. A set's zones
    are then its first zone and the subtrees of the children, and a zone was last flooded where its branch left the first zone.
    ``order`` lists zones so that a subtree is a range, [start, stop) of its first zone.
    """

    def __init__(self, cores: list[float], links: list[tuple[int, int, float]]):
        n = len(cores)
        self.cores, self.parent, self.level, self.closed = cores, [-1] * n, [0.0] * n, []
        self.children: list[list[int]] = [[] for _ in cores]
        up = list(range(n))

        def first(z: int) -> int:
            while up[z] != z:
                up[z] = up[up[z]]
                z = up[z]
            return z

        ends = sorted(((volume, z) for a, b, volume in links for z in (a, b)), key=lambda x: (-x[0], x[1]))
        at = 0
        while at < len(ends):
            stop = at
            while stop < len(ends) and ends[stop][0] == ends[at][0]:
                stop += 1
            sets = list(dict.fromkeys(first(z) for _, z in ends[at:stop]))
            top = max(sets, key=lambda z: cores[z])
            for own in sets:
                if cores[own] < cores[top]:
                    up[own] = self.parent[own] = top
                    self.level[own] = ends[at][0]
                    self.children[top].append(own)
                    self.closed.append(own)
            at = stop
        self.roots = [z for z in range(n) if self.parent[z] < 0]
        self.order, self.start, self.stop = [], [0] * n, [0] * n
        stack = [(z, False) for z in reversed(self.roots)]
        while stack:
            z, done = stack.pop()
            if done:
                self.stop[z] = len(self.order)
                continue
            self.start[z] = len(self.order)
            self.order.append(z)
            stack += [(z, True), *((c, False) for c in reversed(self.children[z]))]

    def zones(self, z: int) -> list[int]:
        """The subtree of a zone."""
        return self.order[self.start[z] : self.stop[z]]

    def voids(self) -> Iterator[dict]:
        """Each joined set as it was then, and at the end all that is left."""
        for z in self.closed:
            yield self._void([z], [c for c in self.children[z]], self.level[z], self.cores[z])
        if self.cores:
            yield self._void(self.roots, [c for z in self.roots for c in self.children[z]], 0.0, self.cores[0])

    def _void(self, alone: list[int], joined: list[int], last: float, core: float) -> dict:
        groups: dict[float, list[int]] = defaultdict(list)
        for z in alone:
            groups[self.cores[z]].append(z)
        for z in joined:
            groups[self.level[z]] += self.zones(z)
        levels = sorted(groups, reverse=True)
        return {"groups": [sorted(groups[v]) for v in levels], "overflow": [*levels, last], "mvol": core}


def nested_voids(cores: list[float], links: list[tuple[int, int, float]]) -> list[dict]:
    """Voids as lists of groups of zones, from the zones' core volumes (by zone, falling) and their links.

    A set of zones that a :class:`MergeTree` joins to another is a void whose groups are its zones by the volume at which
    they were last flooded, falling, with those volumes and then the joining one as ``overflow``. At the end what is
    left is one void that never overflows (0). The zone graph is small beside the points: one row a zone and a link.
    """
    return list(MergeTree(cores, links).voids())


def void_hierarchy(zone_table: DataFrame, links: DataFrame) -> list[dict]:
    """:func:`nested_voids` of zone and link tables; collects one row a zone and a link."""
    cores = [r["zvol"] for r in zone_table.orderBy("zone").select("zvol").toLocalIterator()]
    return nested_voids(cores, [(r["z1"], r["z2"], r["link"]) for r in links.filter("z1 < z2").toLocalIterator()])
