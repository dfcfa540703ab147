"""The watershed void finder, end to end: catalogue, tessellation, zones, nested voids, pruning."""

from __future__ import annotations

import configparser
import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions import cosmology, healpix, sky
from lacuna.operators import prune
from lacuna.operators import watershed as ws
from lacuna.operators.grid import XYZ, bounds
from lacuna.operators.mask import Footprint, InsidePixels
from lacuna.operators.neighbors import k_nearest, periodic_images
from lacuna.operators.select import redshift_cut
from lacuna.operators.voronoi import adjacency, horizon, triangles, voronoi
from lacuna.session import ensure_checkpoints
from lacuna.sources.tables import kept_stage


@dataclass
class WatershedConfig:
    h: float = 1.0
    omega_m: float = 0.3
    zmin: float | None = None
    zmax: float | None = None
    maglim: float | None = None
    min_radius: float = 10.0
    nside: int = 32
    redshift_step: float = 5e-5
    xyz: bool = False
    periodic: bool = False
    low: tuple[float, float, float] | None = None
    high: tuple[float, float, float] | None = None
    buffer: float = 0.0

    @classmethod
    def from_ini(cls, path: str) -> WatershedConfig:
        """The sections of the ini file of the command line."""
        p = configparser.ConfigParser(inline_comment_prefixes=("#", ";"))
        with open(path) as f:
            p.read_file(f)
        flat = {k.lower(): v for s in p.sections() for k, v in p[s].items()}

        def number(name, default, kind=float):
            value = flat.get(name, "").strip()
            return default if value in ("", "None") else kind(value)

        h0 = number("h_0", 100.0)
        box = [number(f"{c}{e}", None) for c in XYZ for e in ("min", "max")]
        return cls(h0 / 100.0, number("omega_m", 0.3), number("redshift_min", None), number("redshift_max", None), number("rabsmag_min", None), number("radius_min", 10.0), int(number("nside", 32)), number("redshift_step", 5e-5), low=tuple(box[0::2]) if None not in box else None, high=tuple(box[1::2]) if None not in box else None, buffer=number("buffer", 0.0))


class Watershed:
    """Runs the stages on galaxies: gal and x, y, z (``xyz``) or ra, dec, redshift, and rabsmag if there is a limit.

    ``stages``: a folder that keeps each stage's tables; what it holds already isn't computed again.
    """

    def __init__(self, galaxies: DataFrame, config: WatershedConfig | None = None, stages: str | None = None):
        self.config = config or WatershedConfig()
        spark = galaxies.sparkSession
        ensure_checkpoints(spark)
        stage = functools.partial(kept_stage, spark, stages)
        self.galaxies = stage("catalogue", lambda: self._catalogue(galaxies))
        if not hasattr(self, "footprint"):  # the catalogue was read: its mask is made again, from the galaxies
            self._catalogue(galaxies)
        self.kept = self.galaxies.filter("in_mask").select("gal", *XYZ)
        self.cells = stage("cells", self._tessellate)
        self.edges = stage("edges", lambda: adjacency(self.cells))
        self.hzn = horizon(self.cells, self.edges)
        made = functools.lru_cache(lambda: ws.zones(self.cells, self.edges, self.hzn))
        self.members, self.zones = stage("members", lambda: made()[0]), stage("zones", lambda: made()[1])
        self.links = stage("links", lambda: ws.zone_links(self.members, self.edges))
        self.voids = ws.void_hierarchy(self.zones, self.links)

    def tracers(self) -> DataFrame:
        """gal, nnls: a galaxy that the cells are built on names itself, any other has -1."""
        return self.galaxies.select("gal", F.when(F.col("in_mask"), F.col("gal")).otherwise(-1).alias("nnls"))

    def pictures(self, zonevoid: DataFrame) -> dict[str, DataFrame]:
        """Tables ``triangle`` (void, normal n_x.., corners p1_x.. p3_z of the surfaces of zones in voids) and ``galviz`` (gid, g2v: the largest void of a galaxy's zone, g2v2: that of the nearest other galaxy)."""
        void = zonevoid.select("zone", F.col("void1").alias("void"))
        zone_of = self.members.select("gal", "zone")
        sides = triangles(self.cells).join(zone_of.withColumnRenamed("gal", "src").withColumnRenamed("zone", "z1"), "src").join(zone_of.withColumnRenamed("gal", "dst").withColumnRenamed("zone", "z2"), "dst")
        outer = sides.filter("z1 >= 0 and z1 <> z2").join(void.withColumnRenamed("zone", "z1"), "z1").filter("void <> -1")
        centre = self.kept.select(F.col("gal").alias("src"), *XYZ)
        outer = outer.join(centre, "src")
        u, v = ([F.col(p)[k] - F.col("p1")[k] for k in range(3)] for p in ("p2", "p3"))
        cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
        size = F.sqrt(sum((c * c for c in cross), F.lit(0.0)))
        outward = F.signum(sum((c * (F.col("p1")[k] - F.col(x)) for k, (c, x) in enumerate(zip(cross, XYZ, strict=True))), F.lit(0.0)))
        normal = [F.coalesce(F.try_divide(c * outward, size), F.lit(0.0)).alias(f"n_{x}") for c, x in zip(cross, XYZ, strict=True)]
        triangle = outer.select("void", *normal, *(F.col(p)[k].alias(f"{p}_{x}") for p in ("p1", "p2", "p3") for k, x in enumerate(XYZ)))
        own = self.members.join(void, "zone", "left").select("gal", F.coalesce("void", F.lit(-1).cast("long")).alias("void"))
        other = k_nearest(self.kept, self.kept, 2).filter("gal <> neighbour").groupBy("gal").agg(F.min_by("neighbour", "rank").alias("near"))
        pair = self.kept.select("gal").join(own, "gal", "left").join(other, "gal", "left").join(own.select(F.col("gal").alias("near"), F.col("void").alias("g2v2")), "near", "left")
        return {"triangle": triangle, "galviz": pair.select(F.col("gal").alias("gid"), F.coalesce("void", F.lit(-1)).alias("g2v"), F.coalesce("g2v2", F.lit(-1)).alias("g2v2"))}

    def _catalogue(self, galaxies: DataFrame) -> DataFrame:
        c = self.config
        if c.xyz or c.periodic:
            low, high = (c.low, c.high) if c.low else bounds(galaxies)
            self.footprint = Footprint("box", low=low, high=high)
            flagged = galaxies.select("gal", *XYZ, *(["rabsmag"] if c.maglim is not None else []))
            keep = F.lit(True) if c.maglim is None else F.col("rabsmag") < c.maglim
            return flagged.withColumn("in_mask", keep)
        low = c.zmin if c.zmin is not None else galaxies.agg(F.min("redshift")).first()[0]
        high = c.zmax if c.zmax is not None else galaxies.agg(F.max("redshift")).first()[0]
        r = cosmology.comoving_distance(F.col("redshift"), c.omega_m, c.h, cosmology.C_WATERSHED)
        placed = galaxies.withColumns(dict(zip(XYZ, sky.to_xyz(F.col("ra"), F.col("dec"), r), strict=True)))
        placed = placed.withColumns({"pix": healpix.ang2pix(F.col("ra"), F.col("dec"), c.nside), "cut": (F.col("redshift") > low) & (F.col("redshift") < high)})
        bright = F.col("cut") if c.maglim is None else F.col("cut") & (F.col("rabsmag") < c.maglim)
        self.pixels = redshift_cut(placed, low, high).filter(bright).select("pix").distinct()
        ends = [float(d) for d in cosmology.distances([low, high], c.omega_m, c.h, cosmology.C_WATERSHED)]
        cells = self.pixels
        self.footprint = PixelFootprint(cells, c.nside, *ends)
        flagged = placed.withColumn("kept", bright)
        mask = cells.withColumn("__m", F.lit(True))
        return flagged.join(mask, "pix", "left").select("gal", *XYZ, "ra", "dec", "redshift", (F.coalesce("__m", F.lit(False)) & F.col("kept")).alias("in_mask"))

    def _tessellate(self) -> DataFrame:
        c = self.config
        if c.periodic:
            low, high = (c.low, c.high) if c.low else bounds(self.kept)
            sides = tuple(b - a for a, b in zip(low, high, strict=True))
            moved = self.kept.select("gal", *((F.col(k) - float(a)).alias(k) for k, a in zip(XYZ, low, strict=True)))
            depth = c.buffer or max(sides) / 2.0
            images = periodic_images(moved, sides, depth).filter("image").drop("image")
            box_low, box_high = [-s for s in sides], [2.0 * s for s in sides]
            return voronoi(moved, box_low, box_high, images=images)
        low, high = bounds(self.kept)
        if c.xyz:
            return voronoi(self.kept, self.footprint.low, self.footprint.high, Footprint("box", low=self.footprint.low, high=self.footprint.high))
        pad = max(b - a for a, b in zip(low, high, strict=True)) * 4.0 + 1.0
        return voronoi(self.kept, [a - pad for a in low], [b + pad for b in high], self.footprint)

    def mean_volume(self) -> float:
        return self.cells.filter("volume > 0").agg(F.avg("volume")).first()[0] or 0.0

    def sort_voids(self, method: int | str = 0, minsig: float = 2.0, zone_linking_cut: float = 0.2, central_density_cut: float = 0.2) -> dict[str, DataFrame]:
        """Tables ``voids`` (void, x, y, z, radius, x1..z3, tot_area, edge_area, edge), ``zonevoid`` and ``galzone``."""
        spark = self.cells.sparkSession
        number = prune.method_number(method)
        mean = self.mean_volume()
        cores = [r["zvol"] for r in self.zones.orderBy("zone").select("zvol").collect()]  # a row a zone
        links = {r["z1"]: r["link"] for r in self.links.groupBy("z1").agg(F.max("link").alias("link")).collect()} if number == 3 else {}
        zones_of = prune.void_zones(self.voids, len(cores), number, mean, zone_linking_cut, minsig, cores, links)
        cells = prune.void_members(spark, zones_of, self.members).join(self.kept, "gal").checkpoint()
        found = prune.void_attributes(cells).checkpoint()
        least = found.agg(F.median("radius")).first()[0] or 0.0 if number == 5 else self.config.min_radius
        found = found.filter(F.col("radius") > least)
        if number == 0:
            found = prune.central_density_cut(found, self.kept, mean, central_density_cut)
        found = prune.renumber(found).checkpoint()
        ids = found.select(F.col("old"), F.col("void"))
        cells = cells.withColumnRenamed("void", "old").join(ids, "old").drop("old")
        of = cells.select("void", "zone").distinct().checkpoint()
        total, shared = ws.zone_areas(self.members, self.edges)
        voids = found.drop("old", "void_volume").join(prune.ellipsoids(cells, found), "void").join(prune.void_areas(of, total, shared), "void").join(prune.void_edges(of, self.zones), "void")
        if not (self.config.xyz or self.config.periodic):
            r, ra, dec = sky.to_radec_unsigned(*(F.col(k) for k in XYZ))
            voids = voids.withColumns({"ra": ra, "dec": dec, "redshift": cosmology.redshift_at(r, self.config.omega_m, self.config.h)})
        return {"voids": voids, "zonevoid": prune.zone_voids(self.zones, of), "galzone": prune.galaxy_zones(self.members, self.galaxies.select("gal", *XYZ, "in_mask"))}


class PixelFootprint(Footprint):
    """HEALPix pixels between two distances, both excluded."""

    def __init__(self, pixels: DataFrame, nside: int, rmin: float, rmax: float):
        super().__init__("sky", pixels, nside, rmin, rmax, strict=True)

    def kernel(self) -> InsidePixels:
        """At most 12 nside^2 pixels."""
        return InsidePixels(frozenset(r["pix"] for r in self.cells.toLocalIterator()), self.resolution, self.rmin, self.rmax)

    def flag(self, points: DataFrame, name: str = "inside", coords: tuple[str, str, str] = XYZ) -> DataFrame:
        x, y, z = (F.col(c) for c in coords)
        r, ra, dec = sky.to_radec_unsigned(x, y, z)
        keyed = points.withColumns({"__pix": healpix.ang2pix(ra, dec, self.resolution), "__r": r})
        cells = self.cells.select(F.col("pix").alias("__pix"), F.lit(True).alias("__in"))
        out = keyed.join(F.broadcast(cells) if 12 * self.resolution**2 <= 4_000_000 else cells, "__pix", "left")
        return out.withColumn(name, F.coalesce("__in", F.lit(False)) & (F.col("__r") > self.rmin) & (F.col("__r") < self.rmax)).select(*points.columns, name)
