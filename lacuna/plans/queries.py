"""Queries on galaxy catalogues derived from the driver's tables, with their SQL.

GALAXIES (from orders): gal, ra, dec, Rgal, rabsmag. POINTS (from part) and HOLES (from supplier): places in a box of
side 200 about the origin, holes with a radius. VECTORS (from embeddings): the first three components.
MASK: cells of one degree by a rule. Numbers are rounded to six decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions import cosmology, geometry, healpix, sky
from lacuna.operators import grid, holes, mask, membership, neighbors, prune, select, slices, volume, voronoi, watershed
from lacuna.operators.grid import XYZ
from lacuna.operators.mask import Footprint
from lacuna.plans import catalogs
from lacuna.plans.find_voids import find_voids
from lacuna.plans.watershed import Watershed, WatershedConfig
from lacuna.session import ensure_checkpoints
from lacuna.sources.tables import preprocess, stack, with_row_numbers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

RMIN, RMAX = 5.0, 95.0

GALAXIES = """galaxies AS (SELECT o_orderkey AS gal, (o_orderkey * 7919 % 36000) / 100.0::double AS ra, (o_orderkey * 104729 % 18000) / 100.0::double - 90 AS dec,
 30.0::double + (o_custkey % 970) AS rgal, -17.0::double - (o_totalprice::double % 6) AS rabsmag, (o_orderkey % 1000) / 2000.0::double AS redshift FROM orders)"""
_PLACE = "({k} * 7919 % 2000) / 10.0::double - 100 AS x, ({k} * 104729 % 2003) / 10.0::double - 100 AS y, ({k} * 1299709 % 1999) / 10.0::double - 100 AS z"
POINTS = f"points AS (SELECT p_partkey AS gal, {_PLACE.format(k='p_partkey')}, p_retailprice::double AS volume FROM part)"
HOLES = f"holes AS (SELECT s_suppkey AS hole, {_PLACE.format(k='(s_suppkey * 17 + 5)')}, 8.0::double + (s_suppkey * 31 % 150) / 10.0::double AS radius FROM supplier)"
VECTORS = "vectors AS (SELECT vec_id AS gal, embedding[1]::double AS x, embedding[2]::double AS y, embedding[3]::double AS z FROM embeddings)"
CELLS = "cells AS (SELECT i.range AS ra_idx, j.range AS dec_idx FROM range(360) i, range(180) j WHERE (i.range + j.range) % 7 <> 0 AND j.range BETWEEN 20 AND 160)"


def _places(k: Column) -> dict[str, Column]:
    return {"x": (k * 7919 % 2000) / 10.0 - 100, "y": (k * 104729 % 2003) / 10.0 - 100, "z": (k * 1299709 % 1999) / 10.0 - 100}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def galaxies(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return _read(spark, sf_dir, "orders").select(
        k.alias("gal"),
        (k * 7919 % 36000 / 100.0).alias("ra"),
        (k * 104729 % 18000 / 100.0 - 90).alias("dec"),
        (30.0 + F.col("o_custkey") % 970).cast("double").alias("Rgal"),
        (-17.0 - F.col("o_totalprice").cast("double") % 6).alias("rabsmag"),
        (k % 1000 / 2000.0).alias("redshift"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("gal"), *(c.alias(n) for n, c in _places(F.col("p_partkey")).items()), F.col("p_retailprice").cast("double").alias("volume"))


def hole_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return _read(spark, sf_dir, "supplier").select(k.alias("hole"), *(c.alias(n) for n, c in _places(k * 17 + 5).items()), (8.0 + k * 31 % 150 / 10.0).alias("radius"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("gal"), *(e[k].cast("double").alias(c) for k, c in enumerate(XYZ)))


def footprint(spark: SparkSession) -> Footprint:
    cells = spark.range(360 * 180).select(F.expr("cast(id div 180 as int)").alias("ra_idx"), (F.col("id") % 180).cast("int").alias("dec_idx"))
    return Footprint("sky", cells.filter("(ra_idx + dec_idx) % 7 <> 0 and dec_idx between 20 and 160"), 1, RMIN, RMAX)


def _r(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _inside_sql(x: str, y: str, z: str) -> str:
    """Whether the cell of a direction is in the mask, and the distance within the limits."""
    ra = f"(CASE WHEN {x} = 0 THEN CASE WHEN {y} > 0 THEN 90.0 WHEN {y} < 0 THEN -90.0 ELSE 0.0 END ELSE degrees(atan({y} / nullif({x}, 0))) + CASE WHEN {x} < 0 AND {y} <> 0 THEN 180.0 ELSE 0.0 END END)"
    up = f"(CASE WHEN {ra} < 0 THEN {ra} + 360 ELSE {ra} END)"
    r2 = f"({x} * {x} + {y} * {y} + {z} * {z})"
    dec = f"degrees(asin({z} / nullif(sqrt{r2}, 0)))"
    return f"({r2} > 0 AND {r2} >= {RMIN * RMIN} AND {r2} <= {RMAX * RMAX} AND (trunc({up} % 360)::int, (trunc({dec}) + 90)::int) IN (SELECT (ra_idx, dec_idx) FROM cells))"


_D2 = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
_PI = "3.141592653589793::double"
_CAP = "({pi} / 3.0) * {h} * {h} * (3.0 * {r} - {h})"


def _lens_sql(r1: str, r2: str, d: str) -> str:
    h1 = f"(({r2} - {r1} + {d}) * ({r2} + {r1} - {d}) / (2.0 * {d}))"
    h2 = f"(({r1} - {r2} + {d}) * ({r1} + {r2} - {d}) / (2.0 * {d}))"
    small = f"least({r1}, {r2})"
    return f"CASE WHEN {d} >= {r1} + {r2} THEN 0.0 WHEN {d} <= abs({r1} - {r2}) THEN 4.0 * {_PI} / 3.0 * pow({small}, 3) ELSE {_CAP.format(pi=_PI, h=h1, r=r1)} + {_CAP.format(pi=_PI, h=h2, r=r2)} END"


# --- selections and coordinates ----------------------------------------------------------------------------------------------


@query("sky_to_xyz", f"WITH {GALAXIES} SELECT gal, round(rgal * cos(radians(ra)) * cos(radians(dec)), 6) AS x, round(rgal * sin(radians(ra)) * cos(radians(dec)), 6) AS y, round(rgal * sin(radians(dec)), 6) AS z FROM galaxies")
def sky_to_xyz(spark, sf_dir):
    return select.with_xyz(galaxies(spark, sf_dir)).select("gal", *(_r(c).alias(c) for c in XYZ))


@query("xyz_to_sky", f"""WITH {POINTS} SELECT gal, round(sqrt(x*x + y*y + z*z), 6) AS r,
 round(CASE WHEN x = 0 THEN CASE WHEN y > 0 THEN 90.0 WHEN y < 0 THEN -90.0 ELSE 0.0 END ELSE degrees(atan(y / nullif(x, 0))) + CASE WHEN x < 0 THEN 180.0 ELSE 0.0 END END, 6) AS ra,
 round(CASE WHEN x*x + y*y + z*z = 0 THEN 0.0 ELSE degrees(asin(z / nullif(sqrt(x*x + y*y + z*z), 0))) END, 6) AS dec,
 round((CASE WHEN x*x + y*y = 0 THEN 0.0 ELSE degrees(acos(x / nullif(sqrt(x*x + y*y), 0))) * sign(y) END + 360.0) % 360.0, 6) AS ra_unsigned FROM points""")
def xyz_to_sky(spark, sf_dir):
    xyz = [F.col(c) for c in XYZ]
    r, ra, dec = sky.to_radec(*xyz)
    return points(spark, sf_dir).select("gal", _r(r).alias("r"), _r(ra).alias("ra"), _r(dec).alias("dec"), _r(sky.to_radec_unsigned(*xyz)[1]).alias("ra_unsigned"))


@query("mag_dist_filter", f"WITH {GALAXIES} SELECT gal, rgal AS Rgal, round(rabsmag, 6) AS rabsmag FROM galaxies WHERE rabsmag <= -20.09 AND rgal >= 100 AND rgal <= 600")
def mag_dist_filter(spark, sf_dir):
    return select.distance_cut(select.magnitude_cut(galaxies(spark, sf_dir)), 100.0, 600.0).select("gal", "Rgal", _r("rabsmag").alias("rabsmag"))


@query("strict_cuts", f"WITH {GALAXIES} SELECT gal FROM galaxies WHERE rabsmag < -20.09 AND redshift > 0.05 AND redshift < 0.3 AND ra > 10 AND ra < 250 AND dec > -40 AND dec < 60")
def strict_cuts(spark, sf_dir):
    cut = select.redshift_cut(select.magnitude_cut(galaxies(spark, sf_dir), strict=True), 0.05, 0.3)
    return select.box_cut(cut, {"ra": (10.0, 250.0), "dec": (-40.0, 60.0)}).select("gal")


#: Distances by Simpson's rule with 1000 steps, another quadrature than the library's.
_SIMPSON = """dist AS (SELECT z, 2997.92::double * z / 3000.0 * sum(CASE WHEN i IN (0, 1000) THEN 1.0::double WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END / sqrt(0.3::double * pow(1.0::double + z * i / 1000.0, 3) + 0.7::double)) AS d
 FROM (SELECT DISTINCT redshift AS z FROM galaxies), (SELECT range AS i FROM range(1001)) GROUP BY z)"""


@query("comoving_distance", f"WITH {GALAXIES}, {_SIMPSON} SELECT gal, round(d, 5) AS comoving, round(redshift * 299792.0::double / 100.0, 6) AS linear FROM galaxies JOIN dist ON z = redshift")
def comoving_distance(spark, sf_dir):
    z = F.col("redshift")
    return galaxies(spark, sf_dir).select("gal", F.round(cosmology.comoving_distance(z), 5).alias("comoving"), _r(cosmology.redshift_distance(z)).alias("linear"))


@query("redshift_inverse", f"WITH {GALAXIES} SELECT gal, round(redshift, 6) AS redshift FROM galaxies")
def redshift_inverse(spark, sf_dir):
    r = cosmology.comoving_distance(F.col("redshift"), c=cosmology.C_WATERSHED)
    return galaxies(spark, sf_dir).select("gal", _r(cosmology.redshift_at(r)).alias("redshift"))


@query("absolute_magnitude", f"WITH {GALAXIES} SELECT gal, round(17.5 - 5.0 * log10(rgal * 1e6) + 5.0, 6) AS m FROM galaxies")
def absolute_magnitude(spark, sf_dir):
    return galaxies(spark, sf_dir).select("gal", _r(cosmology.absolute_magnitude(F.lit(17.5), F.col("Rgal"))).alias("m"))


@query("preprocess", f"WITH {GALAXIES}, {_SIMPSON} SELECT gal, round(d, 5) AS Rgal, (SELECT min(redshift) FROM galaxies) AS zmin, (SELECT max(redshift) FROM galaxies) AS zmax FROM galaxies JOIN dist ON z = redshift")
def preprocessed(spark, sf_dir):
    own = galaxies(spark, sf_dir).drop("Rgal").withColumnRenamed("redshift", "zed")
    out, info = preprocess(own, {"redshift": "zed"})
    return out.select("gal", F.round("Rgal", 5).alias("Rgal"), F.lit(info["ZLIML"]).alias("zmin"), F.lit(info["ZLIMU"]).alias("zmax"))


@query("row_numbers", f"WITH {GALAXIES} SELECT gal AS id, row_number() OVER (ORDER BY ra, dec, gal) - 1 AS n FROM galaxies")
def row_numbers(spark, sf_dir):
    return with_row_numbers(galaxies(spark, sf_dir).select(F.col("gal").alias("id"), "ra", "dec"), "n", ["ra", "dec", "id"]).select("id", "n")


@query("healpix_pix", "SELECT i.range AS pixel, i.range AS again FROM range(3072) i")
def healpix_pix(spark, sf_dir):
    ra, dec = healpix.pix2ang(F.col("id"), 16)
    return spark.range(healpix.pixel_count(16)).select(F.col("id").alias("pixel"), healpix.ang2pix(ra, dec, 16).alias("again"))


@query("healpix_counts")
def healpix_counts(spark, sf_dir):
    return galaxies(spark, sf_dir).groupBy(healpix.ang2pix(F.col("ra"), F.col("dec"), 16).alias("pixel")).agg(F.count("*").alias("n"))


# --- masks -------------------------------------------------------------------------------------------------------------------

_SKY = f"{GALAXIES}, own AS (SELECT DISTINCT trunc(ra % 360)::int AS ra_idx, (trunc(dec) + 90)::int AS dec_idx FROM galaxies)"


@query("sky_mask", f"WITH {_SKY} SELECT * FROM own")
def sky_mask(spark, sf_dir):
    return mask.sky_mask(galaxies(spark, sf_dir), 1, smooth=False)


@query("mask_smooth", f"""WITH {_SKY}, near AS (SELECT ra_idx + d.i AS ra_idx, dec_idx + d.j AS dec_idx FROM own, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(i, j)),
 added AS (SELECT ra_idx, dec_idx FROM near WHERE ra_idx BETWEEN 1 AND 358 AND dec_idx BETWEEN 1 AND 178 GROUP BY ra_idx, dec_idx HAVING count(*) >= 3)
 SELECT ra_idx, dec_idx FROM own UNION SELECT ra_idx, dec_idx FROM added""")
def mask_smooth(spark, sf_dir):
    return mask.sky_mask(galaxies(spark, sf_dir), 1)


@query("in_mask", f"WITH {CELLS}, {POINTS} SELECT gal, {_inside_sql('x', 'y', 'z')} AS inside FROM points")
def in_mask(spark, sf_dir):
    return footprint(spark).flag(points(spark, sf_dir)).select("gal", "inside")


_OFFSETS = "(VALUES (10.0::double, 0.0::double, 0.0::double), (-10.0, 0.0, 0.0), (0.0, 10.0, 0.0), (0.0, -10.0, 0.0), (0.0, 0.0, 10.0), (0.0, 0.0, -10.0)) o(dx, dy, dz)"
_NEAR = f"moved AS (SELECT gal, x + dx AS x, y + dy AS y, z + dz AS z FROM points, {_OFFSETS}), near AS (SELECT gal, bool_or(NOT {_inside_sql('x', 'y', 'z')}) AS near FROM moved GROUP BY gal)"


@query("edge_point", f"WITH {CELLS}, {POINTS}, {_NEAR} SELECT gal, near FROM near")
def edge_point(spark, sf_dir):
    return footprint(spark).near_edge(points(spark, sf_dir), 10.0, "near").select("gal", "near")


@query("box_mask", f"WITH {POINTS} SELECT gal, x >= -50 AND x <= 50 AND y >= -50 AND y <= 50 AND z >= -50 AND z <= 50 AS inside FROM points")
def box_mask(spark, sf_dir):
    return Footprint("box", low=(-50.0,) * 3, high=(50.0,) * 3).flag(points(spark, sf_dir)).select("gal", "inside")


# --- neighbours --------------------------------------------------------------------------------------------------------------


@query("dup_removal", """WITH p AS (SELECT o_orderkey AS gal, (o_orderkey % 23)::double AS x, (o_custkey % 29)::double AS y, (o_orderkey % 31)::double AS z FROM orders)
 SELECT gal FROM (SELECT gal, count(*) OVER (PARTITION BY x, y, z) AS n FROM p) WHERE n = 1""")
def dup_removal(spark, sf_dir):
    own = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("gal"), (F.col("o_orderkey") % 23).cast("double").alias("x"), (F.col("o_custkey") % 29).cast("double").alias("y"), (F.col("o_orderkey") % 31).cast("double").alias("z"))
    return neighbors.without_duplicates(own).select("gal")


_KNN = f"{VECTORS}, d AS (SELECT a.gal, b.gal AS neighbour, {_D2} AS d2 FROM vectors a, vectors b), k AS (SELECT gal, neighbour, d2, row_number() OVER (PARTITION BY gal ORDER BY d2, neighbour) AS rank FROM d)"


@query("knn", f"WITH {_KNN} SELECT gal, neighbour, rank, round(sqrt(d2), 6) AS dist FROM k WHERE rank <= 4")
def knn(spark, sf_dir):
    own = vectors(spark, sf_dir)
    return neighbors.k_nearest(own, own, 4).select("gal", "neighbour", F.col("rank").cast("long").alias("rank"), _r(F.sqrt("d2")).alias("dist"))


@query("wall_field", f"""WITH {_KNN}, n AS (SELECT gal, sqrt(d2) AS dist FROM k WHERE rank = 4), l AS (SELECT avg(dist) + 1.5 * stddev_pop(dist) AS lim FROM n)
 SELECT gal, round(dist, 6) AS dist, dist < lim AS wall FROM n, l""")
def wall_field(spark, sf_dir):
    return select.wall_field(vectors(spark, sf_dir)).select("gal", _r("dist").alias("dist"), "wall")


@query("radius_join", f"WITH {POINTS}, {HOLES} SELECT a.gal, b.hole, round({_D2}, 6) AS d2 FROM points a, holes b WHERE {_D2} <= 15.0 * 15.0")
def radius_join(spark, sf_dir):
    found = neighbors.pairs_within(points(spark, sf_dir).select("gal", *XYZ), hole_table(spark, sf_dir), 15.0)
    return found.select("gal", F.col("hole_b").alias("hole"), _r("d2").alias("d2"))


@query("point_in_any_hole", f"WITH {POINTS}, {HOLES} SELECT DISTINCT a.gal FROM points a, holes b WHERE {_D2} < b.radius * b.radius")
def point_in_any_hole(spark, sf_dir):
    return neighbors.in_any_sphere(points(spark, sf_dir), hole_table(spark, sf_dir))


@query("nearest_sphere", f"""WITH {POINTS}, {HOLES}, d AS (SELECT a.gal, b.hole, b.radius, {_D2} AS d2 FROM points a, holes b),
 k AS (SELECT *, row_number() OVER (PARTITION BY gal ORDER BY d2, hole) AS n FROM d) SELECT gal, hole, sqrt(d2) < radius AS inside FROM k WHERE n = 1""")
def nearest_sphere(spark, sf_dir):
    return neighbors.nearest_sphere(points(spark, sf_dir), hole_table(spark, sf_dir))


@query("contained_holes", f"WITH {HOLES}, s AS (SELECT hole, x, y, z, CASE WHEN hole % 3 = 0 THEN radius * 4 ELSE radius END AS radius FROM holes) SELECT DISTINCT a.hole FROM s a, s b WHERE a.hole <> b.hole AND sqrt({_D2}) + a.radius <= b.radius AND (a.radius < b.radius OR a.hole > b.hole)")
def contained_holes(spark, sf_dir):
    own = hole_table(spark, sf_dir).withColumn("radius", F.when(F.col("hole") % 3 == 0, F.col("radius") * 4).otherwise(F.col("radius")))
    return neighbors.contained_spheres(own)


@query("periodic_images", f"""WITH {POINTS}, s AS (SELECT a.v::double * 200 AS i, b.v::double * 200 AS j, c.v::double * 200 AS k FROM (VALUES (-1), (0), (1)) a(v), (VALUES (-1), (0), (1)) b(v), (VALUES (-1), (0), (1)) c(v)),
 m AS (SELECT gal, x + 100 + i AS x, y + 100 + j AS y, z + 100 + k AS z, abs(i) + abs(j) + abs(k) > 0 AS image FROM points, s)
 SELECT gal, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, image FROM m WHERE x >= -20 AND x <= 220 AND y >= -20 AND y <= 220 AND z >= -20 AND z <= 220""")
def periodic_images(spark, sf_dir):
    own = points(spark, sf_dir).select("gal", *((F.col(c) + 100.0).alias(c) for c in XYZ))
    return neighbors.periodic_images(own, (200.0,) * 3, 20.0).select("gal", *(_r(c).alias(c) for c in XYZ), "image")


_SHELL = "greatest(abs(x - 100) - 100, abs(y - 100) - 100, abs(z - 100) - 100)"


@query("periodic_shell", f"""WITH {POINTS}, s AS (SELECT a.v::double * 200 AS i, b.v::double * 200 AS j, c.v::double * 200 AS k FROM (VALUES (-1), (0), (1)) a(v), (VALUES (-1), (0), (1)) b(v), (VALUES (-1), (0), (1)) c(v)),
 m AS (SELECT gal, x + 100 + i AS x, y + 100 + j AS y, z + 100 + k AS z FROM points, s WHERE abs(i) + abs(j) + abs(k) > 0) SELECT gal, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM m WHERE {_SHELL} > 15.25 AND {_SHELL} < 30.5""")
def periodic_shell(spark, sf_dir):
    own = points(spark, sf_dir).select("gal", *((F.col(c) + 100.0).alias(c) for c in XYZ))
    return neighbors.periodic_shell(own, (200.0,) * 3, 15.25, 1).select("gal", *(_r(c).alias(c) for c in XYZ))


@query("cone_circles", f"""WITH {HOLES}, p AS (SELECT hole, radius, sqrt(x*x + y*y + z*z) AS r, degrees(asin(z / nullif(sqrt(x*x + y*y + z*z), 0))) AS dec FROM holes), d AS (SELECT *, abs(r * sin(radians(dec - 15.0))) AS d FROM p)
 SELECT hole, round(d, 6) AS distance, round(CASE WHEN d > radius THEN 0.0 ELSE sqrt(greatest(radius * radius - d * d, 0.0)) END, 6) AS circle FROM d""")
def cone_circles(spark, sf_dir):
    return slices.cone_circles(hole_table(spark, sf_dir), 15.0).select("hole", _r("distance").alias("distance"), _r("circle").alias("circle"))


# --- grids, holes ------------------------------------------------------------------------------------------------------------

_GRID = "g AS (SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0, ceil((max(x) - min(x)) / 20.0)::int AS nx, ceil((max(y) - min(y)) / 20.0)::int AS ny, ceil((max(z) - min(z)) / 20.0)::int AS nz FROM points)"
_CELL = ", ".join(f"greatest(least(trunc(({c} - {c}0) / 20.0)::int, n{c} - 1), 0) AS {i}" for c, i in zip("xyz", "ijk", strict=True))
_OCCUPIED = f"{POINTS}, {_GRID}, c AS (SELECT {_CELL} FROM points, g), o AS (SELECT i, j, k, count(*) AS n FROM c GROUP BY i, j, k)"


@query("cell_occupancy", f"WITH {_OCCUPIED} SELECT * FROM o")
def cell_occupancy(spark, sf_dir):
    own = points(spark, sf_dir)
    return grid.occupancy(own, grid.hole_grid(own, 20.0))


@query("empty_cells", f"""WITH {_OCCUPIED} SELECT i, j, k, round(x0 + (i + 0.5) * 20.0, 6) AS x FROM (SELECT a.range AS i, b.range AS j, c.range AS k FROM g, range(1000) a, range(1000) b, range(1000) c WHERE a.range < nx AND b.range < ny AND c.range < nz) cells, g
 WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.i = cells.i AND o.j = cells.j AND o.k = cells.k)""".replace("range(1000)", "range(20)"))
def empty_cells(spark, sf_dir):
    own = points(spark, sf_dir)
    return grid.empty_cells(own, grid.hole_grid(own, 20.0)).select(*(F.col(c).cast("long").alias(c) for c in "ijk"), _r("x").alias("x"))


@query("sphere_overlap", f"WITH {HOLES} SELECT a.hole, b.hole AS other, round({_lens_sql('a.radius', 'b.radius', f'sqrt({_D2})')}, 4) AS lens FROM holes a, holes b WHERE a.hole < b.hole AND sqrt({_D2}) < a.radius + b.radius")
def sphere_overlap(spark, sf_dir):
    own = hole_table(spark, sf_dir)
    largest = own.agg(F.max("radius")).first()[0]
    found = neighbors.overlapping_spheres(own, own, largest).filter("hole < hole_b")
    return found.select("hole", F.col("hole_b").alias("other"), F.round(geometry.lens_volume(F.col("radius"), F.col("radius_b"), F.col("d")), 4).alias("lens"))


_RANKED = f"{HOLES}, r AS (SELECT *, row_number() OVER (ORDER BY radius DESC, x, y, z, hole) AS n FROM holes WHERE radius > 12)"
_RIVALS = f"{_RANKED}, v AS (SELECT a.n, list(b.n) AS rivals FROM r a, r b WHERE b.n < a.n AND sqrt({_D2}) < a.radius + b.radius AND (b.radius - a.radius >= sqrt({_D2}) OR {_lens_sql('a.radius', 'b.radius', f'sqrt({_D2})')} > 0.1 * 4.0 * {_PI} / 3.0 * pow(a.radius, 3)) GROUP BY a.n)"
_GREEDY = f"""{_RIVALS}, s AS (SELECT r.n, v.rivals FROM r LEFT JOIN v ON r.n = v.n),
 w(n, taken) AS (SELECT 0::bigint, []::bigint[] UNION ALL SELECT s.n, CASE WHEN s.rivals IS NOT NULL AND list_has_any(w.taken, s.rivals) THEN w.taken ELSE list_append(w.taken, s.n) END FROM w JOIN s ON s.n = w.n + 1),
 taken AS (SELECT unnest(taken) AS n FROM (SELECT taken FROM w ORDER BY n DESC LIMIT 1)),
 maximals AS (SELECT r.hole, row_number() OVER (ORDER BY r.n) - 1 AS void FROM r JOIN taken ON r.n = taken.n)"""


@query("greedy_maximals", f"WITH RECURSIVE {_GREEDY} SELECT hole, void FROM maximals")
def greedy_maximals(spark, sf_dir):
    ensure_checkpoints(spark)
    return holes.find_maximals(hole_table(spark, sf_dir), 12.0)


@query("hole_assign", f"""WITH RECURSIVE {_GREEDY}, b AS (SELECT m.void, h.* FROM holes h JOIN maximals m ON h.hole = m.hole),
 p AS (SELECT a.hole, b.void, b.radius - a.radius >= sqrt({_D2}) AS contained, {_lens_sql('a.radius', 'b.radius', f'sqrt({_D2})')} > 0.25 * 4.0 * {_PI} / 3.0 * pow(a.radius, 3) AS shared
  FROM holes a, b WHERE a.hole NOT IN (SELECT hole FROM maximals) AND sqrt({_D2}) < a.radius + b.radius),
 q AS (SELECT *, min(CASE WHEN contained THEN void END) OVER (PARTITION BY hole) AS stop FROM p)
 SELECT hole, void FROM maximals UNION ALL SELECT hole, min(void) AS void FROM q WHERE shared AND NOT contained AND (stop IS NULL OR void < stop) GROUP BY hole HAVING count(*) = 1""")
def hole_assign(spark, sf_dir):
    ensure_checkpoints(spark)
    own = hole_table(spark, sf_dir)
    return holes.join_holes(own, holes.find_maximals(own, 12.0), 0.25)


# --- membership, volumes, statistics -------------------------------------------------------------------------------------------

_FLAGS = f"""{CELLS}, {POINTS}, {HOLES}, {_NEAR}, inner_ AS (SELECT DISTINCT a.gal FROM points a, holes b WHERE {_D2} < b.radius * b.radius),
 flags AS (SELECT p.gal, CASE WHEN i.gal IS NOT NULL THEN 1 WHEN NOT {_inside_sql('p.x', 'p.y', 'p.z')} THEN 9 WHEN near.near THEN 2 ELSE 0 END AS vflag FROM points p JOIN near ON near.gal = p.gal LEFT JOIN inner_ i ON i.gal = p.gal)"""


@query("vflag", f"WITH {_FLAGS} SELECT gal, vflag FROM flags")
def vflag(spark, sf_dir):
    return membership.void_flags(points(spark, sf_dir), hole_table(spark, sf_dir), footprint(spark))


@query("vflag_counts", f"WITH {_FLAGS} SELECT vflag, count(*) AS n FROM flags GROUP BY vflag")
def vflag_counts(spark, sf_dir):
    return vflag(spark, sf_dir).groupBy("vflag").agg(F.count("*").alias("n"))


@query("membership", f"""WITH {_FLAGS}, e AS (SELECT p.gal, f.vflag FROM points p JOIN flags f ON f.gal = p.gal JOIN near ON near.gal = p.gal WHERE {_inside_sql('p.x', 'p.y', 'p.z')} AND p.volume > 1000 AND NOT near.near)
 SELECT count(*) FILTER (WHERE vflag = 1) AS n_void, count(*) FILTER (WHERE vflag = 0) AS n_wall FROM e""")
def galaxy_membership(spark, sf_dir):
    own = points(spark, sf_dir)
    r = sky.to_radec(*(F.col(c) for c in XYZ))[0]
    flagged = own.join(vflag(spark, sf_dir), "gal").withColumns({"Rgal": r, "rabsmag": -F.col("volume")})
    return membership.galaxy_membership(flagged, footprint(spark), -1000.0, 10.0)


@query("union_volume_grid", f"""WITH {HOLES}, lim AS (SELECT min(x - radius) AS x0, min(y - radius) AS y0, min(z - radius) AS z0, max(x + radius) AS x1, max(y + radius) AS y1, max(z + radius) AS z1 FROM holes),
 l AS (SELECT x0 + (i.range + 0.5) * 8.0 AS x, y0 + (j.range + 0.5) * 8.0 AS y, z0 + (k.range + 0.5) * 8.0 AS z FROM lim, range(40) i, range(40) j, range(40) k
  WHERE i.range < ceil((x1 - x0) / 8.0 - 0.5) AND j.range < ceil((y1 - y0) / 8.0 - 0.5) AND k.range < ceil((z1 - z0) / 8.0 - 0.5))
 SELECT count(*) * 512.0::double AS volume FROM l a WHERE EXISTS (SELECT 1 FROM holes b WHERE {_D2} < b.radius * b.radius)""")
def union_volume_grid(spark, sf_dir):
    return spark.createDataFrame([(float(volume.union_volume_grid(hole_table(spark, sf_dir), 8.0)),)], "volume double")


@query("overlap_fractions", f"""WITH {HOLES}, l AS (SELECT -60 + (i.range + 0.5) * 6.0::double AS x, -60 + (j.range + 0.5) * 6.0::double AS y, -60 + (k.range + 0.5) * 6.0::double AS z FROM range(20) i, range(20) j, range(20) k),
 f AS (SELECT EXISTS (SELECT 1 FROM holes b WHERE b.hole % 2 = 0 AND {_D2} < b.radius * b.radius) AS p, EXISTS (SELECT 1 FROM holes b WHERE b.hole % 2 = 1 AND {_D2} < b.radius * b.radius) AS q FROM l a),
 c AS (SELECT count(*) AS n, count(*) FILTER (WHERE p AND q) AS "both", count(*) FILTER (WHERE NOT p AND NOT q) AS neither, count(*) FILTER (WHERE p AND NOT q) AS only_a, count(*) FILTER (WHERE NOT p AND q) AS only_b FROM f)
 SELECT n, "both", neither, only_a, only_b, round("both" / n::double, 6) AS both_share, round(neither / n::double, 6) AS neither_share, round(only_a / n::double, 6) AS only_a_share, round(only_b / n::double, 6) AS only_b_share FROM c""")
def overlap_fractions(spark, sf_dir):
    low, high = (-60.0,) * 3, (60.0,) * 3
    lattice = volume.lattice(spark, low, high, 6.0)
    own = hole_table(spark, sf_dir)
    a, b = (membership.in_sphere_voids(lattice, own.filter(f"hole % 2 = {k}")) for k in (0, 1))
    found = membership.overlap(a, b)
    return found.select(*(_r(c).alias(c) if c.endswith("share") else c for c in found.columns))


@query("void_stats", f"""WITH {HOLES}, v AS (SELECT *, hole % 3 AS edge FROM holes) SELECT count(*) AS voids, count(*) FILTER (WHERE edge = 1) AS edge, count(*) FILTER (WHERE edge = 2) AS near_edge, count(*) FILTER (WHERE edge = 0) AS interior,
 round(avg(radius), 6) AS mean, round(stddev_pop(radius) / sqrt(count(*)), 6) AS mean_error, round(median(radius), 6) AS median, round(stddev_pop(radius) / sqrt(count(*)) * sqrt({_PI} / 2), 6) AS median_error, max(radius) AS largest FROM v""")
def void_stats(spark, sf_dir):
    found = membership.void_stats(hole_table(spark, sf_dir).withColumn("edge", F.col("hole") % 3))
    return found.select(*(_r(c).alias(c) if c in ("mean", "mean_error", "median", "median_error") else c for c in found.columns))


@query("stacked_stats", f"""WITH {HOLES}, s AS (SELECT 'ngc' AS catalog, * FROM holes WHERE dec_ UNION ALL SELECT 'sgc', * FROM holes WHERE NOT dec_) SELECT catalog, count(*) AS n, round(avg(radius), 6) AS mean, max(radius) AS largest FROM s GROUP BY catalog""".replace("dec_", "z >= 0"))
def stacked_stats(spark, sf_dir):
    own = hole_table(spark, sf_dir)
    both = stack({"ngc": own.filter("z >= 0"), "sgc": own.filter("not (z >= 0)")})
    return both.groupBy("catalog").agg(F.count("*").alias("n"), _r(F.avg("radius")).alias("mean"), F.max("radius").alias("largest"))


@query("fake_void_probability", f"WITH {HOLES} SELECT hole, round(exp(-5.12 * (radius / 8 - 1) - 0.28 * pow(radius / 8 - 1, 2.8)), 6) AS p FROM holes")
def fake_void_probability(spark, sf_dir):
    return hole_table(spark, sf_dir).select("hole", _r(geometry.fake_void_probability(F.col("radius") / 8)).alias("p"))


@query("slice_circles", f"WITH {HOLES} SELECT hole, round(abs(z - 12.5), 6) AS distance, round(CASE WHEN abs(z - 12.5) > radius THEN 0.0 ELSE sqrt(radius * radius - abs(z - 12.5) * abs(z - 12.5)) END, 6) AS circle FROM holes")
def slice_circles(spark, sf_dir):
    return slices.plane_circles(hole_table(spark, sf_dir), "z", 12.5).select("hole", _r("distance").alias("distance"), _r("circle").alias("circle"))


@query("near_cone", f"WITH {GALAXIES} SELECT gal FROM galaxies WHERE pow(rgal * sin(radians(dec - 20.0)), 2) < 100 AND rabsmag < -19")
def near_cone(spark, sf_dir):
    return slices.near_cone(galaxies(spark, sf_dir), 20.0, 10.0, -19.0).select("gal")


@query("weighted_centre", f"WITH {POINTS} SELECT gal % 10 AS void, round(sum(volume * x) / sum(volume), 6) AS x, round(sum(volume * y) / sum(volume), 6) AS y, round(sum(volume * z) / sum(volume), 6) AS z, round(pow(sum(volume) * (3.0 / (4.0 * {_PI})), 1.0 / 3.0), 6) AS radius FROM points GROUP BY gal % 10")
def weighted_centre(spark, sf_dir):
    own = points(spark, sf_dir).withColumn("void", F.col("gal") % 10)
    return prune.void_attributes(own).select("void", *(_r(c).alias(c) for c in (*XYZ, "radius")))


# --- zones -------------------------------------------------------------------------------------------------------------------


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors with a volume, and the symmetric graph of their four nearest others."""
    own = vectors(spark, sf_dir)
    near = neighbors.k_nearest(own, own, 5).filter("gal <> neighbour").select(F.col("gal").alias("src"), F.col("neighbour").alias("dst"))
    edges = near.unionByName(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    cells = own.select("gal", F.when(F.col("gal") % 17 == 0, 0.0).otherwise((F.col("gal") * 7919 % 1009) / 8.0 + 1.0).alias("volume"))
    ensure_checkpoints(spark)
    return cells.checkpoint(), edges.withColumn("area", F.lit(1.0)).checkpoint()


_EDGES = f"{_KNN}, e0 AS (SELECT gal AS src, neighbour AS dst FROM k WHERE rank <= 5 AND gal <> neighbour), edges AS (SELECT src, dst FROM e0 UNION SELECT dst, src FROM e0), vol AS (SELECT gal, CASE WHEN gal % 17 = 0 THEN 0.0::double ELSE (gal * 7919 % 1009) / 8.0::double + 1.0 END AS volume FROM vectors)"
_PARENT = f"""{_EDGES}, up AS (SELECT e.src, e.dst, v.volume, row_number() OVER (PARTITION BY e.src ORDER BY v.volume DESC, e.dst) AS n FROM edges e JOIN vol v ON v.gal = e.dst AND v.volume > 0),
 parent AS (SELECT s.gal, s.volume, CASE WHEN u.volume > s.volume OR (u.volume = s.volume AND u.dst < s.gal) THEN u.dst ELSE s.gal END AS parent FROM vol s LEFT JOIN up u ON u.src = s.gal AND u.n = 1 WHERE s.volume > 0)"""
_ZONES = f"""{_PARENT}, walk(gal, up, depth) AS (SELECT gal, parent, (gal <> parent)::bigint FROM parent UNION ALL SELECT w.gal, p.parent, w.depth + 1 FROM walk w JOIN parent p ON p.gal = w.up WHERE p.parent <> p.gal),
 ends AS (SELECT gal, max(depth) AS depth FROM walk GROUP BY gal), core AS (SELECT w.gal, w.up AS core, w.depth FROM walk w JOIN ends ON ends.gal = w.gal AND ends.depth = w.depth),
 zone AS (SELECT p.gal AS core, p.volume AS zvol, row_number() OVER (ORDER BY p.volume DESC, p.gal) - 1 AS zone FROM parent p WHERE p.gal = p.parent),
 members AS (SELECT c.gal, z.zone, c.depth, v.volume FROM core c JOIN zone z ON z.core = c.core JOIN vol v ON v.gal = c.gal UNION ALL SELECT gal, -1, 0, volume FROM vol WHERE volume <= 0)"""


@query("zone_parent", f"WITH {_PARENT} SELECT gal, parent FROM parent")
def zone_parent(spark, sf_dir):
    return watershed.parents(*_graph(spark, sf_dir)).select("gal", "parent")


@query("zone_members", f"WITH RECURSIVE {_ZONES} SELECT gal, zone, depth FROM members")
def zone_members(spark, sf_dir):
    return watershed.zones(*_graph(spark, sf_dir))[0].select("gal", "zone", "depth")


@query("zone_links", f"""WITH RECURSIVE {_ZONES}, pairs AS (SELECT a.zone AS z1, b.zone AS z2, least(a.volume, b.volume) AS v FROM edges e JOIN members a ON a.gal = e.src JOIN members b ON b.gal = e.dst WHERE a.zone >= 0 AND b.zone >= 0 AND a.zone <> b.zone)
 SELECT z1, z2, max(v) AS link FROM pairs GROUP BY z1, z2""")
def zone_links(spark, sf_dir):
    cells, edges = _graph(spark, sf_dir)
    return watershed.zone_links(watershed.zones(cells, edges)[0], edges)


@query("zone_void_left_join", f"WITH {POINTS} SELECT p.gal, p.gal % 50 AS zone, coalesce(v.void0, -1) AS void0, coalesce(v.void1, -1) AS void1, v.void0 IS NOT NULL AND v.void0 <> -1 AS in_void FROM points p LEFT JOIN (SELECT s_suppkey AS zone, s_suppkey % 7 AS void0, s_suppkey % 5 AS void1 FROM supplier) v ON v.zone = p.gal % 50")
def zone_void_left_join(spark, sf_dir):
    galzone = points(spark, sf_dir).select("gal", (F.col("gal") % 50).alias("zone"))
    k = F.col("s_suppkey")
    zonevoid = _read(spark, sf_dir, "supplier").select(k.alias("zone"), (k % 7).alias("void0"), (k % 5).alias("void1"))
    return membership.with_void(galzone, zonevoid).select("gal", "zone", "void0", "void1", "in_void")


@query("zone_voids", """WITH of AS (SELECT DISTINCT s_suppkey % 9 AS void, s_suppkey % 40 AS zone FROM supplier), size AS (SELECT void, count(*) AS n FROM of GROUP BY void),
 j AS (SELECT of.zone, of.void, size.n FROM of JOIN size ON size.void = of.void), z AS (SELECT i.range AS zone FROM range(60) i)
 SELECT z.zone, coalesce((SELECT void FROM j WHERE j.zone = z.zone ORDER BY n, void LIMIT 1), -1) AS void0, coalesce((SELECT void FROM j WHERE j.zone = z.zone ORDER BY n DESC, void LIMIT 1), -1) AS void1 FROM z""")
def zone_voids(spark, sf_dir):
    k = F.col("s_suppkey")
    of = _read(spark, sf_dir, "supplier").select((k % 9).alias("void"), (k % 40).alias("zone")).distinct()
    return prune.zone_voids(spark.range(60).withColumnRenamed("id", "zone"), of)


# --- catalogues with their surveys ---------------------------------------------------------------------------------------------

_LATTICE = f"""{CELLS}, {HOLES}, points AS (SELECT (i.range * 20 + j.range) * 20 + k.range AS gal, -60 + i.range * 6.0::double AS x, -60 + j.range * 6.0::double AS y, -60 + k.range * 6.0::double AS z FROM range(20) i, range(20) j, range(20) k), {_NEAR},
 l AS (SELECT p.gal AS id, p.x + 1.5 AS x, p.y + 1.5 AS y, p.z + 1.5 AS z FROM points p JOIN near ON near.gal = p.gal WHERE {_inside_sql('p.x', 'p.y', 'p.z')} AND NOT near.near)"""


def _sphere_catalog(spark: SparkSession, sf_dir: str, which: str = "true") -> catalogs.SphereCatalog:
    own = hole_table(spark, sf_dir).filter(which)
    return catalogs.SphereCatalog(footprint(spark), holes=own, maximals=own.withColumn("edge", F.col("hole") % 3))


def _watershed_catalog(spark: SparkSession, sf_dir: str) -> catalogs.WatershedCatalog:
    own = points(spark, sf_dir)
    galaxies_ = own.withColumns({"Rgal": sky.to_radec(*(F.col(c) for c in XYZ))[0], "rabsmag": -F.col("volume")})
    zonevoid = spark.range(40).select(F.col("id").alias("zone"), F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(-1).alias("void0"), F.lit(-1).cast("long").alias("void1"))
    return catalogs.WatershedCatalog(footprint(spark), galaxies_, galzone=own.select("gal", *XYZ, (F.col("gal") % 50).alias("zone")), zonevoid=zonevoid)


@query("single_overlap", f"""WITH {_LATTICE}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM holes b WHERE {_D2} < b.radius * b.radius)) AS inside FROM l a) SELECT n, inside, round(inside / nullif(n, 0)::double, 6) AS inside_share FROM c""")
def single_overlap(spark, sf_dir):
    found = catalogs.single_overlap(_sphere_catalog(spark, sf_dir), (-60.0,) * 3, (60.0,) * 3, 6.0, 0.25, 10.0, spark)
    return found.withColumn("inside_share", _r("inside_share"))


@query("catalog_overlap", f"""WITH {_LATTICE}, f AS (SELECT EXISTS (SELECT 1 FROM holes b WHERE b.hole % 2 = 0 AND {_D2} < b.radius * b.radius) AS p, EXISTS (SELECT 1 FROM holes b WHERE b.hole % 2 = 1 AND {_D2} < b.radius * b.radius) AS q FROM l a)
 SELECT count(*) AS n, count(*) FILTER (WHERE p AND q) AS "both", count(*) FILTER (WHERE NOT p AND NOT q) AS neither, count(*) FILTER (WHERE p AND NOT q) AS only_a, count(*) FILTER (WHERE NOT p AND q) AS only_b FROM f""")
def catalog_overlap(spark, sf_dir):
    a, b = (_sphere_catalog(spark, sf_dir, f"hole % 2 = {k}") for k in (0, 1))
    return catalogs.overlap(a, b, (-60.0,) * 3, (60.0,) * 3, 6.0, 0.25, 10.0, spark).select("n", "both", "neither", "only_a", "only_b")


@query("combined_overlaps", f"""WITH {HOLES}, l AS (SELECT h.range AS part, -60 + (i.range + 0.5) * 12.0::double AS x, -60 + (j.range + 0.5) * 12.0::double AS y, (h.range * 60 - 60) + (k.range + 0.5) * 12.0::double AS z FROM range(10) i, range(10) j, range(5) k, range(2) h),
 f AS (SELECT EXISTS (SELECT 1 FROM holes b WHERE b.hole % 2 = 0 AND {_D2} < b.radius * b.radius) AS p, EXISTS (SELECT 1 FROM holes b WHERE b.hole % 2 = 1 AND {_D2} < b.radius * b.radius) AS q FROM l a)
 SELECT count(*) AS n, count(*) FILTER (WHERE p AND q) AS "both", count(*) FILTER (WHERE NOT p AND NOT q) AS neither, count(*) FILTER (WHERE p AND NOT q) AS only_a, count(*) FILTER (WHERE NOT p AND q) AS only_b FROM f""")
def combined_overlaps(spark, sf_dir):
    own, parts = hole_table(spark, sf_dir), []
    for low, high in ((-60.0, 0.0), (0.0, 60.0)):
        lattice = volume.lattice(spark, (-60.0, -60.0, low), (60.0, 60.0, high), 12.0)
        parts.append(membership.overlap(*(membership.in_sphere_voids(lattice, own.filter(f"hole % 2 = {k}")) for k in (0, 1))))
    return membership.combine_overlaps(*parts).select("n", "both", "neither", "only_a", "only_b")


@query("coords_in_void", f"""WITH {CELLS}, {GALAXIES}, {HOLES}, points AS (SELECT gal, rgal / 10 * cos(radians(ra)) * cos(radians(dec)) AS x, rgal / 10 * sin(radians(ra)) * cos(radians(dec)) AS y, rgal / 10 * sin(radians(dec)) AS z FROM galaxies), {_NEAR},
 inner_ AS (SELECT DISTINCT a.gal FROM points a, holes b WHERE {_D2} < b.radius * b.radius), v AS (SELECT p.gal, CASE WHEN i.gal IS NOT NULL THEN 1 WHEN NOT {_inside_sql('p.x', 'p.y', 'p.z')} THEN 9 WHEN near.near THEN 2 ELSE 0 END AS vflag FROM points p JOIN near ON near.gal = p.gal LEFT JOIN inner_ i ON i.gal = p.gal)
 SELECT vflag, count(*) AS n FROM v GROUP BY vflag""")
def coords_in_void(spark, sf_dir):
    places = galaxies(spark, sf_dir).select(F.col("gal").alias("id"), "ra", "dec", (F.col("Rgal") / 10).alias("Rgal"))
    return _sphere_catalog(spark, sf_dir).coords_in_void(places).groupBy("vflag").agg(F.count("*").alias("n"))


_WATERSHED_FLAGS = f"""{CELLS}, {POINTS}, {_NEAR}, zv AS (SELECT i.range AS zone, CASE WHEN i.range % 3 = 0 THEN i.range % 7 ELSE -1 END AS void0 FROM range(40) i),
 wf AS (SELECT p.gal, p.volume, near.near, {_inside_sql('p.x', 'p.y', 'p.z')} AS inside, CASE WHEN coalesce(zv.void0, -1) <> -1 THEN 1 WHEN NOT {_inside_sql('p.x', 'p.y', 'p.z')} THEN 9 WHEN near.near THEN 2 ELSE 0 END AS vflag
  FROM points p JOIN near ON near.gal = p.gal LEFT JOIN zv ON zv.zone = p.gal % 50)"""


@query("watershed_flags", f"WITH {_WATERSHED_FLAGS} SELECT gal, vflag FROM wf")
def watershed_flags(spark, sf_dir):
    own = _watershed_catalog(spark, sf_dir)
    return own.flags(own.galaxies).select("gal", "vflag")


@query("watershed_membership", f"WITH {_WATERSHED_FLAGS} SELECT count(*) FILTER (WHERE vflag = 1) AS n_void, count(*) FILTER (WHERE vflag = 0) AS n_wall FROM wf WHERE inside AND NOT near AND volume > 1000")
def watershed_membership(spark, sf_dir):
    return _watershed_catalog(spark, sf_dir).galaxy_membership(-1000.0, 10.0)


@query("in_watershed_voids", f"WITH {_WATERSHED_FLAGS} SELECT gal AS id, vflag = 1 AS in_void FROM wf")
def in_watershed_voids(spark, sf_dir):
    own = _watershed_catalog(spark, sf_dir)
    return own.in_void(own.galaxies.select(F.col("gal").alias("id"), *XYZ))


@query("common_void_galaxies", f"""WITH {CELLS}, {POINTS}, {HOLES}, zv AS (SELECT i.range AS zone FROM range(40) i WHERE i.range % 3 = 0)
 SELECT DISTINCT a.gal FROM points a JOIN zv ON zv.zone = a.gal % 50, holes b WHERE {_D2} < b.radius * b.radius""")
def common_void_galaxies(spark, sf_dir):
    zones_, spheres = _watershed_catalog(spark, sf_dir), _sphere_catalog(spark, sf_dir)
    spheres.galaxies = zones_.galaxies
    return catalogs.common_galaxies(spheres, zones_)


@query("stacked_void_stats", f"WITH {HOLES} SELECT CASE WHEN z >= 0 THEN 'ngc' ELSE 'sgc' END AS catalog, count(*) AS voids, count(*) FILTER (WHERE hole % 3 = 1) AS edge, round(avg(radius), 6) AS mean, round(median(radius), 6) AS median FROM holes GROUP BY 1")
def stacked_void_stats(spark, sf_dir):
    both = catalogs.Stacked({"ngc": _sphere_catalog(spark, sf_dir, "z >= 0"), "sgc": _sphere_catalog(spark, sf_dir, "not (z >= 0)")})
    return both.void_stats().select("catalog", "voids", "edge", _r("mean").alias("mean"), _r("median").alias("median"))


@query("combined_void_stats", f"WITH {HOLES} SELECT count(*) AS voids, count(*) FILTER (WHERE hole % 3 = 2) AS near_edge, round(avg(radius), 6) AS mean, max(radius) AS largest FROM holes")
def combined_void_stats(spark, sf_dir):
    both = catalogs.Stacked({"ngc": _sphere_catalog(spark, sf_dir, "z >= 0"), "sgc": _sphere_catalog(spark, sf_dir, "not (z >= 0)")})
    return both.combined_stats().select("voids", "near_edge", _r("mean").alias("mean"), "largest")


@query("row_difference", "SELECT DISTINCT o_custkey % 97 AS k FROM orders EXCEPT SELECT p_partkey % 90 AS k FROM part")
def row_difference(spark, sf_dir):
    return catalogs.difference(_read(spark, sf_dir, "orders").select((F.col("o_custkey") % 97).alias("k")), _read(spark, sf_dir, "part").select((F.col("p_partkey") % 90).alias("k")))


@query("split_by", f"WITH {GALAXIES} SELECT rabsmag < -20 AS bright, count(*) AS n, round(avg(rgal), 6) AS mean FROM galaxies GROUP BY 1")
def split_by(spark, sf_dir):
    low, rest = select.split_by(galaxies(spark, sf_dir), "rabsmag", -20.0)
    both = low.withColumn("bright", F.lit(True)).unionByName(rest.withColumn("bright", F.lit(False)))
    return both.groupBy("bright").agg(F.count("*").alias("n"), _r(F.avg("Rgal")).alias("mean"))


# --- holes and zones --------------------------------------------------------------------------------------------------------


_DOUBLED = f"{HOLES}, doubled AS (SELECT hole, x, y, z, radius FROM holes UNION ALL SELECT hole + 1000000, x + 0.03, y, z, radius - 0.02 FROM holes WHERE hole % 2 = 0 UNION ALL SELECT hole + 2000000, x, y + 0.3, z, radius FROM holes WHERE hole % 3 = 0)"


@query("hole_dedup", f"""WITH RECURSIVE {_DOUBLED}, o AS (SELECT *, row_number() OVER (ORDER BY radius DESC, x, y, z) AS n FROM doubled),
 fold(n, hole, x, y, z, r, kept) AS (SELECT n, hole, x, y, z, radius, true FROM o WHERE n = 1 UNION ALL
  SELECT o.n, o.hole, CASE WHEN k THEN o.x ELSE f.x END, CASE WHEN k THEN o.y ELSE f.y END, CASE WHEN k THEN o.z ELSE f.z END, CASE WHEN k THEN o.radius ELSE f.r END, k
  FROM fold f JOIN (SELECT * FROM o) o ON o.n = f.n + 1, LATERAL (SELECT sqrt((o.x - f.x) * (o.x - f.x) + (o.y - f.y) * (o.y - f.y) + (o.z - f.z) * (o.z - f.z)) > 0.1 OR f.r - o.radius > 0.1 AS k))
 SELECT hole FROM fold WHERE kept""")
def hole_dedup(spark, sf_dir):
    own = hole_table(spark, sf_dir)
    more = own.filter("hole % 2 = 0").select((F.col("hole") + 1000000).alias("hole"), (F.col("x") + 0.03).alias("x"), "y", "z", (F.col("radius") - 0.02).alias("radius"))
    aside = own.filter("hole % 3 = 0").select((F.col("hole") + 2000000).alias("hole"), "x", (F.col("y") + 0.3).alias("y"), "z", "radius")
    return holes.remove_duplicates(own.unionByName(more).unionByName(aside)).select("hole")


@query("edge_flags", f"""WITH {CELLS}, points AS (SELECT s_suppkey AS gal, {_PLACE.format(k='(s_suppkey * 17 + 5)')} FROM supplier), {_NEAR}
 SELECT gal % 9 AS void, CASE WHEN bool_or(gal % 31 = 0) THEN 1 WHEN bool_or(near.near) THEN 2 ELSE 0 END AS edge FROM near GROUP BY gal % 9""")
def edge_flags(spark, sf_dir):
    own = hole_table(spark, sf_dir).withColumns({"void": F.col("hole") % 9, "boundary": F.col("hole") % 31 == 0})
    return holes.edge_flags(own, footprint(spark), 10.0)


_AREAS = f"""{_ZONES}, faces AS (SELECT a.zone AS z1, b.zone AS z2, 1.0::double AS area FROM edges e JOIN members a ON a.gal = e.src JOIN members b ON b.gal = e.dst WHERE a.zone >= 0 AND a.zone <> b.zone)"""


@query("zone_attributes", f"WITH RECURSIVE {_ZONES} SELECT z.zone, z.core, z.zvol, count(*) AS cells FROM zone z JOIN members m ON m.zone = z.zone GROUP BY z.zone, z.core, z.zvol")
def zone_attributes(spark, sf_dir):
    return watershed.zones(*_graph(spark, sf_dir))[1].select("zone", "core", "zvol", "cells")


@query("zone_areas", f"WITH RECURSIVE {_AREAS} SELECT z1 AS zone, sum(area) AS total_area, sum(CASE WHEN z2 < 0 THEN area ELSE 0 END) AS edge_area FROM faces GROUP BY z1")
def zone_areas(spark, sf_dir):
    cells, edges = _graph(spark, sf_dir)
    return watershed.zone_areas(watershed.zones(cells, edges)[0], edges)[0]


@query("void_areas", f"""WITH RECURSIVE {_AREAS}, of AS (SELECT zone, zone % 5 AS void FROM zone), t AS (SELECT of.void, sum(area) AS t, sum(CASE WHEN z2 < 0 THEN area ELSE 0 END) AS e FROM faces JOIN of ON of.zone = z1 GROUP BY of.void),
 i AS (SELECT a.void, sum(area) AS s FROM faces JOIN of a ON a.zone = z1 JOIN of b ON b.zone = z2 WHERE a.void = b.void GROUP BY a.void)
 SELECT t.void, t.t - coalesce(i.s, 0) AS tot_area, t.e AS edge_area FROM t LEFT JOIN i ON i.void = t.void""")
def void_areas(spark, sf_dir):
    cells, edges = _graph(spark, sf_dir)
    members, zones_ = watershed.zones(cells, edges)
    total, shared = watershed.zone_areas(members, edges)
    of = zones_.select((F.col("zone") % 5).alias("void"), "zone")
    return prune.void_areas(of, total, shared).join(total.join(of, "zone").select("void").distinct(), "void", "left_semi")


@query("void_edges", f"WITH RECURSIVE {_ZONES}, h AS (SELECT zone FROM members m JOIN edges e ON e.src = m.gal JOIN vol v ON v.gal = e.dst AND v.volume = 0 WHERE zone >= 0) SELECT zone % 5 AS void, max((zone IN (SELECT zone FROM h))::int) AS edge FROM zone GROUP BY zone % 5")
def void_edges(spark, sf_dir):
    cells, edges = _graph(spark, sf_dir)
    _, zones_ = watershed.zones(cells, edges, voronoi.horizon(cells, edges))
    return prune.void_edges(zones_.select((F.col("zone") % 5).alias("void"), "zone"), zones_)


@query("galaxy_zones", f"""WITH RECURSIVE {_ZONES} SELECT v.gal, coalesce(m.zone, -1) AS zone, coalesce(m.depth, 0) AS depth, (coalesce(m.volume = 0, false) AND v.gal % 5 <> 0)::int AS edge, (v.gal % 5 = 0)::int AS out
 FROM vectors v LEFT JOIN members m ON m.gal = v.gal""")
def galaxy_zones(spark, sf_dir):
    cells, edges = _graph(spark, sf_dir)
    own = vectors(spark, sf_dir).withColumn("in_mask", F.col("gal") % 5 != 0)
    return prune.galaxy_zones(watershed.zones(cells, edges)[0], own).select("gal", "zone", "depth", "edge", "out")


@query("central_density_cut", f"""WITH {POINTS}, {HOLES}, v AS (SELECT hole AS void, x, y, z, radius, radius * radius * radius * 4.0::double AS vv FROM holes),
 n AS (SELECT b.void, count(*) AS n FROM points a, v b WHERE {_D2} < b.radius * b.radius / 16 GROUP BY b.void)
 SELECT v.void FROM v LEFT JOIN n ON n.void = v.void WHERE 64.0 * coalesce(n.n, 0) / vv < 0.2 / 1000 AND radius > 10""")
def central_density_cut(spark, sf_dir):
    voids = hole_table(spark, sf_dir).withColumnRenamed("hole", "void").withColumn("void_volume", F.col("radius") * F.col("radius") * F.col("radius") * 4.0)
    return prune.central_density_cut(voids, points(spark, sf_dir), 1000.0).select("void")


# --- end to end, without SQL -------------------------------------------------------------------------------------------------


@query("find_voids")
def voids_of_points(spark, sf_dir):
    low, high = (-100.0,) * 3, (101.0,) * 3
    return find_voids(points(spark, sf_dir), Footprint("box", low=low, high=high), hole_grid_edge_length=20.0).maximals


@query("watershed_voids")
def watershed_voids(spark, sf_dir):
    own = vectors(spark, sf_dir)
    return Watershed(own, WatershedConfig(xyz=True, min_radius=0.0, low=(-1.0,) * 3, high=(1.0,) * 3)).sort_voids("VIDE")["voids"]


@query("effective_radii")
def effective_radii(spark, sf_dir):
    return volume.effective_radii(hole_table(spark, sf_dir).withColumn("void", F.col("hole") % 20))
