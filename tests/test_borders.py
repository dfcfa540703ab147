"""Places on the borders of mask cells and distance limits fall on the side that the C library's functions, and so the SQL, give."""

import math

import duckdb
from pyspark.sql import functions as F

from lacuna.operators.mask import Footprint
from lacuna.plans import queries as plans


def test_coords_in_void_on_borders(spark):
    """A hundredth of these galaxies are at whole degrees, some at the near limit; without exact sides two of them count elsewhere."""
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("orders", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = {r["vflag"]: r["n"] for r in plans.QUERIES["coords_in_void"](spark, sf).collect()}
    assert got == dict(con.sql(plans.SQL["coords_in_void"]).fetchall())


def test_cells_of_whole_degrees(spark):
    """The column expression and the kernel, which calls the C library, agree on every border of the finer cells too."""
    n, r = 2, 7.3
    rows = []
    for k in range(720):
        ra, dec = math.radians(k / n), math.radians((k % 357 - 178) / n)
        x, y, z = r * math.cos(ra) * math.cos(dec), r * math.sin(ra) * math.cos(dec), r * math.sin(dec)
        rows += [(len(rows) + i, x, s * y, z) for i, s in enumerate((1.0, 1.0 + 2**-52, 1.0 - 2**-52))]
    rows += [(len(rows) + i, x, y, z) for i, (x, y, z) in enumerate([(1.0, -5e-324, 0.0), (-1.0, 0.0, 0.5), (0.0, 2.0, 1.0), (0.0, 0.0, 3.0), (2.0, -1e-30, 0.1), (0.0, -1.0, 0.0)])]
    cells = spark.range(360 * n * 180 * n).select((F.col("id") % (360 * n)).cast("int").alias("ra_idx"), F.expr(f"cast(id div {360 * n} as int)").alias("dec_idx")).filter("(ra_idx + dec_idx) % 2 = 0")
    own = Footprint("sky", cells, n, 0.0, 100.0)
    inside = own.kernel()
    points = spark.createDataFrame(rows, "gal long, x double, y double, z double")
    got = {r["gal"]: r["inside"] for r in own.flag(points).collect()}
    assert [g for g, *p in rows if got[g] != inside(p)] == []
