"""Joins of two tables that grow with the data aren't broadcast, however small Spark takes them for."""

from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from lacuna.operators import membership, neighbors
from lacuna.operators.mask import Footprint


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _points(spark, n: int):
    return spark.range(n).select(F.col("id").alias("gal"), *((F.col("id") * k % 97 / 10.0).alias(c) for k, c in ((7, "x"), (13, "y"), (29, "z"))))


def test_no_broadcast_of_growing_tables(spark, monkeypatch):
    plans, real = [], DataFrame.checkpoint

    def checkpoint(self, *args, **options):
        plans.append(_plan(self))
        return real(self, *args, **options)

    monkeypatch.setattr(DataFrame, "checkpoint", checkpoint)
    own = _points(spark, 300)
    found = neighbors.k_nearest(own, own, 1)
    zoned, zonevoid = own.withColumn("zone", F.col("gal") % 5), spark.range(5).select(F.col("id").alias("zone"), F.col("id").alias("void0"), F.col("id").alias("void1"))
    flags = membership.watershed_flags(own, zoned, zonevoid, Footprint("box", low=(1.0,) * 3, high=(9.0,) * 3))
    inside = membership.in_watershed_voids(own.withColumnRenamed("gal", "id"), zoned, zonevoid)
    spheres = own.select(F.col("gal").alias("hole"), "x", "y", "z", F.lit(1.0).alias("radius"))
    assert len(plans) >= 3 and not any("Broadcast" in p for p in plans)
    assert "Broadcast" not in _plan(found) and "Broadcast" not in _plan(neighbors.in_any_sphere(own, spheres))
    assert all(_plan(df).count("BroadcastHashJoin") <= 1 for df in (flags, inside))  # the zones' voids
    assert found.filter("d2 = 0").count() == found.count() == 300
