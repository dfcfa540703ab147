"""Readers and writers: galaxy tables, catalogues of several tables, and resumable batches."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.functions import cosmology, sky
from lacuna.functions.geometry import header_number
from lacuna.operators.grid import XYZ
from lacuna.session import ensure_checkpoints
from lacuna.sources import fits

TEXT_SUFFIXES = (".txt", ".dat", ".ascii", ".tbl")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table by its name's ending: parquet, csv, fits or fit (first table), else white-space separated text under a header that may start with #."""
    name = path.rstrip("/").lower()
    if name.endswith((".h5", ".hdf5")):
        raise ValueError("HDF5 needs a library that isn't here; convert the table to Parquet")
    if name.endswith((".fits", ".fit")):
        return fits.read(spark, path)
    if name.endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=True)
    if name.endswith(TEXT_SUFFIXES):
        return read_text_table(spark, path)
    return spark.read.parquet(path)


def read_text_table(spark: SparkSession, path: str) -> DataFrame:
    """Numbers in columns of white-space separated text; the first line names them."""
    lines = spark.read.text(path)
    head = lines.first()
    names = (head["value"] if head else "").lstrip("#").split()
    clean = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    body = lines.filter((F.trim("value") != "") & ~F.col("value").startswith("#") & (F.col("value") != F.lit(head["value"] if head else "")))
    return body.select(*(F.try_element_at(clean, F.lit(k + 1)).try_cast("double").alias(n) for k, n in enumerate(names)))


def preprocess(galaxies: DataFrame, names: dict[str, str] | None = None, dist_metric: str = "comoving", min_z: float | None = None, max_z: float | None = None, omega_m: float = 0.3, h: float = 1.0) -> tuple[DataFrame, dict]:
    """Columns renamed to ra, dec, redshift, rabsmag (``names``: from those to the table's), Rgal added where missing, and limits in redshift and distance (the data's where not given)."""
    for canonical, own in (names or {}).items():
        if own != canonical:
            galaxies = galaxies.withColumnRenamed(own, canonical)
    if min_z is None or max_z is None:
        row = galaxies.agg(F.min("redshift").alias("a"), F.max("redshift").alias("b")).first()
        min_z, max_z = (row["a"] if min_z is None else min_z), (row["b"] if max_z is None else max_z)
    if "Rgal" not in galaxies.columns and dist_metric == "comoving":
        galaxies = galaxies.withColumn("Rgal", cosmology.comoving_distance(F.col("redshift"), omega_m, h))
    if dist_metric == "comoving":
        low, high = (float(d) for d in cosmology.distances([min_z or 0.0, max_z or 0.0], omega_m, h))
    else:
        low, high = (cosmology.C_SPHERES * z / (100.0 * h) for z in (min_z or 0.0, max_z or 0.0))
    return galaxies, {"ZLIML": min_z, "ZLIMU": max_z, "DLIML": low, "DLIMU": high, "OMEGAM": omega_m, "HP": h, "METRIC": dist_metric}


@dataclass
class Catalog:
    """Named tables with header values, kept as a folder of Parquet tables and a JSON file."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    info: dict = field(default_factory=dict)
    columns: dict[str, list[str]] = field(default_factory=dict)  # column names as they are stored

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name.lower()]

    def update(self, spark: SparkSession, path: str) -> None:
        """Add tables and header values to the catalogue at ``path``, or start one there; tables of the same name are replaced, the others stay."""
        if not exists(spark, f"{path}/header"):
            self.save(path, spark)
            return
        head = json.loads(spark.read.text(f"{path}/header").first()["value"])
        for name, table in self.tables.items():
            table.write.mode("overwrite").parquet(f"{path}/{name.lower()}")
        self._head(spark, path, sorted({*head["tables"], *(n.lower() for n in self.tables)}), head["info"] | self._values())

    def _values(self) -> dict:
        return {k: header_number(v) if isinstance(v, float) else v for k, v in self.info.items()}

    @staticmethod
    def _head(spark: SparkSession, path: str, names: list[str], info: dict) -> None:
        spark.createDataFrame([(json.dumps({"tables": names, "info": info}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")

    def save(self, path: str, spark: SparkSession | None = None) -> None:
        spark = spark or next(iter(self.tables.values())).sparkSession
        for name, table in self.tables.items():
            stored = self.columns.get(name.lower())
            (table.toDF(*stored) if stored and [c.lower() for c in stored] == table.columns else table).write.mode("overwrite").parquet(f"{path}/{name.lower()}")
        self._head(spark, path, sorted(n.lower() for n in self.tables), self._values())

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Catalog:
        """Column names in lower case; those that are stored are kept, and :meth:`save` writes them back."""
        head = json.loads(spark.read.text(f"{path}/header").first()["value"])
        tables, columns = {}, {}
        for name in head["tables"]:
            table = spark.read.parquet(f"{path}/{name}")
            columns[name] = table.columns
            tables[name] = table.toDF(*(c.lower() for c in table.columns))
        return cls(tables, head["info"], columns)

    def add_galaxies(self, galaxies: DataFrame, order: list[str], names: dict[str, str] | None = None, flags: DataFrame | None = None, omega_m: float = 0.3, h: float = 1.0) -> None:
        """Attach galaxies with ``gal`` numbered by the declared order, Rgal and x, y, z where missing, and void flags if given."""
        for canonical, own in (names or {}).items():
            galaxies = galaxies.withColumnRenamed(own, canonical)
        if "gal" not in galaxies.columns:
            galaxies = with_row_numbers(galaxies, "gal", order)
        if "Rgal" not in galaxies.columns and "redshift" in galaxies.columns:
            galaxies = galaxies.withColumn("Rgal", cosmology.comoving_distance(F.col("redshift"), omega_m, h))
        if not set(XYZ) <= set(galaxies.columns):
            galaxies = galaxies.withColumns(dict(zip(XYZ, sky.to_xyz(F.col("ra"), F.col("dec"), F.col("Rgal")), strict=True)))
        self.tables["galaxies"] = galaxies if flags is None else galaxies.join(flags, "gal")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark has written a table at ``path`` to its end."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def kept_stage(spark: SparkSession, folder: str | None, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` of a run's folder: read if an earlier run wrote it, else made and written. Without a folder it is checkpointed."""
    if folder is None:
        ensure_checkpoints(spark)
        return make().checkpoint()
    path = f"{folder}/{name}"
    if not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def with_row_numbers(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Rows numbered from 0 in the order of the columns, without bringing them to one task: counts of ranges, then places within them."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    ensure_checkpoints(df.sparkSession)
    ranged = ranged.checkpoint()
    counts = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    base = counts.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__p").orderBy(*order)
    placed = ranged.withColumn("__k", F.row_number().over(within) - 1).join(F.broadcast(base), "__p")
    return placed.withColumn(name, (F.col("__base") + F.col("__k")).cast("long")).select(*df.columns, name)


def stack(catalogs: dict[str, DataFrame]) -> DataFrame:
    """Tables of several catalogues under each other, with their names in ``catalog``."""
    parts = [t.withColumn("catalog", F.lit(n)) for n, t in catalogs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def in_batches(work: DataFrame, id_col: str, batch: str, path: str, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results of ``run`` on the batches of ``work`` (column ``batch``) that ``path`` doesn't hold yet, appended to it; returns all. A run that was broken off goes on where it stopped."""
    spark = work.sparkSession
    batches = [r[0] for r in work.select(batch).distinct().orderBy(batch).collect()]
    for b in batches:
        done = f"{path}/{batch}={b}"
        if not exists(spark, done):
            run(work.filter(F.col(batch) == F.lit(b))).write.mode("overwrite").parquet(done)
    return spark.read.option("basePath", path).parquet(path)


def save_spheres_text(spheres: DataFrame, path: str) -> None:
    spheres.select(*XYZ, "radius").write.mode("overwrite").option("sep", " ").option("header", True).csv(path)
