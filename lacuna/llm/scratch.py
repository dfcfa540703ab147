"""Tables written on the way, in the folder that the cluster shares.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it
back, so an intermediate result survives the loss of any executor.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from urllib.parse import unquote, urlparse

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def root(spark: SparkSession) -> str:
    """The shared folder that the session names; a local one only where none is set and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", made := tempfile.mkdtemp(prefix="lacuna-"))
    return made


def small_batches(spark: SparkSession) -> None:
    """Rows go to and from Python in batches of ``BATCH_BYTES`` or what less the session names: a batch is held whole on both sides, and Spark's are of 64 MB."""
    own = spark.conf.get(BATCH_SETTING, None)
    if own is None or spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(own) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/lacuna-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def made_folder(spark: SparkSession, name: str) -> str:
    """A new folder for files that executors write themselves."""
    path = spark._jvm.org.apache.hadoop.fs.Path(new_folder(spark, name))
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    return fs.makeQualified(path).toString()  # a path without scheme is one of the cluster's default file system, here and on the executors


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    parts = urlparse(folder)
    if parts.scheme in ("", "file"):
        return pafs.LocalFileSystem(), unquote(parts.path)
    return pafs.FileSystem.from_uri(folder)


def put(folder: str, name: str, data: bytes) -> None:
    """Writes a file of a :func:`made_folder`, in a task; one that is run again writes the same file."""
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(part := f"{path}/.{name}.{uuid.uuid4().hex}") as out:
        out.write(data)
    fs.move(part, f"{path}/{name}")


def fetch(file: str) -> bytes:
    fs, path = filesystem(file)
    with fs.open_input_file(path) as held:
        return held.read()


def materialise(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the result carries its folder as ``scratch_path``.

    ``by``: a text column whose values get folders of their own (see :func:`parts_of`).
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    _forget(spark)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    _forget(spark)
    return out


def parts_of(table: DataFrame, kind: str) -> DataFrame:
    """The rows of a table written by its column ``kind`` that have this value; they can be released on their own."""
    out = table.filter(F.col("kind") == kind)
    out.scratch_path = f"{table.scratch_path}/kind={kind}"
    return out


def _forget(spark: SparkSession) -> None:
    """Shuffle files of plans that are done go once the driver has collected the plans; a plan that ended just now may wait for the next call."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialise` that no later plan reads."""
    for table in tables:
        remove(table.sparkSession, table.scratch_path)
        _forget(table.sparkSession)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
