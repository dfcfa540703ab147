"""Session settings that the plans rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def ensure_checkpoints(spark: SparkSession) -> None:
    """A checkpoint folder: the one that the session names; a local one only where none is set and the master is local."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lacuna-"))
