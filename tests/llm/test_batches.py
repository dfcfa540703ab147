import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lacuna.llm import scratch
from lacuna.llm import textbytes as tb


def _sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"n": [batch.nbytes]})


@pytest.fixture
def setting(spark):
    before = spark.conf.get(scratch.BATCH_SETTING)
    yield scratch.BATCH_SETTING
    spark.conf.set(scratch.BATCH_SETTING, before)


@pytest.mark.parametrize("own, most", [("64m", 5 << 20), ("1m", 2 << 20)])
def test_python_gets_a_few_megabytes_at_a_time(spark, setting, own, most):
    """A task of 16 MB of text; a smaller size that the session names stays."""
    spark.conf.set(setting, own)
    rows = spark.range(40).select("id", F.repeat(F.lit("ab "), 1 << 17).alias("text")).coalesce(1)
    tb.filter_rows(rows, "text", len)
    sizes = [r["n"] for r in rows.mapInArrow(_sizes, "n long").collect()]
    assert sum(sizes) > 15 << 20 and max(sizes) <= most
