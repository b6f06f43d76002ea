"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.sql.sources.partitionOverwriteMode": "dynamic"}


def session(master: str | None = None, **more: str) -> SparkSession:
    """A session with the engine's defaults.  On a cluster leave ``master`` to the submit command."""
    builder = SparkSession.builder.appName("quillgraph").config(map=DEFAULTS | more)
    return (builder.master(master) if master else builder).getOrCreate()


#: Bytes of an Arrow batch for Python, where the session doesn't say.
BATCH, _BATCH_CONF = 1 << 21, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on the session's tasks hand rows to Python in Arrow batches of about ``BATCH`` bytes, unless the session sets
    a size of its own.  Spark's default, 10,000 rows or 64 MB, is a whole partition of texts: a task would hold it as
    Arrow buffers outside of the heap, and its Python worker once more."""
    if spark.conf.get(_BATCH_CONF, None) is None:
        spark.conf.set(_BATCH_CONF, BATCH)
