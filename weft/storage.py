"""Where intermediate tables live.

Executors come and go, so lineage is cut only with tables written to the
folder that all of them share (``spark.checkpoint.dir``). The setting is read
from the session; a temporary folder is used only where it is unset and the
master is local (tests).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; set to a new one only if unset."""
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not found:
        found = spark.sparkContext.getCheckpointDir() or ""
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weft-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/weft/{name}-{uuid.uuid4().hex}"


#: Rows of a batch to a Python worker while a table is written; texts and sketches are wide.
BATCH_ROWS = 1000


@contextmanager
def small_arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Batches to Python workers hold at most so many rows in here; the session's setting comes back after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and return the written table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with small_arrow_batches(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._weft_path = path
    return table


def written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def discard(df: DataFrame | None) -> None:
    """Delete a table of ``materialise`` that nothing reads any more."""
    path = getattr(df, "_weft_path", None)
    if path:
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
