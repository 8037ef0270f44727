"""Helpers that several operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Hashable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The six characters of ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\f\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session that names none gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='strandline-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, grouped by application so that one delete removes all."""
    return f"{shared_dir(spark)}/strandline-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *, by: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(df: DataFrame) -> DataFrame:
    """Hand ``df`` to Python in batches of few MB: whole texts may be long, and each worker holds several copies.

    Sets the session's Arrow batch limits, which Spark reads when it plans the query.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "1m")
    return df


_kept: dict[Hashable, object] = {}


def worker_table(key: Hashable, build: Callable[[], object]):
    """What ``build`` makes, kept in this Python worker until a table of another key is asked for: workers outlive their tasks and the operators that they served."""
    if key not in _kept:
        release_tables()
        _kept[key] = build()
    return _kept[key]


def release_tables() -> None:
    """Forget the kept table and hand free memory back to the system."""
    _kept.clear()
    trim()


def trim() -> None:
    """Hand free memory back: allocators keep what a very long text has taken."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system interface."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a bound variable.

    A plain column used inside a lambda may be inlined by the optimizer and then be
    evaluated per element; a lambda variable never is.
    """
    return F.transform(F.array(value), body)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
