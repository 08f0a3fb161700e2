"""Shared storage for what must be written once."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from strideq.errors import ConfigError

_own: list[str] = []
#: Bytes of an Arrow batch that Python gets; rows are not cut, so one row may be more.
BATCH = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Meanwhile batches for Python are bounded in bytes: by rows alone, a batch of texts
    takes tens of megabytes, in the executor and in its worker."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or what
    ``setCheckpointDir`` was given. Without either, a local session gets a folder of its
    own; any other is refused, since its machines would not see each other's files."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
        raise ConfigError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="strideq-"))
    return f"file://{_own[0]}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def remove_late(spark: SparkSession, path: str) -> None:
    """Delete a folder when the driver ends; until then a lazy result may read it."""

    def clear() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session is gone; the folder's owner clears it
            pass

    atexit.register(clear)


def written_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet in the shared folder and read again, and where. This cuts
    lineage: a lost executor costs no more than the stage that reads the files. Batches for
    Python are small."""
    spark = df.sparkSession
    path = f"{folder(spark)}/strideq/{uuid.uuid4().hex}-{name}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """The same, with files that go when the driver ends."""
    out, path = written_at(df, name)
    remove_late(df.sparkSession, path)
    return out
