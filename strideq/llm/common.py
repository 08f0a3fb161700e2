"""What the operators of this subpackage share: tables, shared storage, folds, sizes."""

from __future__ import annotations

import ctypes
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType

from strideq.sources.storage import BATCH, remove, remove_late, small_batches, written_at

__all__ = ["BATCH", "SMALL", "fold", "hint_small", "is_small", "remove", "saved", "small_batches", "table", "trimmed"]

#: Bytes of rows that may be broadcast.
SMALL = 24 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str, keep: bool = True) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it again; also the path.

    ``keep`` leaves the files until the driver ends (a lazy result may read them);
    otherwise the caller removes the path.
    """
    out, path = written_at(df, name)
    if keep:
        remove_late(df.sparkSession, path)
    return out, path


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def _width(c: Column, kind: DataType) -> Column:
    """About the bytes of a value in a broadcast row."""
    if isinstance(kind, StringType | BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, ArrayType):
        inner = 16 if isinstance(kind.elementType, StringType | BinaryType) else 8 * max(1, len(getattr(kind.elementType, "fields", ())))
        return F.greatest(F.size(c), F.lit(0)) * inner + 24
    return F.lit(8 * max(1, len(getattr(kind, "fields", ()))))


def is_small(df: DataFrame, most: int = SMALL) -> bool:
    """Whether the rows of ``df``, a table just written, take at most ``most`` bytes."""
    own = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(32))
    return (df.agg(F.sum(own.cast("long"))).first()[0] or 0) <= most


def hint_small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """``df`` marked for broadcast if its rows take at most ``most`` bytes; else as it is."""
    return F.broadcast(df) if is_small(df, most) else df


@cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def trimmed() -> None:
    """Give memory that a task no longer needs back to the machine: a worker that is used
    again doesn't keep the peak of its last task."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)
