"""Helpers shared by the operators: reading tables, row keys, sizes, pieces of Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.session import prepare, scratch_path

BATCH_ROWS = 1000
PIECE_BYTES = 1 << 19


_shipped: set[str] = set()


def _ship_code(spark: SparkSession) -> None:
    """Send this package's source to the workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = Path(__file__).resolve().parent.parent
    handle, name = tempfile.mkstemp(prefix=f"{package.name}-", suffix=".zip")
    with os.fdopen(handle, "wb") as file, zipfile.ZipFile(file, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, str(source.relative_to(package.parent)))
    context.addPyFile(name)


def tuned(spark: SparkSession) -> SparkSession:
    """The session with small Arrow batches, so that a batch of long texts fits a worker."""
    prepare(spark)
    _ship_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def vectorized(kind: str):
    """Make a function over Arrow arrays a column function of this type.

    The type is parsed on use, since workers import these modules without a session. The optimizer
    must not copy the call into filters it infers or pushes down, which would do the work twice;
    calling it nondeterministic, though it is not, says so.
    """
    def wrap(function):
        def column(*columns):
            return F.arrow_udf(function, returnType=kind).asNondeterministic()(*columns)

        return column

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: recovery starts there."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*parts).parquet(path) if parts else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(table: DataFrame) -> None:
    """Delete a table of `written` that nothing reads any more, and let Spark drop shuffles nobody holds."""
    spark = table.sparkSession
    for path in {os.path.dirname(file) for file in table.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    gc.collect()
    spark._jvm.System.gc()


def row_key(id_col: str, text_col: str) -> list[Column]:
    """128 bits that name a row by its id and text, NULLs included. Equal rows share a key."""
    return [F.xxhash64(F.col(id_col)).alias("ka"), F.xxhash64(F.col(text_col)).alias("kb")]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column laid end to end and the borders of its rows; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, borders, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    ends = np.frombuffer(borders, np.int64)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0]:ends[-1]], ends - ends[0]


def pieces(column: pa.Array, limit: int = PIECE_BYTES):
    """Slices of a string column of about `limit` bytes; one longer text is a slice of its own.

    Yields bytes and borders as `utf8` does. The scratch memory of a task follows the slice.
    """
    data, ends = utf8(column)
    begin, rows = 0, len(ends) - 1
    while begin < rows:
        stop = int(np.searchsorted(ends, ends[begin] + limit, "right")) - 1
        stop = min(max(stop, begin + 1), rows)
        yield data[ends[begin]:ends[stop]], ends[begin:stop + 1] - ends[begin]
        begin = stop
    give_back()


@cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def give_back() -> None:
    """Return freed memory to the system: workers live on and share the executor's memory."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (finalizer of SplitMix64)."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random_words(n: int, seed: int) -> np.ndarray:
    """`n` fixed random odd 64-bit numbers."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                 + np.uint64(seed)) | np.uint64(1)


def per_row(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of `flags` between consecutive borders."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[ends[1:]] - total[ends[:-1]]


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column with `counts[i]` consecutive `values` in row i."""
    borders = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(borders), pa.array(values, kind))
