"""Materialised tables and Arrow plumbing of the corpus operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fileloom.operators import staging
from fileloom.operators.staging import unused

#: Labels are learned only from documents whose crc32(doc_id as text) leaves a remainder by this number.
FOLDS = 5

_written: list[str] = []


_tables: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    path = staging.new_path(spark, name)
    _written.append(path)
    return path


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage and survives the loss of executors; what a task of a failed attempt wrote is never read, as
    Spark's committer publishes only whole tasks.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _tables[found] = path
    return found


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop(*tables: DataFrame) -> None:
    """Delete materialised tables that no result still reads, so a long session doesn't fill the shared disk.

    Only for tables whose readers have been materialised in their turn: those no longer need them, whatever executor is lost.
    """
    for table in tables:
        path = _tables.pop(table, None)
        if path is not None:
            _written.remove(path)
            _delete(table.sparkSession, path)


def discard(spark: SparkSession) -> None:
    """Delete every table that this process wrote in the shared folder. Results that still read them break."""
    while _written:
        _delete(spark, _written.pop())


@atexit.register
def _at_exit() -> None:
    session = SparkSession.getActiveSession()
    if session is not None and session.sparkContext._jsc is not None:
        try:
            discard(session)
        except Exception:  # the JVM may be gone already
            _written.clear()


#: Up to so many rows of keys, a few tens of bytes each, are broadcast; more go through a shuffle join.
BROADCAST_ROWS = 500_000


def small_side(df: DataFrame, name: str) -> DataFrame:
    """A table of keys, written and counted, and marked for broadcast only if it is small."""
    keys = materialize(df, name)
    if keys.count() > BROADCAST_ROWS:
        return keys
    marked = F.broadcast(keys)
    _tables[marked] = _tables[keys]
    return marked


def partitions(spark: SparkSession) -> int:
    """Number of partitions to deal rows to: the session's, so a cluster sets it by its input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of an Arrow batch in the registered queries and the pipeline.
BATCH_BYTES = "4m"


def bound_batches(spark: SparkSession) -> None:
    """Let the session send Arrow batches of at most about ``BATCH_BYTES``.

    A batch stands several times in memory, outside the JVM's heap and in the worker; Spark's own bound is 64 MB. Queries call this,
    operators leave the session as it is.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, size: str = BATCH_BYTES) -> Iterator[None]:
    """What is planned and run inside sends Arrow batches of at most about ``size``: for rows that hold whole sets."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cells(column: pa.Array) -> Callable[[int], memoryview]:
    """The values of a binary column by row, without copies."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = memoryview(column.buffers()[2] or b"")
    return lambda i: data[offsets[i] : offsets[i + 1]]


def among_equals() -> Column:
    """A last sort key for range shuffles, so that equal rows, of which any order is right, are dealt to several ranges."""
    return F.monotonically_increasing_id().alias("tie")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for documents of the held-out fold; a null id counts as the empty text, which is held out."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


#: Caches that a Python worker keeps between tasks, and how to empty them.
CACHES: list[Callable[[], None]] = []


def release_memory() -> None:
    """Empty what this worker keeps for other operators, and give freed memory back to the system.

    Workers outlive queries; an operator that needs much memory starts its tasks with this.
    """
    for empty in CACHES:
        empty()
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes of text; a longer text has a range of its own."""
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi
        lo = hi


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column as Arrow strings with 32-bit offsets; nulls stay null."""
    column = batch.column(batch.schema.get_field_index(name))
    return column if pa.types.is_string(column.type) else column.cast(pa.string())


def batch_slices(batches: Iterator[pa.RecordBatch], name: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of bounded text, so a kernel's arrays stay small."""
    for batch in batches:
        column = text_column(batch, name)
        for lo, hi in slices(column, limit):
            yield batch.slice(lo, hi - lo)
