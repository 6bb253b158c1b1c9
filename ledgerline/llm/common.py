"""Helpers shared by the training-data operators: scratch tables and Arrow batching."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of text that a Python worker handles at once.
BATCH_BYTES = 3 << 20
_HELD: dict[tuple, object] = {}
_OWN: dict[str, str] = {}


def given_back() -> None:
    """Hands memory that this Python worker no longer uses back to the machine: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # only glibc has it
        pass


def worker_memory(kind: tuple, make: Callable[[], T]) -> T:
    """What this Python worker remembers of one kind, over its tasks; it forgets all of another kind."""
    if kind not in _HELD:
        _HELD.clear()
        given_back()
        _HELD[kind] = make()
    return _HELD[kind]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path below the folder that all executors share; it goes when the application ends.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset, a
    session on one machine gets a temporary folder; on a cluster it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get("root")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _OWN["root"] = tempfile.mkdtemp(prefix="ledgerline-")
    path = f"{root.rstrip('/')}/ledgerline/{label}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # what this query shuffled isn't needed once the table is there
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of written tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles() if "/ledgerline/" in f}:
            where = spark._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts must stay small, as some texts are very long. The session keeps this, or its own smaller number."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    spark.conf.set(name, str(min(now, 256) if now > 0 else 256))


def row_key(text: str = "text") -> Column:
    """Tells rows apart by doc_id and a hash of the text: only two texts under one doc_id could clash."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).cast("string"))


def clear_of(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column is called so in either case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def gathered(batches: Iterable[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.Table]:
    """Arrow batches put together until ``column`` holds about ``limit`` bytes."""
    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.column(b.schema.get_field_index(column)).nbytes
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
    del held
    given_back()


def binary_array(values, offsets) -> pa.Array:
    """Runs of ``values`` between the ``offsets`` as their bytes."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * width).astype("<i4").tobytes()), pa.py_buffer(values.tobytes())])


def ids_crc32(df: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` with ``n_tokens`` and ``ids_crc32``, the checksum of ``ids`` (little-endian unsigned 32-bit integers)."""
    return df.select(*keep, F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def list_array(values, offsets, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
