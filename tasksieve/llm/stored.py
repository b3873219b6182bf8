"""Intermediate tables that outlive lost executors, and Arrow batches of bounded size."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

PIECE_BYTES = 1 << 18
_ARROW = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "250",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder of ``spark.checkpoint.dir``, or of the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(rows: DataFrame, name: str = "step") -> DataFrame:
    """The rows written as Parquet to the shared folder and read back: computed once, lineage cut, safe when executors go."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def small_batches(spark: SparkSession) -> SparkSession:
    """Arrow batches are held to 250 rows and 4 MB, or one row, wherever the user has not chosen a size."""
    given = spark.sparkContext.getConf()
    for key, value in _ARROW.items():
        if not given.contains(key):
            spark.conf.set(key, value)
    return spark


def tidy(run: Callable) -> Callable:
    """The same Arrow function; when its task ends, the worker, which waits for the next one, gives unused memory back to the system."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return tidied


def as_binary(column: pa.ChunkedArray | pa.Array) -> pa.LargeBinaryArray:
    """Texts as one array of bytes; nulls stay."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.cast(pa.large_binary()) if not pa.types.is_string(whole.type) else whole.cast(pa.binary()).cast(pa.large_binary())


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes in ``column``, or one row."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for i, n in enumerate(lengths):
        if i > start and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += int(n)
    if start < len(lengths):
        yield batch.slice(start)
