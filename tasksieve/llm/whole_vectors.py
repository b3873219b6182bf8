"""Vectors of scaled whole numbers: reading, a compact canonical form, and decoding by batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tasksieve.llm.stored import small_batches

#: Scaled entries must be smaller than this in magnitude; doubles hold all whole numbers below it.
LARGEST = 2.0**53
_WIDTHS = (np.dtype("<i2"), np.dtype("<i4"), np.dtype("<i8"))


def packed(vector: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of 2, 4 and 8 bytes that holds all of them, so equal vectors have equal bytes."""
    low, high = (int(vector.min()), int(vector.max())) if len(vector) else (0, 0)
    kind = next(k for k in _WIDTHS if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return bytes([kind.itemsize]) + vector.astype(kind).tobytes()


def unpacked(payloads: list[bytes], dim: int) -> np.ndarray:
    """One row of int64 for each payload; all of them hold ``dim`` numbers."""
    out = np.empty((len(payloads), dim), np.int64)
    widths = np.array([p[0] for p in payloads], np.uint8)
    for kind in _WIDTHS:
        at = np.flatnonzero(widths == kind.itemsize)
        if len(at):
            out[at] = np.frombuffer(b"".join(payloads[i][1:] for i in at), kind).reshape(len(at), dim)
    return out


def by_dim(batch: pa.RecordBatch, column: str = "x") -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dim, positions in the batch, int64 matrix) for each length of vectors in the batch."""
    dims, payloads = batch.column("dim").to_numpy(), batch.column(column).to_pylist()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        yield int(dim), at, unpacked([payloads[i] for i in at], int(dim))


def _reader(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
            holes = column.values.is_null().to_numpy(zero_copy_only=False)
            dims, found, keep = [], [], []
            for i, (valid, a, b) in enumerate(zip(column.is_valid().to_pylist(), column.offsets[:-1].to_pylist(), column.offsets[1:].to_pylist())):
                own = flat[a:b]
                if not valid or holes[a:b].any() or not np.isfinite(own).all() or (np.abs(own) >= LARGEST / scale).any():
                    continue
                keep.append(i)
                dims.append(b - a)
                found.append(packed(np.floor(own * scale).astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(keep, pa.int32())), pa.array(dims, pa.int32()), pa.array(found, pa.binary())], ["vec_id", "dim", "x"]
            )

    return run


def whole_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """``(vec_id, dim, x)`` with x = floor(scale * entry) packed, for rows whose vector can be read.

    Left out: vectors that are null, hold a null or non-finite entry, or an entry of 2**53 / scale or more. Other columns
    are not read.
    """
    small_batches(embeddings.sparkSession)
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    return rows.mapInArrow(_reader(scale), "vec_id bigint, dim int, x binary")
