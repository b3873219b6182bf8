"""Long texts as overlapping chunks in separate tasks, and the joining of what the chunks found.

Part p of a text covers code points [p * chunk, (p + 1) * chunk + overlap). A chunk's worker names candidate boundaries in its
head (the overlap with the part before) and tail (with the part after); neighbours are spliced at a boundary both name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tasksieve.llm.stored import stored, tidy

_CHUNK = "doc_id bigint, digest string, n_chars bigint, part int, start bigint, text string"


def keyed(documents: DataFrame) -> DataFrame:
    """(doc_id, text), null as empty; further columns are left out."""
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def long_rows(rows: DataFrame, chunk: int) -> DataFrame:
    """Rows of more than ``chunk`` code points with a digest, by which equal rows share their chunks' results."""
    # A code point has one to four bytes: only rows of more bytes than that can be long, and few need counting.
    return rows.where((F.octet_length("text") > chunk) & (F.length("text") > chunk)).select("doc_id", "text", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


def short_rows(rows: DataFrame, chunk: int) -> DataFrame:
    return rows.where((F.octet_length("text") <= chunk) | (F.length("text") <= chunk))


def _columns(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], [n for n, _ in kinds])


_KINDS = [("doc_id", pa.int64()), ("digest", pa.string()), ("n_chars", pa.int64()), ("part", pa.int32()), ("start", pa.int64()), ("text", pa.string())]


def overlapping(rows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(doc_id, digest, n_chars, part, start, text) dealt out over the tasks by document and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, digest in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "digest"))):
                for part in range(max(1, -(-(len(text) - overlap) // chunk))):
                    at = part * chunk
                    yield _columns([(doc_id, digest, len(text), part, at, text[at : at + chunk + overlap])], _KINDS)

    return rows.mapInArrow(tidy(run), _CHUNK).repartition("doc_id", "digest", "part")


def slices(rows: DataFrame) -> DataFrame:
    """(doc_id, digest, n_chars, part, start, text) for rows with ``cuts``, the inner boundaries of the pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, digest, cuts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "digest", "cuts"))):
                for part, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(text)])):
                    yield _columns([(doc_id, digest, len(text), part, a, text[a:b])], _KINDS)

    return rows.select("doc_id", "text", "digest", "cuts").mapInArrow(tidy(run), _CHUNK).repartition("doc_id", "digest", "part")


def widened(rows: DataFrame, overlap: int, attempt: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """Results of ``attempt(rows, overlap)``, which has ``done``; rows not done are tried with twice the overlap again.

    An overlap beyond a text makes it one chunk, so this ends. Results are (doc_id, digest, ...) once per pair.
    """
    results = None
    while True:
        tried = stored(attempt(rows, overlap), "spliced")
        good = tried.where("done").drop("done")
        results = good if results is None else results.unionByName(good)
        failed = tried.where("NOT done").select("doc_id", "digest")
        if not failed.head(1):
            return results
        rows = rows.join(failed, (rows["doc_id"].eqNullSafe(failed["doc_id"])) & (rows["digest"] == failed["digest"]), "left_semi")
        overlap *= 2
