"""Byte-level BPE ids of whole texts and back, huge texts in pieces.

A text of at most ``chunk`` code points is encoded as it is. Longer ones are cut into overlapping chunks, of which only the
zones that neighbours share are pre-tokenised to find boundaries; neighbours are stitched at a pre-token boundary that both found and that no context can change: it lies between a letter
and a character that is none, or between a digit and one that is none, so no pattern match covers both sides, and no white space before it
can look beyond it. The pieces between such boundaries are pre-tokenised and encoded by the library, in parallel, and their ids joined. Where two chunks share no such
boundary, the text is tried again with twice the overlap. Decoding joins the bytes of the ids.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tasksieve.llm.chunks import keyed, long_rows, overlapping, short_rows, slices, widened
from tasksieve.llm.stored import pieces, small_batches, tidy

_IDS = "doc_id bigint, ids array<int>"


@dataclass(frozen=True)
class ByteBpe:
    """path: file of base64 tokens and ranks; pattern: splits a text before the merges."""

    path: str
    pattern: str
    chunk: int = 32_768
    overlap: int = 1024


@functools.lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _letter_or_digit(c: str) -> str:
    return "L" if regex.match(r"\p{L}", c) else "N" if regex.match(r"\p{N}", c) else ""


def stable_boundaries(text: str, pattern: str, low: int, high: int) -> list[int]:
    """Starts in [low, high] of pre-tokens of ``text`` that follow a letter or digit of another kind than their first character."""
    if high <= max(low, 0):
        return []
    found = []
    for match in regex.finditer(pattern, text):
        at = match.start()
        if at > high:
            break
        if at >= max(1, low) and (before := _letter_or_digit(text[at - 1])) and before != _letter_or_digit(text[at]):
            found.append(at)
    return found


def _finder(op: ByteBpe, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for text, start, n in zip(*(batch.column(c).to_pylist() for c in ("text", "start", "n_chars"))):
                # Pre-tokens resynchronise on their own, so each zone is scanned from the middle of its text.
                head, tail = text[: overlap + 1], text[max(0, len(text) - 2 * overlap) :]
                heads.append([start + b for b in stable_boundaries(head, op.pattern, 1, overlap - 1)] if start else [])
                ahead = start + len(text) - len(tail)
                tails.append([ahead + b for b in stable_boundaries(tail, op.pattern, len(tail) - overlap + 1, len(tail) - 1)] if start + len(text) < n else [])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("digest"), batch.column("part"), pa.array(heads, kind), pa.array(tails, kind)
            ], ["doc_id", "digest", "part", "head", "tail"])

    return run


def _stitched(rows: DataFrame, overlap: int, op: ByteBpe) -> DataFrame:
    found = overlapping(rows, op.chunk, overlap).mapInArrow(
        tidy(_finder(op, overlap)), "doc_id bigint, digest string, part int, head array<bigint>, tail array<bigint>"
    )
    once = found.groupBy("doc_id", "digest", "part").agg(F.first(F.struct("head", "tail")).alias("found"))
    whole = once.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_list(F.struct("part", "found.head", "found.tail"))).alias("parts"))
    pairs = F.arrays_zip(F.slice("parts", F.lit(1), F.size("parts") - 1).alias("a"), F.slice("parts", F.lit(2), F.size("parts")).alias("b"))
    cuts = F.transform(pairs, lambda p: F.array_min(F.array_intersect(p["a"]["tail"], p["b"]["head"])))
    return whole.select("doc_id", "digest", cuts.alias("cuts")).withColumn("done", ~F.exists("cuts", lambda c: c.isNull()))


def _encoder(op: ByteBpe, *keep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoding(op.path, op.pattern)
        for batch in batches:
            for part in pieces(batch, "text"):
                found = [np.array(bpe.encode_ordinary(t), np.int32) for t in part.column("text").to_pylist()]
                offsets = np.append(0, np.cumsum([len(x) for x in found])).astype(np.int32)
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*found, np.zeros(0, np.int32)])))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), ids], [*keep, "ids"])

    return run


def encode(documents: DataFrame, op: ByteBpe) -> DataFrame:
    """``(doc_id, ids)`` for each row of ``documents`` (doc_id, text); null and empty texts have no ids.

    Special strings are ordinary text. Repeated rows are encoded each; other columns are not read.
    """
    small_batches(documents.sparkSession)
    rows = keyed(documents)
    short = short_rows(rows, op.chunk).mapInArrow(tidy(_encoder(op, "doc_id")), _IDS)
    large = long_rows(rows, op.chunk)
    stitched = widened(large, op.overlap, lambda some, overlap: _stitched(some, overlap, op))
    cuts = stitched.select(F.col("doc_id").alias("id"), F.col("digest").alias("sum"), "cuts")
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("sum"))
    encoded = slices(large.join(cuts, same)).mapInArrow(
        tidy(_encoder(op, "doc_id", "digest", "part")), "doc_id bigint, digest string, part int, ids array<int>"
    )
    once = encoded.groupBy("doc_id", "digest", "part").agg(F.first("ids").alias("ids"))
    whole = once.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_list(F.struct("part", "ids"))).alias("parts"))
    joined = whole.select(F.col("doc_id").alias("id"), F.col("digest").alias("sum"), F.flatten("parts.ids").alias("ids"))
    return short.unionByName(large.select("doc_id", "digest").join(joined, same).select("doc_id", "ids"))


def decode_ids(ids: np.ndarray, op: ByteBpe) -> bytes:
    return encoding(op.path, op.pattern).decode_bytes(ids.tolist())


def decode(rows: DataFrame, op: ByteBpe) -> DataFrame:
    """``(doc_id, bytes)`` for rows of (doc_id, ids); null ids give no bytes, an id outside the vocabulary fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [decode_ids(np.asarray(x or (), np.int64), op) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], ["doc_id", "bytes"])

    return small_batches(rows.sparkSession) and rows.select("doc_id", "ids").mapInArrow(tidy(run), "doc_id bigint, bytes binary")


def digests(rows: DataFrame, op: ByteBpe, keep_ids: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` for rows of (doc_id, ids): ids as little-endian 32-bit integers."""
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            counts, ids, decoded = [], [], []
            for a, b in zip(offsets[:-1], offsets[1:]):
                own = flat[a:b]
                counts.append(b - a)
                ids.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(decode_ids(own, op)).hexdigest())
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            columns += [lists] * keep_ids
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return rows.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(
        tidy(run), schema
    )
