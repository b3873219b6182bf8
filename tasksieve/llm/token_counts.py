"""Token counts of whole texts with a tokenizer file of the ``tokenizers`` library, huge texts by overlapping chunks.

A text of at most ``chunk`` code points is encoded as it is. Longer ones are cut into overlapping chunks, each encoded with
offsets in its own task. Two neighbours are spliced after a token that both found with the same id and place, that ends a word, lies at least
``margin`` code points inside both chunks and is not followed by a combining mark: what comes after it is then encoded alike whatever
stood before, so the count is that of the whole text. Where no such token is found, the text is tried again with twice the overlap.

Offsets are needed in the zones that chunks share; what lies between is only counted. Where the tokenizer file shows that nothing in it
reaches across white space, a text's count is the sum of its words', and each distinct word is encoded once a task.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tasksieve.llm.chunks import keyed, long_rows, overlapping, short_rows, widened
from tasksieve.llm.stored import pieces, small_batches

_ENDS = "array<struct<key:string,index:bigint>>"


@dataclass(frozen=True)
class TokenCounts:
    path: str
    chunk: int = 32_768
    overlap: int = 1024
    margin: int = 64
    cache: int = 100_000


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str, cache: int):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    if hasattr(tokenizer.model, "_resize_cache"):
        tokenizer.model._resize_cache(cache)
    return tokenizer


#: Fixed value: a split pattern of public tokenizers whose matches hold no white space.
_WITHIN_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def splits_at_space(tokenizer_json: str) -> bool:
    """Whether the file proves that the tokens of a text are those of its words between ASCII white space, one word after the other.

    Normalizers work on characters or drop white space, which composes with nothing; the first split keeps matches without white space
    only; added tokens hold no white space and take none from beside them.
    """
    file = json.loads(tokenizer_json)

    def steps(part: dict | None, name: str) -> list[dict]:
        return [] if part is None else part[name] if part["type"] == "Sequence" else [part]

    space = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    normal = all(n["type"] in ("NFC", "Lowercase") or n == space for n in steps(file["normalizer"], "normalizers"))
    first, *others = steps(file["pre_tokenizer"], "pretokenizers") or [{}]
    split = first.get("type") == "Split" and first["pattern"] == {"Regex": _WITHIN_WORDS} and first["behavior"] == "Removed" and first["invert"]
    plain = all(o["type"] == "ByteLevel" and not o["add_prefix_space"] and not o["use_regex"] for o in others)
    added = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or len(t["content"].split()) != 1) for t in file["added_tokens"])
    return normal and split and plain and added and file["model"]["type"] == "BPE" and not file["model"]["dropout"]


class _Counts:
    """Numbers of tokens of many texts; words are remembered, up to a number of them and a length."""

    def __init__(self, path: str, cache: int, words: int = 400_000, length: int = 64) -> None:
        self.tokenizer, self.words, self.length = _tokenizer(path, cache), words, length
        self.by_word = splits_at_space(self.tokenizer.to_str())
        self.known: dict[str, int] = {}

    def encoded(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: pa.Array) -> np.ndarray:
        if not self.by_word:
            return np.array(self.encoded(texts.to_pylist()), np.int64)
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        found = [self.known.get(w, -1) for w in distinct]
        unseen = [i for i, n in enumerate(found) if n < 0]
        if len(self.known) + len(unseen) > self.words:
            self.known.clear()
        for i, n in zip(unseen, self.encoded([distinct[i] for i in unseen])):
            found[i] = n
            if len(distinct[i]) <= self.length:
                self.known[distinct[i]] = n
        total = np.append(0, np.cumsum(np.array(found, np.int64)[words.indices.to_numpy()]))
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        return total[offsets[1:]] - total[offsets[:-1]]

    def one(self, text: str) -> int:
        return int(self(pa.array([text], pa.large_string()))[0])


@functools.lru_cache(maxsize=2)
def _counts(path: str, cache: int) -> _Counts:
    return _Counts(path, cache)


def _counter(op: TokenCounts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counts(op.path, op.cache)
        for batch in batches:
            for part in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n_bytes"), pa.array(count(part.column("text")))], ["doc_id", "n_bytes", "n_tokens"]
                )

    return run


def _stable(text: str, low: int, high: int, begin: int, op: TokenCounts) -> tuple[int, list[tuple[int, int, dict]]]:
    """Number of tokens of ``text``, and its stable boundary tokens between low and high: begin, end, key and tokens up to and with it.

    ``begin`` is the place of the text's first code point in the whole text.
    """
    tokenizer = _tokenizer(op.path, op.cache)
    encoding = tokenizer.encode(text, add_special_tokens=False)
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    return len(encoding.ids), [
        (a, b, {"key": f"{begin + a}-{begin + b}-{token_id}", "index": index})
        for index, (token, token_id, (a, b)) in enumerate(zip(encoding.tokens, encoding.ids, encoding.offsets), 1)
        if low <= a < b <= high and suffix and token.endswith(suffix) and b < len(text) and not unicodedata.combining(text[b])
    ]


def boundaries(text: str, start: int, n_chars: int, op: TokenCounts, overlap: int) -> tuple[int, list[dict], list[dict]]:
    """Number of tokens of a chunk, and the stable boundary tokens in its head and tail as (key, tokens up to and with it).

    Only head and tail are encoded with offsets. Between the last boundary of the head and the first of the tail tokens are counted; a chunk
    whose zones meet or have no boundary is encoded as a whole.
    """
    size, first, last = len(text), start == 0, start + len(text) >= n_chars

    if size > 2 * overlap:
        cut = size - overlap
        _, head = (0, []) if first else _stable(text[:overlap], op.margin, overlap - op.margin, start, op)
        after, tail = (0, []) if last else _stable(text[cut:], op.margin, overlap - op.margin, start + cut, op)
        if (first or head) and (last or tail):
            count = _counts(op.path, op.cache)
            at, total = (0, 0) if first else (head[-1][1], head[-1][2]["index"])
            to, before = (size, 0) if last else (cut + tail[0][1], tail[0][2]["index"])
            total += count.one(text[at:to]) - before
            return total + after, [x for *_, x in head], [{"key": x["key"], "index": total + x["index"]} for *_, x in tail]
    n, found = _stable(text, op.margin, size - op.margin, start, op)
    head = [] if first else [x for _, b, x in found if b <= overlap - op.margin]
    return n, head, [] if last else [x for a, _, x in found if a >= size - overlap + op.margin]


def _chunk_encoder(op: TokenCounts, overlap: int):
    ends = pa.list_(pa.struct([("key", pa.string()), ("index", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                boundaries(text, start, n, op, overlap)
                for text, start, n in zip(*(batch.column(c).to_pylist() for c in ("text", "start", "n_chars")))
            ]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("digest"), batch.column("part"),
                pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], ends), pa.array([x[2] for x in found], ends),
            ], ["doc_id", "digest", "part", "n", "head", "tail"])

    return run


def splice(parts: list[tuple[int, list, list]]) -> int | None:
    """Tokens of the whole from (n, head, tail) of its chunks in order, or None if two neighbours share no boundary."""
    total, skipped = 0, 0
    for (n, _, tail), (_, head, _) in zip(parts, parts[1:]):
        after = {x["key"]: x["index"] for x in head}
        common = next((x for x in tail if x["key"] in after), None)
        if common is None or common["index"] < skipped:
            return None
        total += common["index"] - skipped
        skipped = after[common["key"]]
    return total + parts[-1][0] - skipped


def _splicer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        totals = [splice([(p["n"], p["head"], p["tail"]) for p in parts]) for parts in batch.column("parts").to_pylist()]
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("digest"), pa.array(totals, pa.int64()), pa.array([t is not None for t in totals])
        ], ["doc_id", "digest", "n_tokens", "done"])


def _counted(rows: DataFrame, overlap: int, op: TokenCounts) -> DataFrame:
    found = overlapping(rows, op.chunk, overlap).mapInArrow(
        _chunk_encoder(op, overlap), f"doc_id bigint, digest string, part int, n bigint, head {_ENDS}, tail {_ENDS}"
    )
    # Equal rows give equal chunks: one of each part is kept before the parts of a text come together.
    once = found.groupBy("doc_id", "digest", "part").agg(F.first(F.struct("n", "head", "tail")).alias("found"))
    whole = once.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_list(F.struct("part", "found.n", "found.head", "found.tail"))).alias("parts"))
    return whole.mapInArrow(_splicer, "doc_id bigint, digest string, n_tokens bigint, done boolean")


def count_tokens(documents: DataFrame, op: TokenCounts) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` for each row of ``documents`` (doc_id, text).

    Null counts as the empty text, with 0 tokens. No begin or end tokens are added; special strings inside a text count as the
    library's default has it. Repeated rows are counted each; other columns are not read.
    """
    small_batches(documents.sparkSession)
    rows = keyed(documents)
    size = F.octet_length("text").cast("bigint").alias("n_bytes")
    short = short_rows(rows, op.chunk).select("doc_id", "text", size).mapInArrow(_counter(op), "doc_id bigint, n_bytes bigint, n_tokens bigint")
    large = long_rows(rows, op.chunk)
    counted = widened(large, op.overlap, lambda some, overlap: _counted(some, overlap, op))
    keys = large.select("doc_id", "digest", size)
    joined = keys.join(
        counted.select(F.col("doc_id").alias("id"), F.col("digest").alias("sum"), "n_tokens"), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("sum"))
    )
    return short.unionByName(joined.select("doc_id", "n_bytes", "n_tokens"))
