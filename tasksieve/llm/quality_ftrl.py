"""Text quality by logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Features of a text: words (runs of letters and digits) and marks (runs of other visible characters), case kept, as unigrams
and bigrams, plus two grams with a back reference: "the word before again" and "the pair before again". Each is hashed into
2**bits slots; the value of a slot is its count divided by the number of grams, so texts of all lengths weigh the same.

Training deals the labelled rows out to ``shards`` tasks. Each makes ``epochs`` passes of FTRL-proximal updates (per-slot
learning rates, L1 and L2) in mini-batches; the shards' weights are averaged. Only the averaged weights, at most 2**bits
numbers, come to the driver and are broadcast; scoring is a sparse dot product per text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tasksieve.llm.stored import pieces, small_batches, tidy
from tasksieve.llm.words import SAME, WORDS_AND_MARKS, Words, find_words, mix

_U = np.uint64


@dataclass(frozen=True)
class QualityModel:
    """max_rows: the bound of the training sample. Of more labelled rows than that about max_rows are learnt from, by a hash of doc_id."""

    bits: int = 18
    shards: int = 8
    epochs: int = 6
    batch: int = 16
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 1e-4
    l2: float = 1e-4
    scale: float = 20.0
    max_rows: int = 20_000


def _features(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all grams, text after text, and the n + 1 places where the texts begin."""
    h, n = words.hash, len(words.hash)
    shift = _U(64 - bits)
    own = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    grams, owners = [mix(h + words.kind.astype(_U)) >> shift], [own]
    if n > 1:
        same = own[1:] == own[:-1]
        pair = mix(h[:-1] * _U(3) + h[1:])
        grams.append(pair[same] >> shift)
        owners.append(own[1:][same])
        again = same & (h[1:] == h[:-1])
        grams.append(np.full(int(again.sum()), mix(np.array([1], _U))[0] >> shift))
        owners.append(own[1:][again])
    if n > 3:
        twice = (own[3:] == own[:-3]) & (h[2:-1] == h[:-3]) & (h[3:] == h[1:-2])
        grams.append(np.full(int(twice.sum()), mix(np.array([2], _U))[0] >> shift))
        owners.append(own[3:][twice])
    slots, owner = np.concatenate(grams).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return slots[order], np.searchsorted(owner[order], np.arange(len(words.first)))


def _raw_scores(slots: np.ndarray, first: np.ndarray, weights: np.ndarray, bias: float, scale: float) -> np.ndarray:
    """Each text's sum is its own, so that equal texts have equal scores whatever stands beside them."""
    counts = np.diff(first)
    total = np.zeros(len(counts))
    full = np.flatnonzero(counts)
    if len(full):
        total[full] = np.add.reduceat(weights[slots], first[:-1][full])
    return bias + scale * total / np.maximum(counts, 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit_ftrl(texts: list[tuple[np.ndarray, int]], op: QualityModel, seed: int = 0) -> np.ndarray:
    """Weights (the bias last) after FTRL-proximal updates over ``(slots, label)`` rows."""
    size = (1 << op.bits) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    rows = []
    for slots, label in texts:
        used, counts = np.unique(slots, return_counts=True)
        rows.append((np.append(used, size - 1), np.append(op.scale * counts / max(1, len(slots)), 1.0), label))
    order = np.random.default_rng(seed)
    for _ in range(op.epochs):
        shuffled = order.permutation(len(rows))
        for at in range(0, len(rows), op.batch):
            chosen = [rows[i] for i in shuffled[at : at + op.batch]]
            index = np.concatenate([r[0] for r in chosen])
            parts = [(sigmoid(np.array([w[i] @ x]))[0] - y) * x for i, x, y in chosen]
            used, place = np.unique(index, return_inverse=True)
            g = np.bincount(place, np.concatenate(parts)) / len(chosen)
            sigma = (np.sqrt(n[used] + g * g) - np.sqrt(n[used])) / op.alpha
            z[used] += g - sigma * w[used]
            n[used] += g * g
            strong = np.abs(z[used]) > op.l1
            w[used] = np.where(strong, -(z[used] - np.sign(z[used]) * op.l1) / ((op.beta + np.sqrt(n[used])) / op.alpha + op.l2), 0.0)
    return w


def _trainer(op: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = []
        for batch in batches:
            for part in pieces(batch, "text"):
                slots, first = _features(find_words(part.column("text"), WORDS_AND_MARKS, SAME), op.bits)
                texts += [(slots[a:b], y) for a, b, y in zip(first, first[1:], part.column("label").to_pylist())]
        if texts:
            # Weighed by its rows; slot -1 counts them.
            w = fit_ftrl(texts, op) * len(texts)
            used = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(w[used], len(texts)))], ["slot", "weight"])

    return run


def fit(documents: DataFrame, labels: DataFrame, op: QualityModel = QualityModel()) -> np.ndarray:
    """Weights from ``documents`` (doc_id, text) and ``labels`` (doc_id, label 0 or 1), the bias last.

    Null labels and labels of absent documents teach nothing; a doc_id labelled twice teaches its larger label, one of
    several rows its least text. Without any label all weights are zero and every score is 0.5.
    """
    small_batches(documents.sparkSession)
    chosen = labels.where("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    share = min(1.0, op.max_rows / max(1, chosen.count()))
    sample = chosen.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # ``max_rows`` bounds the sample, so it goes to the texts instead of all texts to it.
    # A doc_id that very many rows share is one row of the sample.
    once = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    rows = once.select("text", "label", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(op.shards)).alias("shard"))
    models = rows.repartition(op.shards, "shard").select("text", "label").mapInArrow(tidy(_trainer(op)), "slot bigint, weight double")
    weights = np.zeros((1 << op.bits) + 1)
    summed = dict(models.groupBy("slot").agg(F.sum("weight").alias("weight")).where("abs(weight) > 1e-9").collect())
    taught = summed.pop(-1, 1.0)
    weights[list(summed)] = list(summed.values())
    return weights / taught


def score(documents: DataFrame, weights: np.ndarray, op: QualityModel = QualityModel()) -> DataFrame:
    """``(doc_id, score)`` for each row; null and empty texts get the bias alone. Repeated rows get equal scores."""
    small_batches(documents.sparkSession)
    held = documents.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        for batch in batches:
            for part in pieces(batch, "text"):
                slots, first = _features(find_words(part.column("text"), WORDS_AND_MARKS, SAME), op.bits)
                scores = sigmoid(_raw_scores(slots, first, w, float(w[-1]), op.scale))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id bigint, score double")


def held_out(column: str = "doc_id"):
    """Rows kept out of training: crc32 of the id as text leaves the remainder 1 by 3."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1
