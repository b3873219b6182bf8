"""Words of many texts at once: their places and 64-bit hashes, by numpy over the bytes.

A class table gives each byte 0 (separates) or a class; a word is a longest run of bytes of one class within a text. In
UTF-8 every byte of a non-ASCII character is above 0x7F, so classes over bytes decide the same as classes over characters.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tasksieve.llm.stored import PIECE_BYTES, as_binary

_U = np.uint64
_STEP = 0x9E3779B97F4A7C15
_MULTIPLIER = 0xD1342543DE82EF95


def byte_classes(separators: str | None = None, words: str | None = None) -> np.ndarray:
    """Class 1 for all bytes but the given separators, or for the given ASCII characters and all non-ASCII bytes."""
    table = np.zeros(256, np.uint8)
    if separators is not None:
        table[:] = 1
        table[[ord(c) for c in separators]] = 0
    else:
        table[128:] = 1
        table[[ord(c) for c in words or ""]] = 1
    return table


SPACES = " \t\n\x0b\x0c\r"
BY_SPACE = byte_classes(separators=SPACES)
_ALNUM = "0123456789abcdefghijklmnopqrstuvwxyz"
ALNUM = byte_classes(words=_ALNUM + _ALNUM.upper())
#: Letters, digits and non-ASCII bytes form words of class 1, other visible characters words of class 2.
WORDS_AND_MARKS = np.where(BY_SPACE == 0, 0, np.where(ALNUM == 1, 1, 2)).astype(np.uint8)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@functools.cache
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_U) * _U(_STEP))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_MULTIPLIER, -1, 1 << 64)
    up, down = np.full(n, _MULTIPLIER, _U), np.full(n, inverse, _U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


@dataclass
class Words:
    """start and end of each word as places in the byte buffer, its class and hash; words of text i are first[i]:first[i+1]."""

    start: np.ndarray
    end: np.ndarray
    kind: np.ndarray
    hash: np.ndarray
    first: np.ndarray
    offsets: np.ndarray


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes back to back and the n + 1 offsets of the texts; null is empty."""
    column = as_binary(column)
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def _cuts(data: np.ndarray, classes: np.ndarray, limit: int) -> list[int]:
    """Places after separators, about ``limit`` bytes apart, at which the buffer can be cut; a longer word is not cut."""
    cuts, at = [0], 0
    while len(data) - at > limit:
        at += limit
        while at < len(data):
            found = np.flatnonzero(classes[data[at : at + 65536]] == 0)
            if len(found):
                at += int(found[0]) + 1
                break
            at += 65536
        if at < len(data):
            cuts.append(at)
    return [*cuts, len(data)]


def find_words(column: pa.Array, classes: np.ndarray = BY_SPACE, fold: np.ndarray = LOWER, limit: int = PIECE_BYTES) -> Words:
    data, offsets = text_bytes(column)
    parts = []
    begins = np.unique(offsets[:-1]) if len(offsets) > 1 else np.zeros(0, np.int64)
    cuts = _cuts(data, classes, limit)
    for low, high in zip(cuts, cuts[1:]):
        part = data[low:high]
        if not len(part):
            continue
        kind = classes[part]
        edge = np.empty(len(part), bool)
        edge[0] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:])
        own = begins[np.searchsorted(begins, low) : np.searchsorted(begins, high)]
        edge[own - low] = True
        start = np.flatnonzero(edge)
        end = np.append(start[1:], len(part))
        keep = kind[start] > 0
        start, end = start[keep], end[keep]
        size = max(1 << 16, 1 << (len(part) - 1).bit_length())
        up, down = _powers(size)
        total = np.empty(len(part) + 1, _U)
        total[0] = 0
        np.cumsum(_byte_values()[fold[part]] * up[: len(part)], out=total[1:])
        hashed = mix((total[end] - total[start]) * down[start] + (end - start).astype(_U) * _U(_STEP))
        parts.append((start + low, end + low, kind[start], hashed))
    if parts:
        start, end, kind, hashed = (np.concatenate(x) for x in zip(*parts))
    else:
        start = end = np.zeros(0, np.int64)
        kind, hashed = np.zeros(0, np.uint8), np.zeros(0, _U)
    return Words(start, end, kind, hashed, np.searchsorted(start, offsets), offsets)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, by the run's first word; the caller leaves out runs that cross texts."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    total = np.zeros(n, _U)
    for j in range(k):
        total = total * _U(_MULTIPLIER) + words[j : j + n]
    return mix(total + _U(k * _STEP & 0xFFFFFFFFFFFFFFFF))


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of k words; a shorter text has its whole sequence as one element."""
    grams, sets = gram_hashes(words.hash, k), []
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= k:
            own = np.sort(grams[a : b - k + 1])
            sets.append(own[np.append(True, own[1:] != own[:-1])])
        elif b > a:
            sets.append(gram_hashes(words.hash[a:b], int(b - a)))
        else:
            sets.append(np.zeros(0, _U))
    return sets
