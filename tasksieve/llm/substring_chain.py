"""Passages that documents share, exactly or with small changes, by seeds, collinear chains and alignment.

1. Seeds: the k-word runs whose hash is least in some window of ``window`` consecutive runs, so any equal stretch of k + window - 1
   words has a seed in both texts. Short and dense seeds find passages with words changed all over, middle ones those whose short runs stand in
   many documents. Long ones, drawn so that every equal stretch of
   ``min_words`` words has one, find passages whose single lines stand in other documents too: they count as two points, the
   short runs at their beginning and end.
2. The n-th occurrence of a seed in a text counts as a seed of its own, its anchor is the one of the smallest doc_id. Every other
   document's occurrence is matched with the anchor, a star instead of all pairs, so a line in a third of all documents costs one match each.
   Second and later occurrences also meet the first one's anchor: a text may hold a passage more often than the source does.
3. Per document the matches with one anchor document are chained: the best-scoring sequence increasing in both texts, one
   point a seed less a cost linear in the gaps, found with a Fenwick tree of prefix maxima. Chains are cut at gaps beyond ``max_gap``.
4. Chains are aligned on the words: gaps by longest common subsequence, ends extended until mismatches outweigh. What has ``min_words``
   words on both sides and ``identity`` of them equal is a passage.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tasksieve.llm.idfilter import id_filter, passes, place
from tasksieve.llm.stored import small_batches, stored, tidy
from tasksieve.llm.words import find_words, gram_hashes, mix

_CHAIN = "doc_id bigint, source bigint, p array<int>, q array<int>"
_PASSAGE = "doc_id bigint, source bigint, first_word bigint, n_words bigint, source_first bigint, source_words bigint, matched bigint"


@dataclass(frozen=True)
class PassageDedup:
    """seed: words a seed; window: seeds a window; middle_seed, middle_window: the same of longer, sparser ones; long_seed: words a long
    seed, at most max_gap + seed and min_words; max_gap, reach: words between seeds and beyond a chain's ends. bucket_seeds,
    packed_seeds: seeds meant for a bucket, and packed at a time; hot_documents: documents of one pack that make a seed hot."""

    seed: int = 5
    window: int = 4
    middle_seed: int = 8
    middle_window: int = 16
    long_seed: int = 30
    min_words: int = 50
    identity: float = 0.8
    max_gap: int = 48
    reach: int = 64
    bucket_seeds: int = 500_000
    packed_seeds: int = 1 << 19
    hot_documents: int = 64


def _kinds(op: PassageDedup) -> tuple[tuple[int, int], ...]:
    """Words a seed and seeds a window of each kind, by the number that pos has: short, long, middle."""
    return (op.seed, op.window), (op.long_seed, op.min_words - op.long_seed + 1), (op.middle_seed, op.middle_window)


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the first least hash of every window, all of them for one window or less."""
    if len(hashes) <= window:
        return np.array([int(hashes.argmin())]) if len(hashes) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    at = np.arange(len(views)) + views.argmin(axis=1)
    return at[np.append(True, at[1:] != at[:-1])]


def numbered(hashes: np.ndarray) -> np.ndarray:
    """The hashes, the second and later occurrences of one changed by their number: a text never has the same seed twice.

    So the n-th occurrence in one text meets the n-th in another, and texts that repeat a phrase many times chain as well.
    """
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    begins = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    number = np.empty(len(hashes), np.uint64)
    number[order] = np.arange(len(hashes)) - np.repeat(begins, np.diff(np.append(begins, len(hashes))))
    return np.where(number == 0, hashes, mix(hashes + number * np.uint64(0x9E3779B97F4A7C15)))


def _seeds(batch: pa.RecordBatch, op: PassageDedup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, doc_ids and places of the seeds of a batch: a place is four times that of the seed's first word, and the seed's kind.

    A second or later occurrence has an entry under its own number and one, with the complement of its place, under the first one's seed.
    """
    words = find_words(batch.column("text"))
    hashes, ids, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for kind, (size, window) in enumerate(_kinds(op)):
        grams = gram_hashes(words.hash, size)
        for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), words.first, words.first[1:]):
            if b - a >= size:
                own = grams[a : b - size + 1]
                at = winnow(own, window)
                named, pos = numbered(own[at]), 4 * at + kind
                later = named != own[at]
                hashes += [named, own[at][later]]
                places += [pos.astype(np.int32), ~pos[later].astype(np.int32)]
                ids.append(np.full(len(at) + int(later.sum()), doc_id, np.int64))
    return np.concatenate(hashes), np.concatenate(ids), np.concatenate(places)


_PACKED = "bucket bigint, seed bigint, n int, payload binary"
_MATCHES = "kind int, seed bigint, source bigint, q int, n int, payload binary"
_COLD, _ANCHOR, _HOT = range(3)
#: Marks the place of a hot seed's anchor; places are smaller.
_MARK = 1 << 40


def _pack(first: np.ndarray, *others: np.ndarray) -> tuple[int, bytes]:
    """Number and bytes of entries sorted by the first column: bytes of like weight lie together, so that small numbers hardly cost anything."""
    columns = np.stack([np.diff(first, prepend=0), *others]).astype("<i8")
    planes = columns.view(np.uint8).reshape(len(columns), len(first), 8).transpose(0, 2, 1)
    return len(first), pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def _unpack(n: int, payload: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(payload, 8 * n * columns, codec="zstd", asbytes=True), np.uint8)
    deltas, *others = np.ascontiguousarray(raw.reshape(columns, 8, n).transpose(0, 2, 1)).view("<i8").reshape(columns, n)
    return [np.cumsum(deltas), *others]


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])


@dataclass(frozen=True)
class _Layout:
    """Seeds are cut to ``bits`` and dealt to ``buckets`` by range; both follow the size of the input."""

    buckets: int
    bits: int

    @classmethod
    def of(cls, text_bytes: int, op: PassageDedup) -> "_Layout":
        seeds = max(1, text_bytes // 5)
        # A cut hash meets another one by chance once in 4096 seeds; the words decide later.
        return cls(max(64, seeds // op.bucket_seeds), min(62, seeds.bit_length() + 12))

    def bucket(self, seeds: np.ndarray) -> np.ndarray:
        """By range: sorted seeds have sorted buckets."""
        spare = max(0, self.bits + self.buckets.bit_length() - 62)
        return ((seeds >> spare) * self.buckets) >> (self.bits - spare)


def _packer(op: PassageDedup, layout: _Layout):
    """Seeds sorted and packed by bucket. Those of many documents in one go are hot: their bucket gets the one of the smallest
    doc_id, the occurrences of each travel apart as one row, to any bucket beyond."""

    def flush(held: list[tuple], apart: int) -> Iterator[pa.RecordBatch]:
        hashes, ids, places = (np.concatenate(c) for c in zip(*held))
        hashes = (hashes >> np.uint64(64 - layout.bits)).astype(np.int64)
        order = np.lexsort((ids, hashes))
        hashes, ids, places = hashes[order], ids[order], places[order].astype(np.int64)
        starts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(hashes))))
        first = places >= 0
        hot = (np.bincount(group, first, len(starts)) >= op.hot_documents)[group]
        # Entries of a group are sorted by doc_id: its first one with a place of its own stays in the bucket, marked.
        least = np.zeros(len(hashes), bool)
        at = np.flatnonzero(hot & first)
        least[at[np.append(True, group[at][1:] != group[at][:-1])[: len(at)]]] = True
        stay = ~hot | least
        columns = hashes[stay], ids[stay], np.where(least, places | _MARK, places)[stay]
        bucket = layout.bucket(columns[0])
        cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        rows = [(int(bucket[a]), None, *_pack(*(c[a:b] for c in columns))) for a, b in zip(cuts, np.append(cuts[1:], len(bucket)))]
        for g in np.unique(group[hot]):
            a, b = starts[g], starts[g + 1] if g + 1 < len(starts) else len(hashes)
            rows.append((layout.buckets + (int(hashes[a]) + apart) % layout.buckets, int(hashes[a]), *_pack(ids[a:b], places[a:b])))
        yield _rows(rows, _PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, apart = [], 0, TaskContext.get().partitionId()
        for batch in batches:
            found = _seeds(batch, op)
            held.append(found)
            size += len(found[0])
            if size >= op.packed_seeds:
                yield from flush(held, apart)
                held, size, apart = [], 0, apart + 1
        if size:
            yield from flush(held, apart)

    return run


def _matched(seeds: np.ndarray, ids: np.ndarray, places: np.ndarray) -> list[tuple]:
    """Rows of _MATCHES for the entries of one bucket: all its matches in one, and the anchors of hot seeds."""
    marked = places >= _MARK
    places = np.where(marked, places & (_MARK - 1), places)
    order = np.lexsort((places < 0, ids, seeds))
    seeds, ids, places, marked = seeds[order], ids[order], places[order], marked[order]
    starts = np.flatnonzero(np.append(True, seeds[1:] != seeds[:-1]))
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(seeds))))
    at = np.flatnonzero(places >= 0)
    begins = np.append(True, group[at][1:] != group[at][:-1]) if len(at) else np.zeros(0, bool)
    source, q = np.full(len(starts), -1, np.int64), np.zeros(len(starts), np.int64)
    known = np.zeros(len(starts), bool)
    source[group[at[begins]]], q[group[at[begins]]], known[group[at[begins]]] = ids[at[begins]], places[at[begins]], True
    shared = known & (np.bincount(group[at], ids[at] != source[group[at]], len(starts)) > 0)
    hot = np.bincount(group, marked, len(starts)) > 0
    cold = np.flatnonzero((shared | hot)[group] & known[group] & ~marked & (ids != source[group]))
    cold = cold[np.argsort(ids[cold], kind="stable")]
    rows = [(_COLD, None, None, None, *_pack(ids[cold], source[group[cold]], places[cold], q[group[cold]]))] if len(cold) else []
    return rows + [(_ANCHOR, int(seeds[starts[g]]), int(source[g]), int(q[g]), 0, None) for g in np.flatnonzero(hot)]


def _matcher(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every entry of a bucket with the one of the smallest doc_id that has its seed. Hot occurrences pass through."""
    held, now = [], None

    def bucket() -> list[tuple]:
        return _matched(*(np.concatenate(c) for c in zip(*held)))

    for batch in batches:
        for number, seed, n, payload in zip(*(batch.column(c).to_pylist() for c in ("bucket", "seed", "n", "payload"))):
            if seed is not None:
                yield _rows([(_HOT, seed, None, None, n, payload)], _MATCHES)
                continue
            if held and number != now:
                yield _rows(bucket(), _MATCHES)
                held = []
            now = number
            held.append(_unpack(n, payload, 3))
    if held:
        yield _rows(bucket(), _MATCHES)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The matches row by row; a hot seed's occurrences have one source and place."""
    for batch in batches:
        for source, q, n, payload in zip(*(batch.column(c).to_pylist() for c in ("source", "q", "n", "payload"))):
            if source is None:
                ids, sources, places, qs = _unpack(n, payload, 4)
            else:
                ids, places = _unpack(n, payload, 2)
                ids, places = ids[ids != source], places[ids != source]
                sources, qs = np.full(len(ids), source), np.full(len(ids), q)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(sources), pa.array(places.astype(np.int32)), pa.array(qs.astype(np.int32))], ["doc_id", "source", "pos", "q"]
            )


def _matches(named: DataFrame, op: PassageDedup) -> DataFrame:
    """``(doc_id, source, pos, q)``: one row for each seed of a document that one with a smaller doc_id has too.

    Seeds cross one exchange, packed by ranges of their hashes; what only one document has ends there. The occurrences of hot seeds, a row
    for each seed and pack, find their anchors by a join, which broadcasts these or splits a skewed seed: no task holds a seed of
    very many documents.
    """
    size = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    layout = _Layout.of(size, op)
    session = named.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), layout.buckets // 4)
    packed = named.mapInArrow(tidy(_packer(op, layout)), _PACKED).repartition(tasks, "bucket").sortWithinPartitions("bucket")
    found = stored(packed.mapInArrow(tidy(_matcher), _MATCHES), "matches")
    anchors = found.where(F.col("kind") == _ANCHOR).select("seed", "source", "q")
    hot = found.where(F.col("kind") == _HOT).select("seed", "n", "payload").join(anchors, "seed")
    cold = found.where(F.col("kind") == _COLD).select("source", "q", "n", "payload")
    return cold.unionByName(hot.select("source", "q", "n", "payload")).mapInArrow(tidy(_expand), "doc_id bigint, source bigint, pos int, q int")


def chain(points: list[tuple[int, int]], max_gap: int) -> list[list[tuple[int, int]]]:
    """Disjoint chains of points (p, q), increasing in both, cut at gaps over ``max_gap``; best chain first.

    The score of a chain is its number of points less (gap in p + gap in q) / (2 max_gap) per step. With v = score + cost * (p + q), the best
    predecessor of a point is the one of greatest v among those with smaller p and q: a prefix maximum over the ranks of q.
    """
    points = sorted(points)
    cost = 1.0 / (2 * max_gap)
    ranks = {q: i + 1 for i, q in enumerate(sorted({q for _, q in points}))}
    size = len(ranks)
    tree_value, tree_index = [float("-inf")] * (size + 1), [-1] * (size + 1)
    score, before = [0.0] * len(points), [-1] * len(points)
    at = 0
    while at < len(points):
        # Points of equal p cannot follow one another: all are looked up before any is entered.
        stop = at
        while stop < len(points) and points[stop][0] == points[at][0]:
            p, q = points[stop]
            best, index, r = float("-inf"), -1, ranks[q] - 1
            while r > 0:
                if tree_value[r] > best:
                    best, index = tree_value[r], tree_index[r]
                r &= r - 1
            gain = best - cost * (p + q)
            score[stop] = 1.0 + max(0.0, gain)
            before[stop] = index if gain > 0 else -1
            stop += 1
        for i in range(at, stop):
            p, q = points[i]
            value, r = score[i] + cost * (p + q), ranks[q]
            while r <= size:
                if value > tree_value[r]:
                    tree_value[r], tree_index[r] = value, i
                r += r & -r
        at = stop
    used, chains = [False] * len(points), []
    for end in sorted(range(len(points)), key=lambda i: (-score[i], i)):
        found, i = [], end
        while i >= 0 and not used[i]:
            used[i] = True
            found.append(points[i])
            i = before[i]
        part: list[tuple[int, int]] = []
        for point in reversed(found):
            if part and max(point[0] - part[-1][0], point[1] - part[-1][1]) > max_gap:
                chains.append(part)
                part = []
            part.append(point)
        if part:
            chains.append(part)
    return chains


def _points(p: np.ndarray, q: np.ndarray, op: PassageDedup) -> list[tuple[int, int]]:
    """Places of the short runs that are equal: a long seed's match gives those at its beginning and end, a middle one's that at its beginning."""
    p = np.where(p < 0, ~p, p)
    far = (p & 1) * (op.long_seed - op.seed)
    p, q = p >> 2, q >> 2
    return sorted({*zip(p.tolist(), q.tolist()), *zip((p + far).tolist(), (q + far).tolist())})


def wanted_matches(sources: np.ndarray, ps: np.ndarray, qs: np.ndarray, op: PassageDedup) -> np.ndarray:
    """Places of a document's matches without later occurrences' additional ones that lie in a passage certain without them.

    Certain are ``min_words`` words and more of one source that matches of one distance cover without a gap: equal word by word. A phrase
    repeated through a long text else makes a chain of each repeat, besides the one over all.
    """
    later = ps < 0
    if not later.any():
        return np.arange(len(ps))
    begin = np.where(later, ~ps, ps)
    end = (begin >> 2) + np.array([size for size, _ in _kinds(op)])[begin & 3]
    begin = begin >> 2
    own = np.flatnonzero(~later)
    own = own[np.lexsort((begin[own], (begin - (qs >> 2))[own], sources[own]))]
    stretches = []
    if len(own):
        distance = (begin - (qs >> 2))[own]
        other = np.append(True, (sources[own][1:] != sources[own][:-1]) | (distance[1:] != distance[:-1]))
        base = np.cumsum(other) * (int(end.max()) + 2)
        reached = np.maximum.accumulate(end[own] + base)
        cuts = np.flatnonzero(np.append(True, (begin[own] + base)[1:] > reached[:-1]))
        last = np.append(cuts[1:], len(own)) - 1
        stretches = np.stack([begin[own][cuts], reached[last] - base[last]], axis=1)
        stretches = stretches[stretches[:, 1] - stretches[:, 0] >= op.min_words]
    if not len(stretches):
        return np.arange(len(ps))
    stretches = stretches[np.argsort(stretches[:, 0], kind="stable")]
    farthest = np.maximum.accumulate(stretches[:, 1])
    at = np.searchsorted(stretches[:, 0], begin, side="right") - 1
    return np.flatnonzero(~(later & (at >= 0) & (farthest[at] >= end)))


def _chains(op: PassageDedup):
    lists = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [])
            matches = batch.column("matches")
            sources, ps, qs = (matches.values.field(i).to_numpy() for i in range(3))
            offsets = matches.offsets.to_numpy()
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1], offsets[1:]):
                order = wanted_matches(sources[a:b], ps[a:b].astype(np.int64), qs[a:b].astype(np.int64), op) + a
                order = order[np.argsort(sources[order], kind="stable")]
                own = sources[order]
                cuts = np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(own))
                for low, high in zip(cuts, cuts[1:]):
                    at = order[low:high]
                    points = _points(ps[at], qs[at], op)
                    # One seed alone is no chain.
                    if len(points) < 2:
                        continue
                    for found in chain(points, op.max_gap):
                        if len(found) > 1:
                            for column, value in zip(out, (doc_id, int(own[low]), [p for p, _ in found], [q for _, q in found])):
                                column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], lists), pa.array(out[3], lists)], ["doc_id", "source", "p", "q"])

    return run


def _words(wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(passes(wanted.value, batch.column("place").to_numpy())))
            words = find_words(batch.column("text"))
            lists = pa.ListArray.from_arrays(words.first.astype(np.int32), pa.array((words.hash >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "words"])

    return run


def _common(x: list[int], y: list[int]) -> int:
    """Length of the longest common subsequence."""
    if not x or not y:
        return 0
    row = [0] * (len(y) + 1)
    for a in x:
        diagonal = 0
        for j, b in enumerate(y, 1):
            above = row[j]
            row[j] = diagonal + 1 if a == b else (above if above >= row[j - 1] else row[j - 1])
            diagonal = above
    return row[-1]


def _extended(x: list[int], y: list[int], i: int, j: int, step: int) -> tuple[int, int]:
    """Words taken and equal beyond places i and j in direction ``step``; a mismatch costs two, and six in a row end it."""
    score = best = taken = equal = seen = 0
    best_equal = 0
    while 0 <= i < len(x) and 0 <= j < len(y) and score > best - 6:
        seen += 1
        same = x[i] == y[j]
        equal += same
        score += 1 if same else -2
        if score > best:
            best, taken, best_equal = score, seen, equal
        i, j = i + step, j + step
    return taken, best_equal


def align(x: list[int], y: list[int], points: list[tuple[int, int]], seed: int) -> tuple[int, int, int, int, int]:
    """(begin, end) in x and in y and the number of equal words of the passage around a chain of seeds at ``points``."""
    p, q = points[0]
    matched = 0
    for (p0, q0), (p1, q1) in zip(points, points[1:]):
        dp, dq = p1 - p0, q1 - q0
        if dp == dq and x[p0:p1] == y[q0:q1]:
            matched += dp
        else:
            # The seed's own words are equal as far as neither next seed begins within them.
            own = min(seed, dp, dq)
            matched += own + _common(x[p0 + own : p1], y[q0 + own : q1])
    end_p, end_q = points[-1][0] + seed, points[-1][1] + seed
    matched += seed
    left, left_equal = _extended(x, y, p - 1, q - 1, -1)
    right, right_equal = _extended(x, y, end_p, end_q, 1)
    return p - left, end_p + right, q - left, end_q + right, matched + left_equal + right_equal


def passage(x: list[int], y: list[int], points: list[tuple[int, int]], op: PassageDedup) -> tuple[int, int, int, int, int] | None:
    """The longest alignment of the chain that is long and equal enough, with both ends extended, one or none."""
    whole = align(x, y, points, op.seed)
    if min(whole[1] - whole[0], whole[3] - whole[2]) < op.min_words:
        return None
    if whole[4] >= op.identity * max(whole[1] - whole[0], whole[3] - whole[2]):
        return whole
    (p, q), (last_p, last_q) = points[0], points[-1]
    found = []
    for i, j, m, n in ((0, 0, last_p + op.seed, last_q + op.seed), (p, q, len(x), len(y)), (p, q, last_p + op.seed, last_q + op.seed)):
        a, b, c, d, matched = align(x[i:m], y[j:n], [(u - i, v - j) for u, v in points], op.seed)
        if min(b - a, d - c) >= op.min_words and matched >= op.identity * max(b - a, d - c):
            found.append((a + i, b + i, c + j, d + j, matched))
    return max(found, key=lambda f: f[1] - f[0], default=None)


def _aligner(op: PassageDedup):
    names = [c.split()[0] for c in _PASSAGE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = ("doc_id", "source", "p", "q", "x_low", "y_low", "x", "y")
            for doc_id, source, p, q, x_low, y_low, x, y in zip(*(batch.column(c).to_pylist() for c in columns)):
                points = [(a - x_low, b - y_low) for a, b in zip(p, q)]
                found = passage(x, y, points, op)
                if found:
                    a, b, c, d, matched = found
                    rows.append((doc_id, source, a + x_low, b - a, c + y_low, d - c, matched))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names))], names)

    return run


def repeated_passages(documents: DataFrame, op: PassageDedup = PassageDedup()) -> DataFrame:
    """Passages of ``documents`` (doc_id, text) that a document with a smaller doc_id has too.

    ``(doc_id, source, first_word, n_words, source_first, source_words, matched)``: a document's words (runs between white space,
    A-Z lower-cased) from ``first_word`` on repeat the source's from ``source_first`` on, ``matched`` of them equal. The first holder of
    a passage has no row for it, documents without repeats have none. A text equal to that of a smaller doc_id is one passage. Null,
    empty and short texts repeat nothing; rows with a null doc_id are left out; a doc_id that several rows share must mean
    one text (the smallest is taken). Passages of a document can overlap. Other columns are not read.
    """
    small_batches(documents.sparkSession)
    named = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    matches = _matches(named, op)
    grouped = matches.groupBy("doc_id").agg(F.collect_list(F.struct("source", "pos", "q")).alias("matches"))
    chains = stored(grouped.mapInArrow(tidy(_chains(op)), _CHAIN), "chains")
    involved = id_filter(chains.select("doc_id").unionByName(chains.select(F.col("source").alias("doc_id"))), "doc_id")
    words = named.select("doc_id", "text", place("doc_id").alias("place")).mapInArrow(tidy(_words(involved)), "doc_id bigint, words array<int>")

    def reached(points: str, side: str) -> list:
        low = F.greatest(F.lit(0), F.get(points, F.lit(0)) - op.reach)
        high = F.element_at(points, -1) + op.seed + op.reach
        return [low.alias(f"{side}_low"), F.slice("words", low + 1, high - low).alias(side)]

    own = chains.join(words, "doc_id").select("doc_id", "source", "p", "q", *reached("p", "x"))
    both = own.join(words.withColumnRenamed("doc_id", "source"), "source").select("doc_id", "source", "p", "q", "x_low", "x", *reached("q", "y"))
    return both.mapInArrow(tidy(_aligner(op)), _PASSAGE).distinct()


def without_passages(documents: DataFrame, passages: DataFrame, key: str = "doc_id") -> DataFrame:
    """``documents`` with the words of ``passages`` (key, first_word, n_words) cut out of ``text``; all columns stay.

    What stands between the first cut word and the next kept one goes too. A document may become empty; it stays. Null texts stay null.
    """
    spans = passages.groupBy(key).agg(F.collect_list(F.struct("first_word", "n_words")).alias("_cuts"))
    rows = documents.join(spans, key, "left")
    place_of = rows.schema.fieldNames().index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, cuts in enumerate(batch.column("_cuts").to_pylist()):
                if cuts and texts[i]:
                    raw = texts[i].encode("utf-8", "surrogatepass")
                    words = find_words(pa.array([raw], pa.large_binary()))
                    keep = np.ones(len(raw), bool)
                    for cut in cuts:
                        first, stop = cut["first_word"], min(cut["first_word"] + cut["n_words"], len(words.start))
                        if first < stop:
                            keep[words.start[first] : words.start[stop] if stop < len(words.start) else len(raw)] = False
                    texts[i] = np.frombuffer(raw, np.uint8)[keep].tobytes().decode("utf-8", "surrogatepass")
            columns = [pa.array(texts, pa.string()) if k == place_of else batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return rows.mapInArrow(tidy(run), rows.drop("_cuts").schema)
