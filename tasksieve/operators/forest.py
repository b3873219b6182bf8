"""A random forest grown until its leaves are pure, in few Spark jobs.

Every tree draws its rows by a Poisson number from a hash of row and tree, and every node the order in which it tries features from a
hash of its path, so a forest depends on the rows and the seed alone, not on partitions or on who grows which node.

A node with many rows is split by histograms: one pass over the rows counts the classes by bin for all large nodes of a level, the
counts are added up where the nodes' rows of counts meet, and only the chosen splits reach the driver. A node with at most
``small_rows`` rows is handed off with them to one grouped task that grows the rest of its subtree with exact thresholds. So the jobs of a
forest follow the logarithm of rows / small_rows, not the depth of its trees. A table that is small as a whole is broadcast, and each task grows
whole trees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tasksieve.session import scratch_path

_U = np.uint64
_PIECE = "tree int, piece int, feature array<int>, threshold array<double>, low array<int>, high array<int>, value array<double>"
#: What stands in ``feature`` for a leaf, and for a node that another piece continues (its number in ``low``).
LEAF, CONTINUED = -1, -2
#: Bits of a whole number that is sorted.
_PACKED_BITS = 63


@dataclass(frozen=True)
class Forest:
    """min_leaf: rows a leaf has at least; tries: varying features a node looks at (0: the root of their number); bins: of a feature in
    large nodes; small_rows: rows of a node that is handed off; block: trees grown at a time; group: large nodes counted in one pass."""

    trees: int = 300
    min_leaf: int = 2
    tries: int = 0
    seed: int = 2026
    bins: int = 64
    small_rows: int = 20_000
    block: int = 32
    group: int = 1024


# --- chance by hashing ---------------------------------------------------------------------------------------------------

def _mixed(x: np.ndarray) -> np.ndarray:
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def root_key(seed: int, tree: int) -> np.ndarray:
    return _mixed(_mixed(np.array([seed], np.int64).view(_U)) + _U(tree))


def child_keys(keys: np.ndarray, side: int) -> np.ndarray:
    return _mixed(keys ^ _U(0xA5A5A5A5 + side))


def feature_order(keys: np.ndarray, features: int) -> np.ndarray:
    """For each node the features in the order it tries them."""
    return np.argsort(_mixed(keys[:, None] + np.arange(1, features + 1, dtype=_U)[None, :] * _U(0xD1342543DE82EF95)), axis=1, kind="stable")


_POISSON = np.cumsum(np.exp(-1) / np.cumprod([1.0, *range(1, 20)]))


def draws(rows: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often a tree draws each row: Poisson numbers of mean 1."""
    chance = (_mixed(rows.view(_U) ^ root_key(seed, tree)[0]) >> _U(11)).astype(np.float64) / 2.0**53
    return np.searchsorted(_POISSON, chance, side="right")


# --- splits ----------------------------------------------------------------------------------------------------------------

def purity(low0: np.ndarray, low1: np.ndarray, high0: np.ndarray, high1: np.ndarray, weights: tuple[float, float]) -> np.ndarray:
    """Greater for better splits: total weight less the weighted Gini impurity of both sides."""
    a, b, c, d = low0 * weights[0], low1 * weights[1], high0 * weights[0], high1 * weights[1]
    return (a * a + b * b) / (a + b) + (c * c + d * d) / (c + d)


def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A threshold t with a <= t < b."""
    middle = a / 2 + b / 2
    return np.where(middle < b, middle, a)


@dataclass
class Piece:
    """Nodes as parallel arrays; rows with a value up to the threshold go low."""

    feature: np.ndarray
    threshold: np.ndarray
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray


def ranked(x: np.ndarray) -> np.ndarray:
    """For each feature the place of every row's value among the feature's values."""
    places = np.empty((x.shape[1], len(x)), np.int32)
    for f in range(x.shape[1]):
        places[f] = np.unique(x[:, f], return_inverse=True)[1].ravel()
    return places


def grow(
    x: np.ndarray, n0: np.ndarray, n1: np.ndarray, key: np.ndarray, weights: tuple[float, float], op: Forest, places: np.ndarray | None = None,
) -> Piece:
    """The subtree over rows ``x`` that were drawn n0 times with label 0 or n1 times with label 1, all nodes of a level at once.

    ``places`` are the rows' columns of ``ranked`` over these rows or more of them."""
    features = x.shape[1]
    tries = op.tries or max(1, int(np.sqrt(features)))
    levels: list[tuple[np.ndarray, ...]] = []
    # Node, place of the value among the feature's values and row fit one whole number as a rule: to sort those is much faster.
    places = ranked(x) if places is None else places
    varies = (places != places[:, :1]).any(axis=1)
    row_bits, place_bits = int(len(x)).bit_length(), int(places.max(initial=0)).bit_length()
    flat, size = places.ravel(), np.int64(len(x))
    # Both classes' draws in one number: they are looked up and added up together.
    both, half = n0.astype(np.int64) | (n1.astype(np.int64) << 32), (1 << 32) - 1
    rows, node, keys, total = np.arange(len(x)), np.zeros(len(x), np.int64), key.copy(), 1
    while len(keys):
        m, drawn = len(keys), both.take(rows)
        t0, t1, n = np.bincount(node, drawn & half, m), np.bincount(node, drawn >> 32, m), np.bincount(node, minlength=m)
        value = weights[1] * t1 / (weights[0] * t0 + weights[1] * t1)
        best, feature, threshold, cut = np.full(m, -np.inf), np.full(m, LEAF), np.zeros(m), np.zeros(m, np.int32)
        open_, seen, order = (t0 > 0) & (t1 > 0) & (n >= 2 * op.min_leaf), np.zeros(m, np.int64), feature_order(keys, features)
        for place in range(features):
            live = open_ & ((seen < tries) | (feature < 0))
            if not live.any():
                break
            # A feature with one value in all rows has nothing to be tried.
            tried = order[:, place]
            live &= varies[tried]
            own = np.flatnonzero(live[node])
            if not len(own):
                continue
            at = node[own]
            ranks = flat.take(tried[at] * size + rows[own]).astype(np.int64)
            if m.bit_length() + place_bits + row_bits <= _PACKED_BITS:
                packed = (at << (place_bits + row_bits)) | (ranks << row_bits) | own
                packed.sort()
                own, at = packed & ((1 << row_bits) - 1), packed >> (place_bits + row_bits)
                ends = packed >> row_bits
            else:
                sorted_ = np.lexsort((ranks, at))
                own, at, ends = own[sorted_], at[sorted_], None
                ranks = ranks[sorted_]
            begins = np.zeros(m, np.int64)
            begins[live] = np.cumsum(n[live]) - n[live]
            steps = np.flatnonzero((at[1:] == at[:-1]) & (ends[1:] > ends[:-1] if ends is not None else ranks[1:] > ranks[:-1]))
            k = at[steps]
            seen[k[np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else k]] += 1
            left = steps - begins[k] + 1
            good = (left >= op.min_leaf) & (n[k] - left >= op.min_leaf)
            steps, k = steps[good], k[good]
            if not len(steps):
                continue
            b = begins[k]
            sums = np.cumsum(drawn.take(own))
            inside = sums[steps] - np.where(b > 0, sums[b - 1], 0)
            l0, l1 = inside & half, inside >> 32
            score = purity(l0, l1, t0[k] - l0, t1[k] - l1, weights)
            cuts = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            most = np.repeat(np.maximum.reduceat(score, cuts), np.diff(np.append(cuts, len(k))))
            tops = np.flatnonzero(score == most)
            tops = tops[np.append(True, k[tops][1:] != k[tops][:-1])]
            tops = tops[score[tops] > best[k[tops]]]
            which, step = k[tops], steps[tops]
            best[which], feature[which] = score[tops], tried[which]
            below = rows[own[step]]
            cut[which] = places[tried[which], below]
            threshold[which] = between(x[below, tried[which]], x[rows[own[step + 1]], tried[which]])
        split = np.flatnonzero(feature >= 0)
        low, high = np.zeros(m, np.int64), np.zeros(m, np.int64)
        low[split] = total + 2 * np.arange(len(split))
        high[split] = low[split] + 1
        levels.append((feature, threshold, low, high, value))
        goes = feature[node] >= 0
        rows, node = rows[goes], node[goes]
        number = np.zeros(m, np.int64)
        number[split] = 2 * np.arange(len(split))
        node = number[node] + (flat.take(feature[node] * size + rows) > cut[node])
        # Rows lie by node, in their order within it: what a node looks up is then close together.
        if (2 * len(split)).bit_length() + row_bits <= _PACKED_BITS:
            packed = (node << row_bits) | rows
            packed.sort()
            rows, node = packed & ((1 << row_bits) - 1), packed >> row_bits
        total += 2 * len(split)
        keys = np.stack([child_keys(keys[split], 0), child_keys(keys[split], 1)], axis=1).ravel()
    return Piece(*(np.concatenate(c) for c in zip(*levels)))


def _piece_batch(tree: int, number: int, piece: Piece) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *(pa.list_(k) for k in (pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64()))]
    row = [tree, number, piece.feature, piece.threshold, piece.low, piece.high, piece.value]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [c.split()[0] for c in _PIECE.split(", ")])


# --- prediction --------------------------------------------------------------------------------------------------------------

@dataclass
class Nodes:
    """All pieces of some trees in one set of arrays, and where each tree begins."""

    roots: np.ndarray
    nodes: Piece

    @classmethod
    def walkable(cls, roots: np.ndarray, feature: np.ndarray, threshold: np.ndarray, low: np.ndarray, value: np.ndarray) -> "Nodes":
        """A leaf leads to itself, a node continued elsewhere to where; the high child always follows the low one."""
        ends = np.flatnonzero(feature == LEAF)
        low = low.astype(np.int32 if len(feature) < 2**31 else np.int64)
        low[ends] = ends
        return cls(roots, Piece(feature, np.where(feature < 0, np.inf, threshold), low, low, value))

    @classmethod
    def of(cls, rows: list) -> "Nodes":
        kinds = [pa.int32(), pa.int32(), *(pa.list_(k) for k in (pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64()))]
        names = [c.split()[0] for c in _PIECE.split(", ")]
        return cls.of_table(pa.table([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds)], names))

    @classmethod
    def of_table(cls, pieces: pa.Table) -> "Nodes":
        """From the pieces as an Arrow table: the lists of numbers are taken as they lie, not one by one."""
        pieces = pieces.sort_by([("tree", "ascending"), ("piece", "ascending")]).combine_chunks()
        tree, piece = (pieces.column(c).to_numpy().astype(np.int64) for c in ("tree", "piece"))
        lists = [pa.concat_arrays(pieces.column(c).chunks) for c in ("feature", "threshold", "low", "high", "value")]
        sizes = np.diff(lists[0].offsets.to_numpy())
        starts = np.cumsum(sizes) - sizes
        feature, threshold, low, _, value = (c.flatten().to_numpy(zero_copy_only=False) for c in lists)
        feature, begin = feature.astype(np.int8 if feature.max() < 128 else np.int32), np.repeat(starts, sizes)
        onward = np.flatnonzero(feature == CONTINUED)
        # A piece's place: pieces are sorted by (tree, piece).
        span = int(max(piece.max(), low[onward].max(initial=0))) + 1
        goes = starts[np.searchsorted(tree * span + piece, np.repeat(tree, sizes)[onward] * span + low[onward])]
        low = begin + low
        low[onward] = goes
        return cls.walkable(starts[piece == 0], feature, threshold, low, value)

    def leaves(self, x: np.ndarray, root: int) -> np.ndarray:
        """The leaf each row ends in. Some steps are taken between two looks at who has arrived."""
        p, flat, width = self.nodes, np.ascontiguousarray(x).ravel(), x.shape[1]
        at, moving = np.empty(len(x), np.int64), np.arange(len(x))
        begin, now = moving * width, np.full(len(x), root, np.int64)
        while len(moving):
            for _ in range(4):
                now = p.low.take(now) + (flat.take(begin + p.feature.take(now)) > p.threshold.take(now))
            goes = p.low.take(now) != now
            if not goes.all():
                at[moving[~goes]] = now[~goes]
                moving, begin, now = moving[goes], begin[goes], now[goes]
        return at

    def sums(self, x: np.ndarray) -> np.ndarray:
        """The sum over the trees of the share of label 1 in each row's leaf."""
        total = np.zeros(len(x))
        for root in self.roots:
            total += self.nodes.value[self.leaves(x, root)]
        return total


# --- training -------------------------------------------------------------------------------------------------------------------

def _matrix(batch: pa.RecordBatch, features: int) -> np.ndarray:
    column = batch.column("x")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, features)


def _whole_trees(table, features: int, weights: tuple[float, float], op: Forest):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, labels, x = table.value
        places = None
        for batch in batches:
            for tree in batch.column("id").to_pylist():
                times = draws(keys, op.seed, tree)
                drawn = np.flatnonzero(times)
                own, label = times[drawn], labels[drawn]
                places = ranked(x) if places is None else places
                yield _piece_batch(tree, 0, grow(x[drawn], own * (label == 0), own * (label == 1), root_key(op.seed, tree), weights, op, places[:, drawn]))

    return run


@dataclass
class _Top:
    """The upper part of a tree while its large nodes are split: lists that grow, and the keys of the nodes."""

    feature: list[int]
    threshold: list[float]
    low: list[int]
    high: list[int]
    value: list[float]
    keys: list[np.ndarray]

    def add(self, key: np.ndarray) -> int:
        for column, v in ((self.feature, LEAF), (self.threshold, 0.0), (self.low, 0), (self.high, 0), (self.value, 0.0), (self.keys, key)):
            column.append(v)
        return len(self.feature) - 1

    def nodes(self) -> Nodes:
        return Nodes.walkable(np.zeros(1, np.int64), *(np.array(c) for c in (self.feature, self.threshold, self.low, self.value)))


def _counter(tops: dict[int, Nodes], wanted: dict[int, dict[int, int]], cuts: list[np.ndarray], features: int, op: Forest):
    """Rows and draws of each class by node, feature and bin, for nodes of the tops numbered by ``wanted`` (tree -> node -> number)."""
    bins, m = max(len(c) for c in cuts) + 1, sum(len(w) for w in wanted.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((3, m * features * bins))
        for batch in batches:
            x, keys, labels = _matrix(batch, features), batch.column("row").to_numpy(), batch.column("label").to_numpy()
            binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
            for tree, numbers in wanted.items():
                times, at = draws(keys, op.seed, tree), tops[tree].leaves(x, 0)
                number = np.full(len(tops[tree].nodes.feature), -1, np.int64)
                number[list(numbers)] = list(numbers.values())
                own = np.flatnonzero((times > 0) & (number[at] >= 0))
                cells = ((number[at[own]][:, None] * features + np.arange(features)) * bins + binned[own]).ravel()
                label, often = labels[own], times[own]
                for plane, what in enumerate((np.ones(len(own)), often * (label == 0), often * (label == 1))):
                    counts[plane] += np.bincount(cells, np.repeat(what, features), counts.shape[1])
        shaped = counts.reshape(3, m, -1).astype(np.int64)
        for number in np.flatnonzero(shaped[0].any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([int(number)], pa.int32()), pa.array([shaped[:, number].tobytes()], pa.binary())], ["number", "counts"])

    return run


_SPLIT = "number int, feature int, threshold double, value double, low_rows bigint, high_rows bigint"


def _chooser(keys: np.ndarray, cuts: list[np.ndarray], weights: tuple[float, float], op: Forest):
    """Adds the counts of a node up and chooses its split among the edges of the bins."""
    features, bins = len(cuts), max(len(c) for c in cuts) + 1
    tries = op.tries or max(1, int(np.sqrt(features)))

    def choose(number: int, counts: np.ndarray) -> tuple:
        n, c0, c1 = counts.reshape(3, features, bins)
        rows, t0, t1 = int(n[0].sum()), int(c0[0].sum()), int(c1[0].sum())
        value = weights[1] * t1 / (weights[0] * t0 + weights[1] * t1)
        best, found, seen = -np.inf, (LEAF, 0.0, 0, 0), 0
        if t0 and t1 and rows >= 2 * op.min_leaf:
            for f in feature_order(keys[number : number + 1], features)[0]:
                if seen >= tries and found[0] >= 0:
                    break
                edges = len(cuts[f])
                left, l0, l1 = (np.cumsum(c[f])[:edges] for c in (n, c0, c1))
                seen += bool(((left > 0) & (left < rows)).any())
                good = np.flatnonzero((left >= op.min_leaf) & (rows - left >= op.min_leaf))
                if len(good):
                    score = purity(l0[good], l1[good], t0 - l0[good], t1 - l1[good], weights)
                    top = good[int(score.argmax())]
                    if score.max() > best:
                        best, found = score.max(), (int(f), float(cuts[f][top]), int(left[top]), rows - int(left[top]))
        return number, found[0], found[1], value, found[2], found[3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, counts in zip(batch.column("number").to_pylist(), batch.column("counts").to_pylist()):
                totals[number] = totals.get(number, 0) + np.frombuffer(counts, np.int64)
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
        if totals:
            rows = zip(*(choose(number, counts) for number, counts in totals.items()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], [c.split()[0] for c in _SPLIT.split(", ")])

    return run


def _split_large(rows: DataFrame, trees: range, n: int, cuts: list[np.ndarray], weights: tuple[float, float], op: Forest) -> dict[int, tuple[_Top, list[int]]]:
    """The tops of the trees, with the nodes that are handed off."""
    tops = {tree: _Top([], [], [], [], [], []) for tree in trees}
    handed: dict[int, list[int]] = {tree: [] for tree in trees}
    frontier = [(tree, tops[tree].add(root_key(op.seed, tree))) for tree in trees]
    if n <= op.small_rows:
        return {tree: (tops[tree], [0]) for tree in trees}
    while frontier:
        following = []
        for start in range(0, len(frontier), op.group):
            group = frontier[start : start + op.group]
            wanted: dict[int, dict[int, int]] = {}
            for number, (tree, node) in enumerate(group):
                wanted.setdefault(tree, {})[node] = number
            keys = np.concatenate([tops[tree].keys[node] for tree, node in group])
            counted = rows.mapInArrow(_counter({tree: tops[tree].nodes() for tree in wanted}, wanted, cuts, len(cuts), op), "number int, counts binary")
            # One short row for each large node.
            for number, feature, threshold, value, low, high in counted.repartition("number").mapInArrow(_chooser(keys, cuts, weights, op), _SPLIT).collect():
                tree, node = group[number]
                top = tops[tree]
                top.value[node] = value
                if feature < 0:
                    # Bins can be too coarse where exact thresholds are not.
                    if min(value, 1 - value) > 0:
                        handed[tree].append(node)
                    continue
                top.feature[node], top.threshold[node] = feature, threshold
                for side, size in enumerate((low, high)):
                    child = top.add(child_keys(top.keys[node], side))
                    (top.low if side == 0 else top.high)[node] = child
                    if size > op.small_rows:
                        following.append((tree, child))
                    else:
                        handed[tree].append(child)
        frontier = following
    return {tree: (tops[tree], handed[tree]) for tree in trees}


def _hand_off(rows: DataFrame, grown: dict[int, tuple[_Top, list[int]]], features: int, weights: tuple[float, float], op: Forest) -> DataFrame:
    """The subtrees of small nodes, each grown in the task that its rows are brought to."""
    routes = {tree: (top.nodes(), {node: i + 1 for i, node in enumerate(handed)}) for tree, (top, handed) in grown.items()}
    keys = {(tree, i + 1): top.keys[node] for tree, (top, handed) in grown.items() for i, node in enumerate(handed)}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, row_keys = _matrix(batch, features), batch.column("row").to_numpy()
            for tree, (nodes, numbers) in routes.items():
                times, at = draws(row_keys, op.seed, tree), nodes.leaves(x, 0)
                number = np.zeros(len(nodes.nodes.feature), np.int32)
                number[list(numbers)] = list(numbers.values())
                own = np.flatnonzero((times > 0) & (number[at] > 0))
                take = pa.array(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), tree, np.int32)), pa.array(number[at[own]]), pa.array(times[own].astype(np.int32)), batch.column("label").take(take), batch.column("x").take(take)],
                    ["tree", "piece", "times", "label", "x"],
                )

    def finish(group: pa.Table) -> pa.Table:
        batch = group.combine_chunks().to_batches()[0]
        tree, piece = batch.column("tree")[0].as_py(), batch.column("piece")[0].as_py()
        times, labels = batch.column("times").to_numpy().astype(np.int64), batch.column("label").to_numpy()
        grown_piece = grow(_matrix(batch, features), times * (labels == 0), times * (labels == 1), keys[tree, piece], weights, op)
        return pa.Table.from_batches([_piece_batch(tree, piece, grown_piece)])

    sent = rows.mapInArrow(send, "tree int, piece int, times int, label int, x array<double>")
    return sent.groupBy("tree", "piece").applyInArrow(finish, _PIECE)


def _top_rows(spark: SparkSession, grown: dict[int, tuple[_Top, list[int]]]) -> DataFrame:
    rows = []
    for tree, (top, handed) in grown.items():
        for i, node in enumerate(handed):
            top.feature[node], top.low[node] = CONTINUED, i + 1
        rows.append((tree, 0, top.feature, [float(v) for v in top.threshold], top.low, top.high, [float(v) for v in top.value]))
    return spark.createDataFrame(rows, _PIECE)


def train(rows: DataFrame, class_weights: tuple[float, float], op: Forest = Forest(), broadcast_bytes: int = 256 << 20) -> DataFrame:
    """The pieces of a forest, stored, from ``rows`` (row bigint, label int, x array<double>) that are stored themselves.

    ``row`` identifies a row; x has one length and neither null nor NaN. Weights multiply the draws of each class. Tables of up to
    ``broadcast_bytes``, eight a number, are broadcast; a task that grows a tree takes about three times as much memory.
    """
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "forest")
    n, features = rows.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if n * (features + 2) * 8 <= broadcast_bytes:
        table = rows.orderBy("row").toArrow().combine_chunks().to_batches()[0]
        held = spark.sparkContext.broadcast((table.column("row").to_numpy(), table.column("label").to_numpy(), _matrix(table, features).copy()))
        tasks = min(op.trees, 4 * spark.sparkContext.defaultParallelism)
        spark.range(0, op.trees, 1, tasks).mapInArrow(_whole_trees(held, features, class_weights, op), _PIECE).write.parquet(path)
        return spark.read.schema(_PIECE).parquet(path)
    # The upper parts of the trees stay within some ten thousand nodes each, whatever the number of rows.
    op = replace(op, small_rows=max(op.small_rows, n // 10_000))
    shares = [i / op.bins for i in range(1, op.bins)]
    edges = rows.agg(*[F.percentile_approx(F.col("x")[f], shares, 10_000).alias(f"f{f}") for f in range(features)]).first()
    # An edge is the largest value of its bin; the greatest value of all needs none.
    cuts = [np.unique(np.array(e, np.float64)) for e in edges]
    for start in range(0, op.trees, op.block):
        grown = _split_large(rows, range(start, min(op.trees, start + op.block)), n, cuts, class_weights, op)
        _hand_off(rows, grown, features, class_weights, op).write.mode("append").parquet(path)
        _top_rows(spark, grown).write.mode("append").parquet(path)
    return spark.read.schema(_PIECE).parquet(path)


def probabilities(rows: DataFrame, pieces: DataFrame, trees: int, key: str, block_nodes: int = 8_000_000) -> DataFrame:
    """``(key, probability)`` of label 1 for rows (key, x): the mean over the trees.

    Trees are broadcast in blocks of about ``block_nodes`` nodes (25 bytes each), or one tree; the sums of several blocks are added.
    """
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "scored-rows")
    # Each block of trees reads the rows again, so what they come from is read once; the number tells rows of one key apart.
    rows = rows.select(key, "x", F.monotonically_increasing_id().alias("_row"))
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    sizes = pieces.groupBy("tree").agg(F.sum(F.size("feature")).alias("nodes")).orderBy("tree").collect()  # one row a tree
    blocks, total = [[]], 0
    for tree, nodes in sizes:
        if blocks[-1] and total + nodes > block_nodes:
            blocks.append([])
            total = 0
        blocks[-1].append(tree)
        total += nodes
    kind = rows.schema[key].dataType.simpleString()

    def scorer(held) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = _matrix(batch, len(batch.column("x").flatten()) // batch.num_rows)
                    yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("_row"), pa.array(held.value.sums(x))], [key, "_row", "total"])

        return run

    parts = None
    for number, block in enumerate(blocks):
        held = spark.sparkContext.broadcast(Nodes.of_table(pieces.where(F.col("tree").isin(block)).toArrow()))
        part = rows.mapInArrow(scorer(held), f"{key} {kind}, _row bigint, total double").withColumn("_block", F.lit(number))
        parts = part if parts is None else parts.unionByName(part)
    if len(blocks) > 1:
        # Added in the order of the blocks: one forest gives one sum, to the last digit.
        ordered = F.array_sort(F.collect_list(F.struct("_block", "total")))
        parts = parts.groupBy(key, "_row").agg(F.aggregate(ordered, F.lit(0.0), lambda s, t: s + t["total"]).alias("total"))
    return parts.select(key, (F.col("total") / trees).alias("probability"))
