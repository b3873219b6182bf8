"""The forest against a plain recursive learner over the same draws, in one task and with nodes split and handed off by Spark."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tasksieve.operators import forest
from tasksieve.operators.forest import Forest, draws, feature_order, root_key


def table(n, seed, features=6, levels=None):
    draw = np.random.default_rng(seed)
    x = draw.standard_normal((n, features))
    x = np.round(x * levels) / levels if levels else x
    x[:, features - 1] = 1.0  # never varies
    label = ((x[:, 0] + x[:, 1] * x[:, 2] + 0.5 * draw.standard_normal(n)) > 0.3).astype(int)
    keys = draw.integers(-(2**63), 2**63 - 1, n)
    return keys, label, x


def plainly(x, n0, n1, key, weights, min_leaf, tries):
    """One node after the other; returns ("leaf", value) or (feature, threshold, low, high)."""
    t0, t1, n = int(n0.sum()), int(n1.sum()), len(x)
    leaf = ("leaf", weights[1] * t1 / (weights[0] * t0 + weights[1] * t1))
    if not t0 or not t1 or n < 2 * min_leaf:
        return leaf
    best, seen = None, 0
    for f in feature_order(key, x.shape[1])[0]:
        if seen >= tries and best:
            break
        values = sorted(set(x[:, f]))
        seen += len(values) > 1
        for a, b in zip(values, values[1:]):
            low = x[:, f] <= a
            if min(low.sum(), n - low.sum()) < min_leaf:
                continue
            p, q, r, s = (float(v) for v in (n0[low].sum() * weights[0], n1[low].sum() * weights[1], n0[~low].sum() * weights[0], n1[~low].sum() * weights[1]))
            score = (p * p + q * q) / (p + q) + (r * r + s * s) / (r + s)
            if best is None or score > best[0]:
                middle = a / 2 + b / 2
                best = (score, f, middle if middle < b else a, low)
    if not best:
        return leaf
    _, f, threshold, low = best
    parts = [plainly(x[side], n0[side], n1[side], forest.child_keys(key, i), weights, min_leaf, tries) for i, side in enumerate((low, ~low))]
    return int(f), float(threshold), *parts


def as_tree(piece, at=0):
    if piece.feature[at] < 0:
        return "leaf", piece.value[at]
    return int(piece.feature[at]), float(piece.threshold[at]), as_tree(piece, piece.low[at]), as_tree(piece, piece.high[at])


def answer(tree, row):
    while tree[0] != "leaf":
        tree = tree[3] if row[tree[0]] > tree[1] else tree[2]
    return tree[1]


def expected(keys, label, x, weights, op):
    tries = op.tries or max(1, int(x.shape[1] ** 0.5))
    for tree in range(op.trees):
        times = draws(keys, op.seed, tree)
        own = times > 0
        yield plainly(x[own], (times * (label == 0))[own], (times * (label == 1))[own], root_key(op.seed, tree), weights, op.min_leaf, tries)


@pytest.mark.parametrize("n,levels,min_leaf", [(9, None, 1), (60, 2, 1), (400, None, 2), (1000, 8, 2), (1000, None, 5)])
def test_trees_equal_those_of_a_plain_learner(n, levels, min_leaf):
    keys, label, x = table(n, n, levels=levels)
    op, weights = Forest(trees=3, min_leaf=min_leaf), (0.7, 1.9)
    for tree, want in enumerate(expected(keys, label, x, weights, op)):
        times = draws(keys, op.seed, tree)
        own = times > 0
        got = forest.grow(x[own], (times * (label == 0))[own], (times * (label == 1))[own], root_key(op.seed, tree), weights, op)
        assert as_tree(got) == want


def test_draws_are_poisson_numbers():
    times = draws(np.arange(200_000), 1, 2)
    assert np.bincount(times, minlength=5)[:4] / 200_000 == pytest.approx([np.exp(-1), np.exp(-1), np.exp(-1) / 2, np.exp(-1) / 6], abs=0.005)
    assert (times != draws(np.arange(200_000), 1, 3)).mean() > 0.4


def rows_of(spark, keys, label, x, path):
    rows = [(int(k), int(y), [float(v) for v in r]) for k, y, r in zip(keys, label, x)]
    spark.createDataFrame(rows, "row long, label int, x array<double>").write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("small_rows,block,group", [(5000, 3, 4), (60, 2, 3), (5, 5, 1000)])
def test_nodes_split_and_handed_off_give_the_same_trees(spark, tmp_path, small_rows, block, group):
    """With a bin for each row, histograms choose the splits of exact thresholds: drawn rows end in equal leaves."""
    keys, label, x = table(700, 3, levels=5)
    op, weights = Forest(trees=5, bins=1500, small_rows=small_rows, block=block, group=group), (1.0, 1.5)
    rows = rows_of(spark, keys, label, x, str(tmp_path / "rows"))
    pieces = forest.train(rows, weights, op, broadcast_bytes=0)
    nodes = forest.Nodes.of(pieces.collect())
    for tree, want in enumerate(expected(keys, label, x, weights, op)):
        drawn = draws(keys, op.seed, tree) > 0
        got = nodes.nodes.value[nodes.leaves(x[drawn], nodes.roots[tree])]
        assert got == pytest.approx([answer(want, row) for row in x[drawn]], abs=1e-12)
    found = {r["row"]: r["probability"] for r in forest.probabilities(rows, pieces, op.trees, "row", block_nodes=100).collect()}
    assert [found[int(k)] for k in keys] == pytest.approx(nodes.sums(x) / op.trees, abs=1e-12)
    if small_rows == 60:
        assert pieces.groupBy("tree").agg(F.max("piece").alias("p")).agg(F.min("p")).first()[0] > 5


def test_coarse_bins_still_end_in_pure_leaves(spark, tmp_path):
    keys, label, x = table(3000, 9)
    op = Forest(trees=4, bins=4, small_rows=200, min_leaf=1)
    pieces = forest.train(rows_of(spark, keys, label, x, str(tmp_path / "rows")), (1.0, 1.0), op, broadcast_bytes=0).collect()
    nodes = forest.Nodes.of(pieces)
    for tree, root in enumerate(nodes.roots):
        drawn = draws(keys, op.seed, tree) > 0
        value = nodes.nodes.value[nodes.leaves(x[drawn], root)]
        assert (value == label[drawn]).all()


def test_broadcast_table_and_handed_off_nodes_agree(spark, tmp_path):
    keys, label, x = table(300, 4)
    rows, op = rows_of(spark, keys, label, x, str(tmp_path / "rows")), Forest(trees=6)
    whole, handed = (forest.probabilities(rows, forest.train(rows, (1.0, 2.0), op, broadcast_bytes=b), 6, "row").collect() for b in (1 << 20, 0))
    assert sorted(map(tuple, whole)) == sorted(map(tuple, handed))


def test_several_blocks_of_trees_read_the_rows_from_a_table_and_keep_rows_of_one_key_apart(spark, tmp_path):
    keys, label, x = table(300, 6)
    rows, op = rows_of(spark, keys, label, x, str(tmp_path / "rows")), Forest(trees=6)
    pieces = forest.train(rows, (1.0, 2.0), op)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    twice = rows.unionByName(rows).mapInArrow(counted, rows.schema)
    found = forest.probabilities(twice, pieces, op.trees, "row", block_nodes=1).collect()
    want = {int(k): p for k, p in zip(keys, forest.Nodes.of_table(pieces.toArrow()).sums(x) / op.trees)}
    assert read.value == 600 and len(found) == 600
    assert all(r["probability"] == want[r["row"]] for r in found)


def test_nodes_sort_the_same_without_room_for_packed_numbers(monkeypatch):
    keys, label, x = table(500, 8, levels=6)
    times = draws(keys, 1, 0)
    own = times > 0
    grow = lambda: forest.grow(x[own], (times * (label == 0))[own], (times * (label == 1))[own], root_key(1, 0), (1.0, 1.3), Forest())
    packed = grow()
    monkeypatch.setattr(forest, "_PACKED_BITS", 0)
    assert all((getattr(packed, c) == getattr(grow(), c)).all() for c in ("feature", "threshold", "low", "high", "value"))


def test_trees_grow_the_same_from_places_among_more_rows():
    keys, label, x = table(600, 12, levels=4)
    times = draws(keys, 1, 0)
    own = np.flatnonzero(times)
    n0, n1 = (times * (label == 0))[own], (times * (label == 1))[own]
    alone, given = (forest.grow(x[own], n0, n1, root_key(1, 0), (1.0, 1.3), Forest(), p) for p in (None, forest.ranked(x)[:, own]))
    assert all((getattr(alone, c) == getattr(given, c)).all() for c in ("feature", "threshold", "low", "high", "value"))


def test_a_table_of_some_hundred_thousand_rows_is_grown_whole(spark, tmp_path, monkeypatch):
    """To hand nodes off costs several times as much: each tree's rows are shuffled and looked through for each level."""
    monkeypatch.setattr(forest, "_split_large", None)
    spark.range(300_000).select(
        F.col("id").alias("row"), (F.col("id") % 3 == 0).cast("int").alias("label"), F.array(*[(F.col("id") % (f + 2)).cast("double") for f in range(13)]).alias("x")
    ).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    pieces = forest.train(rows, (1.0, 1.0), Forest(trees=2, min_leaf=60_000)).collect()
    assert [p.tree for p in sorted(pieces)] == [0, 1] and all(p.piece == 0 and len(p.feature) > 1 for p in pieces)
