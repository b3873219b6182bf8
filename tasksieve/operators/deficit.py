"""Splitting by the sequential deficit rule, group after group, without going through all groups in one task.

Rule: a group goes to train if train lacks at least as many tasks as validation and any at all, else to validation if that lacks any,
else to test. With D what train lacks more than validation and P what both lack together, a group of size s in turn adds s to D where D is
negative and takes s off where it is not, and always takes s off P. So P is a running sum, and D goes through piecewise shifts:

1. As long as D keeps its first sign all groups go one way: a running sum tells which.
2. Then D stays within the largest size met so far. The groups of about ``block_tasks`` tasks are one map of D, a list of intervals with the
   shift of each; neighbouring maps are composed in a tree, the state before each block is found from the root down, and each block
   then follows the rule for itself from the state it has been told.
3. From the first group on before which one of the two lacks nothing (|D| >= P, which no later group changes), a running sum decides again.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tasksieve.session import scratch_path


@dataclass
class Shifts:
    """A map of whole numbers: from ``starts[i]`` up to the next start (at last up to ``end``) x becomes x + shifts[i]."""

    starts: np.ndarray
    shifts: np.ndarray
    end: int

    @classmethod
    def identity(cls, radius: int) -> "Shifts":
        return cls(np.array([-radius], np.int64), np.zeros(1, np.int64), radius + 1)

    def _merged(self) -> "Shifts":
        keep = np.append(True, self.shifts[1:] != self.shifts[:-1])
        return Shifts(self.starts[keep], self.shifts[keep], self.end)

    def after_group(self, size: int) -> "Shifts":
        """One more group: what has become negative grows by its size, all else falls."""
        low, high = self.starts + self.shifts, np.append(self.starts[1:], self.end) + self.shifts
        crosses = (low < 0) & (high > 0)
        starts = np.concatenate([self.starts, -self.shifts[crosses]])
        shifts = np.concatenate([self.shifts, self.shifts[crosses]])
        order = np.argsort(starts, kind="stable")
        starts, shifts = starts[order], shifts[order]
        return Shifts(starts, shifts + np.where(starts + shifts < 0, size, -size), self.end)._merged()

    def then(self, other: "Shifts") -> "Shifts":
        """This map, then another one that is defined on all this one yields."""
        low, high = self.starts + self.shifts, np.append(self.starts[1:], self.end) + self.shifts
        first = np.searchsorted(other.starts, low, side="right") - 1
        last = np.searchsorted(other.starts, high - 1, side="right") - 1
        times = last - first + 1
        own = np.repeat(np.arange(len(low)), times)
        theirs = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + first[own]
        starts = np.maximum(low[own], other.starts[theirs]) - self.shifts[own]
        return Shifts(starts, self.shifts[own] + other.shifts[theirs], self.end)._merged()

    def __call__(self, x: int) -> int:
        return int(x + self.shifts[np.searchsorted(self.starts, x, side="right") - 1])


def block_map(sizes: list[int], radius: int) -> Shifts:
    found = Shifts.identity(radius)
    for size in sizes:
        found = found.after_group(size)
    return found


def follow(sizes: list[int], apart: int, together: int) -> list[tuple[str | None, int, int]]:
    """(split, D, P) for each group in order, before it; the split is None from where one lacks nothing."""
    rows = []
    for size in sizes:
        name = None if abs(apart) >= together else "train" if apart >= 0 else "validation"
        rows.append((name, apart, together))
        apart += -size if apart >= 0 else size
        together -= size
    return rows


_MAP = "block bigint, radius bigint, starts array<bigint>, shifts array<bigint>"
_ENTRY = "block bigint, entry bigint"
_PLACED = "group_id string, n_tasks bigint, split string, x bigint, apart bigint, together bigint"


def _map_row(block: int, radius: int, found: Shifts) -> pa.Table:
    return pa.table({
        "block": pa.array([block], pa.int64()), "radius": pa.array([radius], pa.int64()),
        "starts": pa.array([found.starts], pa.list_(pa.int64())), "shifts": pa.array([found.shifts], pa.list_(pa.int64())),
    })


def _read_maps(rows: pa.Table) -> list[tuple[int, Shifts]]:
    rows = rows.sort_by("block")
    return [
        (block, Shifts(np.array(starts, np.int64), np.array(shifts, np.int64), radius + 1))
        for block, radius, starts, shifts in zip(*(rows.column(c).to_pylist() for c in ("block", "radius", "starts", "shifts")))
    ]


def _make_map(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("rank")
    radius = rows.column("radius")[0].as_py()
    return _map_row(rows.column("block")[0].as_py(), radius, block_map(rows.column("n_tasks").to_pylist(), radius))


def _compose(fan_in: int):
    def run(rows: pa.Table) -> pa.Table:
        maps = _read_maps(rows)
        whole = maps[0][1]
        for _, following in maps[1:]:
            whole = whole.then(following)
        return _map_row(maps[0][0] // fan_in, whole.end - 1, whole)

    return run


def _entries(rows: pa.Table) -> pa.Table:
    """The state before each of a parent's blocks, from the state before the parent."""
    state, blocks, entries = rows.column("entry")[0].as_py(), [], []
    for block, found in _read_maps(rows):
        blocks.append(block)
        entries.append(state)
        state = found(state)
    return pa.table({"block": pa.array(blocks, pa.int64()), "entry": pa.array(entries, pa.int64())})


def _follower(total: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("rank")
        x = rows.column("x").to_pylist()
        placed = follow(rows.column("n_tasks").to_pylist(), rows.column("entry")[0].as_py(), total - x[0])
        return pa.table({
            "group_id": rows.column("group_id"), "n_tasks": rows.column("n_tasks"), "split": pa.array([p[0] for p in placed], pa.string()),
            "x": rows.column("x"), "apart": pa.array([p[1] for p in placed], pa.int64()), "together": pa.array([p[2] for p in placed], pa.int64()),
        })

    return run


def _stored(rows: DataFrame, name: str) -> DataFrame:
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def assign_by_deficit(ranked: DataFrame, targets: tuple[int, int], block_tasks: int = 1 << 16, fan_in: int = 64) -> DataFrame:
    """``(group_id, n_tasks, split)`` from ``ranked`` (group_id, n_tasks, rank from 1, tasks_before); ``targets`` are those of train and validation.

    The first three groups open train, validation and test. The result is that of the sequential rule in the order of the ranks.
    """
    session = ranked.sparkSession
    ranked = _stored(ranked.select("group_id", "n_tasks", "rank", "tasks_before"), "ranked-groups")
    opening = {r["rank"]: r["n_tasks"] for r in ranked.where("rank <= 3").collect()}
    lacks = [targets[0] - opening[1], targets[1] - opening[2]]
    rows = ranked.where("rank > 3").select("group_id", "n_tasks", "rank", (F.col("tasks_before") - sum(opening.values())).alias("x"))
    names = F.array(*[F.lit(n) for n in ("train", "validation", "test")])
    parts = [ranked.where("rank <= 3").select("group_id", "n_tasks", F.element_at(names, F.col("rank").cast("int")).alias("split"))]

    def decided(frame: DataFrame, split) -> None:
        parts.append(frame.select("group_id", "n_tasks", split.alias("split")))

    def finish(frame: DataFrame, at: int, train: int, validation: int) -> DataFrame:
        """One of the two lacks nothing from ``at`` on: what the other lacks is filled, the rest is for test."""
        gone = F.col("x") - at
        decided(frame, F.when((F.lit(train) > 0) & (gone < train), "train").when((F.lit(validation) > 0) & (F.lit(train) <= 0) & (gone < validation), "validation").otherwise("test"))
        first, *others = parts
        for other in others:
            first = first.unionByName(other)
        return first

    if min(lacks) <= 0:
        return finish(rows, 0, *lacks)
    apart, together = lacks[0] - lacks[1], sum(lacks)
    straight = F.col("x") <= apart if apart >= 0 else F.col("x") < -apart
    decided(rows.where(straight), F.lit("train" if apart >= 0 else "validation"))
    begin = rows.where(~straight).agg(F.min("x")).first()[0]
    if begin is None:
        return finish(rows.limit(0), 0, 0, 0)
    apart, together = apart - begin if apart >= 0 else apart + begin, together - begin
    rest = rows.where(~straight).withColumn("x", F.col("x") - begin)
    if abs(apart) >= together:
        return finish(rest, 0, (together + apart) // 2, (together - apart) // 2)
    # What lies beyond ``together`` is placed after one of the two is full.
    mixed = rest.where(F.col("x") < together).withColumn("block", F.floor(F.col("x") / block_tasks).cast("bigint"))
    largest = mixed.groupBy("block").agg(F.max("n_tasks").alias("n")).orderBy("block").collect()  # one row for each block_tasks tasks
    radius, radii = abs(apart), []
    for block, n in largest:
        radii.append((block, radius))
        radius = max(radius, n)
    known = session.createDataFrame(radii, "block bigint, radius bigint")
    levels = [_stored(mixed.join(known, "block").groupBy("block").applyInArrow(_make_map, _MAP), "maps")]
    size = len(largest)
    while size > fan_in:
        parent = levels[-1].withColumn("parent", F.floor(F.col("block") / fan_in).cast("bigint"))
        levels.append(_stored(parent.groupBy("parent").applyInArrow(_compose(fan_in), _MAP), "maps"))
        size = levels[-1].count()
    # The root's children start from the state known, the others from what their parents are told.
    entries = levels[-1].withColumn("entry", F.lit(apart).cast("bigint")).groupBy("entry").applyInArrow(_entries, _ENTRY)
    for children in reversed(levels[:-1]):
        told = _stored(entries, "entries").withColumnRenamed("block", "parent")
        owned = children.withColumn("parent", F.floor(F.col("block") / fan_in).cast("bigint")).join(told, "parent")
        entries = owned.groupBy("parent").applyInArrow(_entries, _ENTRY)
    placed = _stored(mixed.join(_stored(entries, "entries"), "block").groupBy("block").applyInArrow(_follower(together), _PLACED), "placed")
    decided(placed.where("split IS NOT NULL"), F.col("split"))
    full = placed.where("split IS NULL").agg(F.min(F.struct("x", "apart", "together")).alias("at")).first()["at"]
    late = placed.where("split IS NULL").select("group_id", "n_tasks", "x").unionByName(rest.where(F.col("x") >= together).select("group_id", "n_tasks", "x"))
    if full is not None:
        return finish(late, full.x, (full.together + full.apart) // 2, (full.together - full.apart) // 2)
    after = placed.agg(F.max(F.struct("x", "n_tasks", "apart", "together")).alias("last")).first()["last"]
    apart = after.apart - after.n_tasks if after.apart >= 0 else after.apart + after.n_tasks
    together = after.together - after.n_tasks
    return finish(late, after.x + after.n_tasks, (together + apart) // 2, (together - apart) // 2)


def deficit_targets(total: int, train_fraction: float, validation_fraction: float) -> tuple[int, int]:
    return max(1, math.floor(total * train_fraction)), max(1, math.floor(total * validation_fraction))
