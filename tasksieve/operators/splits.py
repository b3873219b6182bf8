"""Group-aware train/validation/test splits and their leakage checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tasksieve.errors import SplitError
from tasksieve.functions.digests import skew_ready
from tasksieve.functions.text import digest_keys, folded_digest
from tasksieve.operators.deficit import assign_by_deficit, deficit_targets
from tasksieve.schema import SPLIT_NAMES
from tasksieve.session import BROADCAST_BYTES

# Leading hex digits of the order key that name a bucket: 4096 buckets, so each bucket's window stays a small part of
# the groups and the table of bucket totals has at most 4096 rows.
_BUCKET_DIGITS = 3


def group_sizes(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_tasks"))


def check_fractions(train_fraction: float, validation_fraction: float) -> None:
    if not (0 < train_fraction < 1 and 0 < validation_fraction < 1):
        raise SplitError(f"each fraction lies inside (0, 1): {train_fraction}, {validation_fraction}")
    if train_fraction + validation_fraction >= 1:
        raise SplitError("train and validation take everything, nothing is left to test on")


def _ranked_groups(sizes: DataFrame, seed: int) -> DataFrame:
    """Groups in seeded order with their rank and the number of tasks before them.

    A running sum over all groups in one window would be one task; here the groups are summed per bucket of the order
    key, the few bucket totals are accumulated, and each bucket runs its own window from that offset.
    """
    keyed = sizes.withColumn("order_key", F.md5(F.concat(F.lit(f"{seed}:"), "group_id"))).withColumn(
        "bucket", F.substring("order_key", 1, _BUCKET_DIGITS)
    )
    before = W.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        keyed.groupBy("bucket").agg(F.sum("n_tasks").alias("t"), F.count(F.lit(1)).alias("g"))
        .select(
            "bucket",
            F.coalesce(F.sum("t").over(before), F.lit(0)).alias("tasks_before"),
            F.coalesce(F.sum("g").over(before), F.lit(0)).alias("groups_before"),
        )
    )
    inside = W.partitionBy("bucket").orderBy("order_key", "group_id")
    return (
        keyed.join(F.broadcast(offsets), "bucket")  # at most 4096 rows
        .select(
            "group_id", "n_tasks",
            (F.col("groups_before") + F.row_number().over(inside)).alias("rank"),
            (
                F.col("tasks_before")
                + F.coalesce(F.sum("n_tasks").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
            ).alias("tasks_before"),
        )
    )


def assign_groups(
    sizes: DataFrame, seed: int = 2026, train_fraction: float = 0.70, validation_fraction: float = 0.15
) -> DataFrame:
    """group_id, n_tasks, split. The first three groups in seeded order open the three splits; then train is filled
    up to its target, then validation, and test takes the rest.
    """
    check_fractions(train_fraction, validation_fraction)
    ranked = _ranked_groups(sizes, seed)

    def size_at(rank: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("rank") == rank, F.col("n_tasks"))), F.lit(0))

    total = F.sum("n_tasks")
    plan = ranked.agg(F.struct(
        (size_at(1) + size_at(2) + size_at(3)).alias("pinned"),
        (F.greatest(F.lit(1), F.floor(total * F.lit(float(train_fraction)))) - size_at(1)).alias("train_room"),
        (F.greatest(F.lit(1), F.floor(total * F.lit(float(validation_fraction)))) - size_at(2)).alias("validation_room"),
    ).alias("plan")).scalar()
    placed = ranked.select(
        "group_id", "n_tasks", "rank",
        (F.col("tasks_before") - plan["pinned"]).alias("x"),
        plan["train_room"].alias("train_room"), plan["validation_room"].alias("validation_room"),
    )
    to_train = (F.col("rank") > 3) & (F.col("x") < F.col("train_room"))
    filled = placed.where(to_train).agg(F.coalesce(F.sum("n_tasks"), F.lit(0))).scalar()
    split = (
        F.when(F.col("rank") <= 3, F.element_at(F.array(*map(F.lit, SPLIT_NAMES)), F.col("rank").cast("int")))
        .when(to_train, "train")
        .when(F.col("x") - filled < F.col("validation_room"), "validation")
        .otherwise("test")
    )
    return placed.select("group_id", "n_tasks", split.alias("split"))


def assign_groups_in_turn(
    sizes: DataFrame, seed: int = 2026, train_fraction: float = 0.70, validation_fraction: float = 0.15
) -> DataFrame:
    """group_id, n_tasks, split by the sequential rule: each group, in seeded order, to the split that lacks most (``operators.deficit``)."""
    check_fractions(train_fraction, validation_fraction)
    total = sizes.agg(F.sum("n_tasks")).first()[0]
    return assign_by_deficit(_ranked_groups(sizes, seed), deficit_targets(total, train_fraction, validation_fraction))


def make_splits(
    tasks: DataFrame,
    seed: int = 2026,
    train_fraction: float = 0.70,
    validation_fraction: float = 0.15,
    strict: bool = True,
    in_turn: bool = False,
) -> DataFrame:
    """The tasks with a ``split`` column; whole groups only. ``strict`` raises on repeated ids and on leakage.

    Splits are filled one after the other, or, ``in_turn``, by the sequential rule that gives each group to the one that lacks most.
    """
    check_fractions(train_fraction, validation_fraction)
    sizes = group_sizes(tasks)
    facts = sizes.agg(
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum(F.octet_length("group_id") + 32), F.lit(0)).alias("bytes"),
    ).first()
    if facts.groups == 0:
        raise SplitError("there are no tasks to divide")
    if facts.groups < 3:
        raise SplitError(f"{facts.groups} groups cannot fill three splits")
    if strict:
        twice = tasks.groupBy("task_id").count().where("count > 1").take(1)
        if twice:
            raise SplitError(f"more than one row has the task_id {twice[0].task_id}")
    assign = assign_groups_in_turn if in_turn else assign_groups
    owners = assign(sizes, seed, train_fraction, validation_fraction).select("group_id", "split")
    # The table of groups was measured above; a larger one is left to a shuffle join with skew splitting.
    if facts.bytes <= BROADCAST_BYTES:
        owners = F.broadcast(owners)
    result = tasks.join(owners, "group_id").select(*tasks.columns, "split")
    if strict:
        assert_no_leakage(result)
    return result


def group_leakage(split_tasks: DataFrame) -> DataFrame:
    """Groups found in more than one split."""
    return (
        split_tasks.groupBy("group_id").agg(F.min("split").alias("low"), F.max("split").alias("high"))
        .where("low <> high").select("group_id")
    )


def spec_leakage(split_tasks: DataFrame, native: bool = False) -> DataFrame:
    """Tasks whose normalized specification also occurs in another split: task_id, split."""
    keys = digest_keys(
        split_tasks, folded_digest(F.col("specification"), compatibility=True, native=native), "split"
    )
    crossing = (
        keys.groupBy("digest").agg(F.min("split").alias("low"), F.max("split").alias("high"))
        .where("low <> high").select("digest")
    )
    # An inner join with distinct digests: a semi join would be pushed below the shared exchange.
    return keys.join(skew_ready(crossing, "digest"), "digest").select("task_id", "split")


def assert_no_leakage(split_tasks: DataFrame) -> None:
    crossed = group_leakage(split_tasks).take(1)
    if crossed:
        raise SplitError(f"tasks of group {crossed[0].group_id!r} lie in several splits")
    if spec_leakage(split_tasks).take(1):
        raise SplitError("tasks in different splits have the same specification text")


def get_split(split_tasks: DataFrame, name: str) -> DataFrame:
    if name not in SPLIT_NAMES:
        raise ValueError(f"{name!r} is none of {SPLIT_NAMES}")
    return split_tasks.where(F.col("split") == name)


def split_counts(split_tasks: DataFrame) -> DataFrame:
    return split_tasks.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_tasks"), F.count_distinct("group_id").alias("n_groups")
    )


def split_manifest(split_tasks: DataFrame, seed: int = 2026) -> DataFrame:
    """Rows (seed, split, kind, id) with kind ``task`` or ``group``."""
    def rows(kind: str, ids: DataFrame) -> DataFrame:
        return ids.select(F.lit(seed).alias("seed"), "split", F.lit(kind).alias("kind"), "id")

    return rows("task", split_tasks.select("split", F.col("task_id").alias("id"))).unionByName(
        rows("group", split_tasks.select("split", F.col("group_id").alias("id")).distinct())
    )


def write_splits(split_tasks: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Parquet partitioned by split, so that reading one split reads only its files."""
    split_tasks.write.mode(mode).partitionBy("split").parquet(path)
    return path
