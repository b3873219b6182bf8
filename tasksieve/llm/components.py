"""Connected components of a graph given as an edge table, by alternating large-star and small-star rounds.

Each round joins every edge with the smallest neighbour of one end, which is found by a combined aggregation, so a vertex
with a third of all edges is one row per map task before the shuffle, and the joins are left to adaptive skew splitting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tasksieve.llm.stored import stored


def _least_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("low"))


def _round(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Large star: hang the larger neighbours of u below the smallest of u and its neighbours.
    near = both.withColumnRenamed("a", "u").join(_least_neighbour(both), "u").where("b > u")
    large = near.select(F.col("b").alias("a"), F.least("u", "low").alias("b")).distinct()
    # Small star: hang u and its smaller neighbours (all a > b) below the smallest of them.
    small = large.withColumnRenamed("a", "u").join(_least_neighbour(large), "u")
    return small.select(F.when(F.col("b") == F.col("low"), F.col("u")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b")).where("a > b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """``(id, component)`` with the smallest id of its component for each id on an edge ``(a, b)``.

    Loops and repeated edges change nothing; edges with a null end are left out; no edges give no rows.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        now = stored(_round(now), "edges")
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
