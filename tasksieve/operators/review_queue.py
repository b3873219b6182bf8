"""Review queue: the most uncertain unreviewed tasks, one per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tasksieve.sources.task_store import TaskStore


def build_review_queue(
    tasks: DataFrame, predictions: DataFrame, batch_size: int = 25, score: str = "review_risk", texts: TaskStore | None = None
) -> DataFrame:
    """The most uncertain task of each of the ``batch_size`` most uncertain groups, with texts, in queue order.

    Ranking works on (group, distance, order, id, score) only and keeps the minimum per group while aggregating, so a
    group with a third of all tasks sends one row per map task. Texts are read last, for the final ids only: from ``texts``, where given, by
    their index, else by a scan of ``tasks``.
    """
    if batch_size < 1:
        raise ValueError(f"a queue of {batch_size} tasks")
    waiting = tasks.where(F.col("review_status") == "unreviewed").select("task_id", "group_id", "seq")
    scored = waiting.join(predictions.select("task_id", F.col(score).alias("p")), "task_id")
    best = scored.groupBy("group_id").agg(
        F.min(F.struct(F.abs(F.col("p") - 0.5).alias("distance"), "seq", "task_id", "p")).alias("best")
    )
    chosen = (
        best.select(
            F.col("best.task_id").alias("_chosen"), F.col("best.distance").alias("uncertainty_distance"),
            F.col("best.seq").alias("_seq"), F.col("best.p").alias("probability_review_needed"),
        )
        .orderBy("uncertainty_distance", "_seq", "_chosen").limit(batch_size)
    )
    if texts is not None:
        rows = chosen.collect()  # batch_size rows
        tasks = texts.lookup([row["_chosen"] for row in rows])
        chosen = chosen.sparkSession.createDataFrame(rows, chosen.schema)
    return (
        tasks.join(F.broadcast(chosen), F.col("task_id") == F.col("_chosen"))  # batch_size rows
        .select(
            "task_id", "group_id", "probability_review_needed", "specification", "program",
            F.col("source_url").alias("provenance"), "uncertainty_distance", "_seq",
        )
        .orderBy("uncertainty_distance", "_seq", "task_id")
        .drop("uncertainty_distance", "_seq")
    )
