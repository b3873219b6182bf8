"""From reviewed tasks to a queue of what to review next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tasksieve.operators.detector import ReviewDetector
from tasksieve.operators.review_queue import build_review_queue


def triage(
    spark: SparkSession, tasks: DataFrame, target: str, batch_size: int = 25, detector: ReviewDetector | None = None
) -> dict[str, str]:
    """Train (or take) a detector, score all tasks, write ``detector``, ``scores`` and ``queue`` under ``target``."""
    paths = {name: f"{target.rstrip('/')}/{name}" for name in ("detector", "scores", "queue")}
    detector = detector or ReviewDetector().fit(tasks)
    detector.save(paths["detector"])
    detector.predict_review_risk(tasks).write.mode("overwrite").parquet(paths["scores"])
    queue = build_review_queue(tasks, spark.read.parquet(paths["scores"]), batch_size)
    queue.write.mode("overwrite").json(paths["queue"])
    return paths
