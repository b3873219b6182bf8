"""Review-risk detector: a random forest over the source features, trained on review outcomes."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tasksieve.operators import forest
from tasksieve.operators.features import FEATURES, extract_features
from tasksieve.session import scratch_path


def detector_labels(tasks: DataFrame) -> DataFrame:
    """task_id, label of the reviewed tasks: 0 accepted, 1 revised or rejected."""
    return tasks.where(F.col("review_status") != "unreviewed").select(
        "task_id", (F.col("review_status") != "accepted").cast("int").alias("label")
    )


def class_weights(labels: DataFrame) -> DataFrame:
    """label, n, weight with weight = total / (2 n): both classes weigh the same in training."""
    counts = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("label", "n", (total / (F.lit(2) * F.col("n"))).cast("double").alias("weight"))


def _vector() -> Column:
    """The features in sorted name order; a missing one is 0."""
    return F.array(*[F.coalesce(F.col(name), F.lit(0.0)) for name in sorted(FEATURES)]).alias("x")


def measured(tasks: DataFrame) -> DataFrame:
    """task_id, review_status and the features ``x``, stored: what ``fit`` and ``predict_review_risk`` take in place of tasks,
    where both are to read the texts only once."""
    path = scratch_path(tasks.sparkSession, "measured-tasks")
    extract_features(tasks, "review_status").select("task_id", "review_status", _vector()).write.parquet(path)
    return tasks.sparkSession.read.parquet(path)


class ReviewDetector:
    """fit / predict_review_risk / save / load around a random forest whose trees have no depth limit.

    ``settings`` are further ones of ``forest.Forest``. Rows are drawn by a hash of task_id, so one seed gives one model
    whatever the partitions.
    """

    def __init__(self, num_trees: int = 300, seed: int = 2026, **settings: int) -> None:
        self.forest = forest.Forest(trees=num_trees, seed=seed, **settings)
        self.pieces: DataFrame | None = None

    def fit(self, tasks: DataFrame) -> "ReviewDetector":
        reviewed = tasks.where(F.col("review_status") != "unreviewed")
        label = (F.col("review_status") != "accepted").cast("int")
        # The texts are read once, for a table of numbers.
        path = scratch_path(tasks.sparkSession, "training-rows")
        vectors = reviewed if "x" in tasks.columns else extract_features(reviewed, "review_status").select("task_id", "review_status", _vector())
        vectors.select(F.xxhash64("task_id").alias("row"), label.alias("label"), "x").write.parquet(path)
        rows = tasks.sparkSession.read.parquet(path)
        found = {row.label: row.n for row in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows at most
        total = sum(found.values())
        if total < 8:
            raise ValueError(f"{total} reviewed tasks are too few to learn from, 8 is the least")
        if len(found) != 2:
            raise ValueError("all reviewed tasks have the same outcome")
        self.pieces = forest.train(rows, (total / (2 * found[0]), total / (2 * found[1])), self.forest)
        return self

    def predict_review_risk(self, tasks: DataFrame) -> DataFrame:
        """task_id, review_risk: the probability that a task will not be accepted as it is."""
        if self.pieces is None:
            raise RuntimeError("call fit or load first")
        rows = tasks.select("task_id", "x") if "x" in tasks.columns else extract_features(tasks).select("task_id", _vector())
        return forest.probabilities(rows, self.pieces, self.forest.trees, "task_id").withColumnRenamed("probability", "review_risk")

    def save(self, path: str) -> str:
        if self.pieces is None:
            raise RuntimeError("nothing to save before fit")
        session = self.pieces.sparkSession
        self.pieces.write.mode("overwrite").parquet(f"{path}/pieces")
        session.createDataFrame([asdict(self.forest)]).coalesce(1).write.mode("overwrite").json(f"{path}/settings")
        return path

    @classmethod
    def load(cls, path: str, session: SparkSession | None = None) -> "ReviewDetector":
        session = session or SparkSession.active()
        settings = session.read.json(f"{path}/settings").first().asDict()
        detector = cls(settings.pop("trees"), settings.pop("seed"), **settings)
        detector.pieces = session.read.parquet(f"{path}/pieces")
        return detector
