"""From JSON lines to audited, split task tables on disk."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tasksieve.operators import curation, splits
from tasksieve.sources.jsonl import load_tasks


def curate(
    spark: SparkSession,
    source: str,
    target: str,
    seed: int = 2026,
    train_fraction: float = 0.70,
    validation_fraction: float = 0.15,
    phrases: tuple[str, ...] = curation.VAGUE_PHRASES,
    strict: bool = False,
) -> dict[str, str]:
    """Write ``tasks`` (partitioned by split), ``quarantine``, ``issues``, ``report``, ``fingerprint``, ``manifest``,
    ``group_leakage`` and ``spec_leakage`` under ``target``; returns their paths.

    The loader has parsed the JSON into Parquet, of which every later step reads only the columns it needs. ``strict``
    raises on a bad row and on leakage.
    """
    paths = {
        name: f"{target.rstrip('/')}/{name}" for name in (
            "tasks", "quarantine", "issues", "report", "fingerprint", "manifest", "group_leakage", "spec_leakage",
        )
    }
    loaded = load_tasks(spark, source, strict)
    parsed = loaded.tasks
    loaded.quarantine.write.mode("overwrite").parquet(paths["quarantine"])

    curation.curation_issues(parsed, phrases).write.mode("overwrite").parquet(paths["issues"])
    curation.curation_report(parsed, phrases).write.mode("overwrite").json(paths["report"])
    curation.dataset_fingerprint(parsed).write.mode("overwrite").json(paths["fingerprint"])

    divided = splits.make_splits(parsed, seed, train_fraction, validation_fraction, strict)
    splits.write_splits(divided, paths["tasks"])
    stored = spark.read.parquet(paths["tasks"])
    splits.split_manifest(stored, seed).write.mode("overwrite").parquet(paths["manifest"])
    splits.group_leakage(stored).write.mode("overwrite").parquet(paths["group_leakage"])
    splits.spec_leakage(stored).write.mode("overwrite").parquet(paths["spec_leakage"])
    return paths
