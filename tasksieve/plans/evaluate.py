"""From model outputs and run logs to suite reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tasksieve.operators import contracts, mutation


def evaluate(
    spark: SparkSession,
    outputs: DataFrame,
    mutants: DataFrame,
    runs: DataFrame,
    target: str,
    timeout_seconds: float | None = mutation.TIMEOUT_SECONDS,
) -> dict[str, str]:
    """Write ``suites`` (parsed outputs), ``reports`` and ``mutants`` (JSON lines a suite and a mutant) under ``target``.

    ``mutants`` are those of ``contracts.task_mutants``. Several outputs of a task need ``output_id`` in ``outputs`` and ``runs``. ``runs`` holds the reference program's rows under the program id ``reference`` and the mutants' under their ids.
    """
    mutation.check_timeout(timeout_seconds)
    paths = {name: f"{target.rstrip('/')}/{name}" for name in ("suites", "reports", "mutants")}
    contracts.parse_suites(outputs).write.mode("overwrite").parquet(paths["suites"])
    suites = spark.read.parquet(paths["suites"])
    inputs = (
        suites, contracts.suite_cases(suites), mutants,
        runs.where(runs.program_id == mutation.REFERENCE), runs.where(runs.program_id != mutation.REFERENCE),
        timeout_seconds,
    )
    mutation.write_reports(mutation.score_outputs(*inputs), paths["reports"])
    mutation.write_reports(mutation.mutant_reports(*inputs), paths["mutants"])
    return paths
