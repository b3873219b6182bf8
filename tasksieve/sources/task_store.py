"""Tasks by id: sorted files in small row groups, so that a few ids read about as many row groups, however large the store."""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from tasksieve.schema import TASK, TASK_FIELDS
from tasksieve.sources.runs import Kind, SortedRuns

#: Spark hands a filter on up to ten values to the files as those values, beyond that as a range.
_IDS_A_FILTER = 10


class TaskStore:
    """``row_group_bytes``: of texts in a row group; further settings are those of ``SortedRuns``."""

    def __init__(self, spark: SparkSession, path: str, row_group_bytes: int = 4 << 20, file_rows: int = 100_000, **run_settings: float) -> None:
        self.spark = spark
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in TASK.fields)
        options = {"parquet.block.size": str(row_group_bytes), "parquet.block.row.check.min": "8", "parquet.page.size.row.check.min": "8"}
        self.runs = SortedRuns(spark, path, {"tasks": Kind(schema, ("task_id",), options=options)}, file_rows=file_rows, **run_settings)

    def add(self, tasks: DataFrame) -> None:
        """Stores the tasks whose ids are not stored yet; ids within ``tasks`` are distinct."""
        self.runs.compact()
        base = self.runs.manifest()
        known = self.runs.read(base, "tasks").select("task_id")
        fresh = tasks.select(*TASK_FIELDS).join(known, "task_id", "left_anti") if base.runs else tasks.select(*TASK_FIELDS)
        run = self.runs.new_run()
        self.runs.add_files(run, "tasks", fresh, math.ceil(max(1, tasks.count()) / self.runs.file_rows))
        if run["files"]["tasks"]:
            self.runs.commit(base, [*base.runs, run], base.marks, base.retired)

    def lookup(self, ids: list[str]) -> DataFrame:
        """The tasks of some ids, from the files whose range has one and of these from the row groups whose range has one.

        Meant for what a report or a queue shows: the plan has one scan for each ten ids of a file.
        """
        found = self.runs.paths(self.runs.manifest(), "tasks", sorted(set(ids)))
        kind = self.runs.kinds["tasks"]
        parts = [
            self.spark.read.schema(kind.schema).parquet(path).where(F.col("task_id").isin(own[i : i + _IDS_A_FILTER]))
            for path, own in found.items() for i in range(0, len(own), _IDS_A_FILTER)
        ]
        return functools.reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], kind.schema)
