"""Suite scores kept up to date while the logs of program runs come in, in any order."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tasksieve.operators import mutation
from tasksieve.session import scratch_path
from tasksieve.sources.runs import CommitConflict, Kind, SortedRuns

_RUN = "case_id string, program_id string, return_code int, stdout string, timed_out boolean, duration_seconds double"
_WRITTEN = {"compression": "zstd"}
#: Up to so many suites of a batch, their runs are found by the files' ranges; beyond that all files are read.
_LISTED = 10_000
#: Up to so many suites, their keys are broadcast.
_BROADCAST = 200_000


class SuiteScores:
    """The runs logged so far, sorted by task, and the scores of the suites in versions, the last of which holds.

    A batch of runs changes the scores of its own suites only: their runs are read again by file ranges, whichever batch they came
    with, so a reference run that comes late makes the mutant runs before it count. ``cases`` and ``mutants`` are the tables of
    ``mutation``; further settings are those of ``SortedRuns``.
    """

    def __init__(
        self, spark: SparkSession, path: str, cases: DataFrame, mutants: DataFrame,
        timeout_seconds: float | None = mutation.TIMEOUT_SECONDS, **run_settings: float,
    ) -> None:
        mutation.check_timeout(timeout_seconds)
        self.spark, self.cases, self.mutants, self.timeout_seconds = spark, cases, mutants, timeout_seconds
        kind = cases.schema["task_id"].dataType.simpleString()
        none = spark.createDataFrame([], f"task_id {kind}, {_RUN}")
        self._columns = self._scored(cases.limit(0), mutants, none).schema
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self._columns.fields)
        self.runs = SortedRuns(spark, path, {
            "runs": Kind(f"task_id {kind}, {_RUN}", ("task_id", "case_id"), options=_WRITTEN),
            "scores": Kind(f"{fields}, version bigint", ("task_id",), self._latest, _WRITTEN),
        }, **run_settings)

    def _scored(self, cases: DataFrame, mutants: DataFrame, runs: DataFrame) -> DataFrame:
        reference = F.col("program_id") == mutation.REFERENCE
        return mutation.suite_scores(cases, mutants, runs.where(reference), runs.where(~reference), self.timeout_seconds)

    @staticmethod
    def _latest(scores: DataFrame) -> DataFrame:
        last = scores.groupBy("task_id").agg(F.max("version").alias("version"))
        return scores.join(last, ["task_id", "version"], "left_semi")

    def store(self, runs: DataFrame, batch: str, attempts: int = 10) -> None:
        """Adds the runs of a batch ``<stream>-<number>`` and scores its suites anew; the last batch of a stream again changes nothing."""
        stream = batch.rpartition("-")[0]
        self.runs.compact()
        for _ in range(attempts):
            base = self.runs.manifest()
            if base.marks.get(stream) == batch:
                return
            run = self._run(base, runs)
            try:
                self.runs.commit(base, base.runs + ([run] if run["files"] else []), base.marks | {stream: batch}, base.retired)
                return
            except CommitConflict:
                self.runs.discard(run)
        raise CommitConflict(f"{batch} was not stored in {attempts} attempts")

    def _run(self, base, rows: DataFrame) -> dict:
        run, names = self.runs.new_run(), [c.split()[0] for c in _RUN.split(", ")]
        given = [F.col(c) if c in rows.columns else F.lit(None).cast(dict(x.split() for x in _RUN.split(", "))[c]).alias(c) for c in names]
        n = rows.count()
        if not n:
            return run
        self.runs.add_files(run, "runs", rows.select("task_id", *given), math.ceil(n / self.runs.file_rows))
        stored, path = self.runs.read(base, "runs", runs=[run]), scratch_path(self.spark, "scored-suites")
        stored.select("task_id").distinct().write.parquet(path)
        touched = self.spark.read.parquet(path)
        suites = touched.count()
        keys = [r.task_id for r in touched.where("task_id IS NOT NULL").collect()] if suites <= _LISTED else None
        own = self.runs.read(base, "runs", keys=keys).unionByName(stored)
        cases, mutants = self.cases, self.mutants
        if own.where(F.col("program_id") == mutation.REFERENCE).isEmpty():
            # No case is valid, and the runs of mutants count for nothing: the suites are still scored as those without a run.
            own, cases = own.limit(0), cases.limit(0)
        # What belongs to other suites is dropped before where that takes no shuffle, else from the scores, a row a suite.
        if suites <= _BROADCAST:
            cases, own, mutants = (t.join(F.broadcast(touched), "task_id", "left_semi") for t in (cases, own, mutants))
        scored = self._scored(cases, mutants, own)
        if suites > _BROADCAST:
            scored = scored.join(touched, "task_id", "left_semi")
        version = F.lit(base.version + 1).cast("bigint").alias("version")
        self.runs.add_files(run, "scores", scored.select("*", version), math.ceil(suites / self.runs.file_rows))
        return run

    def scores(self) -> DataFrame:
        """The score of every suite as ``mutation.suite_scores`` gives it over all runs stored; suites without a run are scored as such."""
        manifest = self.runs.manifest()
        stored = self._latest(self.runs.read(manifest, "scores")).select(*self._columns.names)
        # Which suites have no score is found on their keys; their cases then move only if they are many.
        path = scratch_path(self.spark, "unseen-suites")
        self.cases.select("task_id").distinct().join(stored.select("task_id"), "task_id", "left_anti").write.parquet(path)
        unseen = self.spark.read.parquet(path)
        few, mutants = unseen.count() <= _BROADCAST, self.mutants
        if few:
            unseen = F.broadcast(unseen)
            mutants = mutants.join(unseen, "task_id", "left_semi")
        none = self.spark.createDataFrame([], self.runs.kinds["runs"].schema)
        return stored.unionByName(self._scored(self.cases.join(unseen, "task_id", "left_semi"), mutants, none))

    def start(self, runs: DataFrame, checkpoint: str, name: str = "runs", available_now: bool = True, every: str = "1 minute") -> StreamingQuery:
        """Stores each micro-batch of a stream of runs; ``name`` must differ between streams with checkpoints of their own."""

        def store(batch: DataFrame, number: int) -> None:
            self.store(batch, f"{name}-{number}")

        trigger = {"availableNow": True} if available_now else {"processingTime": every}
        return runs.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**trigger).start()
