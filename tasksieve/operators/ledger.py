"""Append-only log of review decisions over a register of tasks."""

from __future__ import annotations

import math
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tasksieve.functions.text import is_blank
from tasksieve.operators.contracts import duplicate_keys
from tasksieve.schema import REVIEW_EVENTS, REVIEW_STATUSES
from tasksieve.session import pinned
from tasksieve.sources.jsonl import task_json
from tasksieve.sources.runs import CommitConflict, Kind, Manifest, SortedRuns

PREFIXES = 1 << 16
EVENT_FIELDS = ("event_id", "task_id", "reviewer", "status", "rationale", "created_at")


def new_tasks(batch: DataFrame, stored_ids: DataFrame) -> DataFrame:
    """Rows of the batch whose task_id is not stored yet, the first by ``seq`` of each id: task_id, task_json.

    Copies inside the batch go first, before the join with the stored ids shuffles the rest by task_id.
    """
    repeated = pinned(duplicate_keys(batch).select(F.col("task_id").alias("_id"), "first_seen"))
    single = batch.join(repeated, F.col("task_id") == F.col("_id"), "left").where(
        F.col("_id").isNull() | (F.col("seq") == F.col("first_seen"))
    )
    return single.join(stored_ids.select("task_id"), "task_id", "left_anti").select(
        "task_id", task_json().alias("task_json")
    )


def judge_events(events: DataFrame, task_ids: DataFrame) -> DataFrame:
    """The events with ``reject_reason``, NULL for those the log takes. ``task_ids`` must be distinct."""
    known = task_ids.select(F.col("task_id").alias("_known"))

    def empty(name: str):
        return F.coalesce(is_blank(F.col(name)), F.lit(True))

    reason = (
        F.when(empty("reviewer") | empty("rationale"), "missing_reviewer_or_rationale")
        .when(F.col("status") == "unreviewed", "unreviewed_status")
        .when(~F.coalesce(F.col("status").isin(*REVIEW_STATUSES), F.lit(False)), "unknown_status")
        .when(F.col("_known").isNull(), "unknown_task")
        .when(F.col("event_id").isNull(), "missing_event_id")
    )
    return events.join(known, F.col("task_id") == F.col("_known"), "left").select(
        *EVENT_FIELDS, reason.alias("reject_reason")
    )


def accepted_events(judged: DataFrame) -> DataFrame:
    return judged.where("reject_reason IS NULL").select(*EVENT_FIELDS)


def rejected_events(judged: DataFrame) -> DataFrame:
    return judged.where("reject_reason IS NOT NULL")


def review_history(events: DataFrame, task_id: str | None = None) -> DataFrame:
    """Decisions in event order, of one task or of all.

    The sort key ends in event_id, so range partitioning can cut through a task that holds most of the log.
    """
    rows = events if task_id is None else events.where(F.col("task_id") == task_id)
    return rows.select(*EVENT_FIELDS).orderBy("task_id", "event_id")


def first_deliveries(events: DataFrame) -> DataFrame:
    """One row of each event_id: the first by created_at, then by the other fields, whatever the input order."""
    others = [c for c in EVENT_FIELDS if c not in ("event_id", "created_at")]
    return events.groupBy("event_id").agg(F.min(F.struct("created_at", *others)).alias("_first")).select(
        "event_id", "_first.*"
    ).select(*EVENT_FIELDS)


def id_prefix() -> Column:
    """The place of an event_id in the id index: event ids are spread evenly over ``PREFIXES`` of them."""
    return F.pmod(F.xxhash64("event_id"), F.lit(PREFIXES)).cast("int").alias("prefix")


class ReviewLedger:
    """The register ``tasks``, sorted by task_id with a Bloom filter on it, and the one log of batch and stream.

    The log holds every judged event once, with a ``reject_reason`` if it was refused, in runs sorted by task_id: a look-up of one task opens
    at most one file a run, or the files that hold nothing but that task. Beside each run lies its part of the id index, event ids sorted
    by hash prefix: an event_id is stored once, the first delivery wins whatever its other fields say later, and a batch reads
    only the index files whose prefixes its own ids have. Small runs are merged as they pile up (``sources.runs``).

    Events without an id cannot be recognized: each is stored by itself, rejected.
    """

    def __init__(self, spark: SparkSession, path: str, **run_settings: float) -> None:
        self.spark = spark
        self.path = path.rstrip("/")
        fields = REVIEW_EVENTS.simpleString()[len("struct<"):-1].replace(":", " ")
        self.runs = SortedRuns(spark, f"{self.path}/log", {
            "events": Kind(f"{fields}, reject_reason string, batch string", ("task_id", "event_id")),
            "ids": Kind("prefix int, event_id bigint", ("prefix", "event_id")),
        }, **run_settings)

    def tasks(self) -> DataFrame:
        schema = "task_id string, task_json string"
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/tasks")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def judged(self) -> DataFrame:
        """All events of the log: their fields, reject_reason and batch."""
        return self.runs.read(self.runs.manifest(), "events")

    def events(self) -> DataFrame:
        """The accepted decisions, from batches and streams alike."""
        return accepted_events(self.judged())

    def rejects(self) -> DataFrame:
        return rejected_events(self.judged()).select(*EVENT_FIELDS, "reject_reason")

    def import_tasks(self, batch: DataFrame) -> int:
        """Insert the tasks not stored yet; returns how many were inserted."""
        before = self.tasks().count()
        (
            new_tasks(batch, self.tasks().select("task_id")).sortWithinPartitions("task_id").write.mode("append")
            .option("parquet.bloom.filter.enabled#task_id", "true").parquet(f"{self.path}/tasks")
        )
        return self.tasks().count() - before

    def store(self, events: DataFrame, batch: str, attempts: int = 10) -> DataFrame:
        """Judge the events that the log does not hold yet and add them as ``batch``; returns the batch's stored rows.

        ``batch`` is named ``<stream>-<number>``. The last batch of a stream, stored again, changes nothing. Where another
        writer commits meanwhile, the events are compared with its ids too. Merges that are due come first, so the returned
        rows stay readable until the next batch.
        """
        stream = batch.rpartition("-")[0]
        self.runs.compact()
        for _ in range(attempts):
            base = self.runs.manifest()
            if base.marks.get(stream) == batch:
                return self.judged().where(F.col("batch") == batch)
            run = self._run(base, events, batch)
            added = [run] if run["files"].get("events") else []
            try:
                self.runs.commit(base, base.runs + added, base.marks | {stream: batch}, base.retired)
            except CommitConflict:
                self.runs.discard(run)
                continue
            return self.runs.read(base, "events", runs=added)
        raise CommitConflict(f"{batch} was not stored in {attempts} attempts")

    def _known_ids(self, base: Manifest, prefixes: list[int]) -> DataFrame:
        return self.runs.read(base, "ids", keys=prefixes).select("event_id")

    def _run(self, base: Manifest, events: DataFrame, batch: str) -> dict:
        named = first_deliveries(events.where("event_id IS NOT NULL"))
        # Whole numbers below PREFIXES and one count.
        seen = events.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.when(F.col("event_id").isNotNull(), id_prefix())).alias("prefixes")).first()
        run = self.runs.new_run()
        if not seen.n:
            return run
        fresh = named.join(self._known_ids(base, seen.prefixes), "event_id", "left_anti").select(*EVENT_FIELDS)
        judged = judge_events(
            fresh.unionByName(events.where("event_id IS NULL").select(*EVENT_FIELDS)), self.tasks().select("task_id")
        ).withColumn("batch", F.lit(batch))
        self.runs.add_files(run, "events", judged, math.ceil(seen.n / self.runs.file_rows))
        if run["files"]["events"]:
            stored = self.runs.read(base, "events", runs=[run]).where("event_id IS NOT NULL").select(id_prefix(), "event_id")
            self.runs.add_files(run, "ids", stored, math.ceil(seen.n / (8 * self.runs.file_rows)))
        return run

    def record(self, events: DataFrame, strict: bool = False) -> DataFrame:
        """Store the decisions not stored yet; returns the rejected ones as stored. ``strict`` raises on a rejected row,
        storing none.

        Where the column ``event_id`` is missing, events are numbered after the stored ones; a missing ``created_at`` is now (UTC).
        """
        if "event_id" not in events.columns:
            last = max((f["last"] for r in self.runs.manifest().runs for f in r["files"].get("ids", [])), default=0)
            events = events.withColumn("event_id", F.monotonically_increasing_id() + last + 1)
        if "created_at" not in events.columns:
            # A value, not the clock: every reading of the rows sees the same time.
            now = self.spark.range(1).select(F.current_timestamp()).first()[0]
            events = events.withColumn("created_at", F.lit(now))
        if strict:
            bad = rejected_events(judge_events(events, self.tasks().select("task_id"))).take(1)
            if bad and bad[0].reject_reason == "unknown_task":
                raise KeyError(bad[0].task_id)
            if bad:
                raise ValueError(bad[0].reject_reason)
        stored = self.store(events, f"record-{uuid.uuid4().hex}")
        return rejected_events(stored).select(*EVENT_FIELDS, "reject_reason")

    def history(self, task_id: str) -> DataFrame:
        own = self.runs.read(self.runs.manifest(), "events", keys=[task_id])
        return review_history(accepted_events(own), task_id).select("reviewer", "status", "rationale", "created_at")
