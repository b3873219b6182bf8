"""A third of all rows on one key: results stay whole and the hot partition is cut up."""

import pytest
from pyspark.sql import functions as F

from tasksieve.operators import curation, ledger, mutation, review_queue, splits

N = 60_000
SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
}


@pytest.fixture
def small_partitions(spark):
    old = {k: spark.conf.get(k, None) for k in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield
    for key, value in old.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


@pytest.fixture(scope="module")
def hot(spark):
    third = F.col("id") % 3 == 0
    return spark.range(N).select(
        F.md5(F.col("id").cast("string")).alias("task_id"), F.col("id").alias("seq"),
        F.when(third, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 500)).alias("group_id"),
        F.when(third, "Hot  text").otherwise(F.concat(F.lit("text "), F.col("id"))).alias("program"),
        F.when(third, "Hot  text").otherwise(F.concat(F.lit("text "), F.col("id"))).alias("specification"),
        F.lit("unreviewed").alias("review_status"), F.lit("https://x").alias("source_url"),
        F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("split"),
    )


def cut_up(frame):
    rows = frame.collect()
    return rows, "skew=true" in frame._jdf.queryExecution().executedPlan().toString()


def test_copies_of_one_program(hot, small_partitions):
    rows, cut = cut_up(curation.duplicate_programs(hot))
    assert len(rows) == N // 3 - 1 and len({r.canonical_id for r in rows}) == 1
    assert cut


def test_one_specification_in_two_splits(hot, small_partitions):
    rows, cut = cut_up(splits.spec_leakage(hot))
    assert len(rows) == N // 3
    assert cut


def test_decisions_on_one_task(spark, hot, small_partitions):
    one = hot.select("task_id").orderBy("seq").first()[0]
    events = hot.select(
        F.col("seq").alias("event_id"), F.when(F.col("seq") % 3 == 0, one).otherwise(F.col("task_id")).alias("task_id"),
        F.md5("task_id").alias("reviewer"), F.lit("accepted").alias("status"), F.lit("why").alias("rationale"),
        F.current_timestamp().alias("created_at"),
    )
    rows, cut = cut_up(ledger.judge_events(events, hot.select("task_id")))
    assert len(rows) == N and not any(r.reject_reason for r in rows)
    assert cut


def test_one_group(hot, small_partitions):
    divided = splits.make_splits(hot.drop("split"), strict=False)
    counts = {r.split: r.n_tasks for r in splits.split_counts(divided).collect()}
    assert sum(counts.values()) == N and len(counts) == 3
    scores = hot.select("task_id", ((F.col("seq") * 37 % 1001) / 1000).alias("review_risk"))
    queue = review_queue.build_review_queue(hot, scores, 50).collect()
    assert len({r.group_id for r in queue}) == 50


def test_one_suite(spark, hot, small_partitions):
    """A suite with a third of all cases: joins go by task and case, so no partition is hot to begin with."""
    cases = hot.select(
        F.col("group_id").alias("task_id"), F.col("task_id").alias("case_id"), F.lit("SUM=1").alias("expected_stdout")
    )
    mutants = cases.select("task_id").distinct().select("task_id", F.explode(F.array(F.lit("m0"), F.lit("m1"))).alias("mutant_id"))
    ref = cases.select("task_id", "case_id", F.lit("reference").alias("program_id"), F.lit(0).alias("return_code"),
                       F.lit("SUM=  1\n").alias("stdout"), F.lit(False).alias("timed_out"))
    runs = ref.withColumn("program_id", F.lit("m0")).unionByName(
        ref.withColumns({"program_id": F.lit("m1"), "stdout": F.lit("SUM= 2")})
    )
    rows = {r.task_id: r for r in mutation.suite_scores(cases, mutants, ref, runs).collect()}
    assert rows["hot"].oracle_valid_count == N // 3 and rows["hot"].missing_run_count == 0
    assert {(r.mutant_count, r.mutants_killed) for r in rows.values()} == {(2, 1)}
