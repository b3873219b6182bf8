"""Stores kept as sorted runs: texts by id, the fingerprint tree, suite scores from streams."""

import random

import pytest
from pyspark.sql import functions as F

from tasksieve.functions.digests import table_digest
from tasksieve.operators import curation, mutation, review_queue
from tasksieve.sources import tables as t
from tasksieve.sources.fingerprints import FingerprintTree
from tasksieve.sources.task_store import TaskStore
from tasksieve.streaming.scores import SuiteScores
from tests.conftest import SMALL


def scanned_rows(frame):
    """Rows that the file scans of an executed frame gave out."""
    plan = frame._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaves, total = plan.collectLeaves(), 0
    for i in range(leaves.size()):
        total += leaves.apply(i).metrics().apply("numOutputRows").value()
    return total


def test_a_few_ids_read_a_few_row_groups(spark, task, tmp_path):
    from tasksieve.schema import TASK

    rows = spark.range(0, 20_000, 1, 4).select(
        F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("task_id"),
        *[F.lit("some text that a task has").alias(f.name) if f.dataType.simpleString() == "string" else F.array().cast(f.dataType).alias(f.name) for f in TASK.fields[1:]],
    )
    store = TaskStore(spark, str(tmp_path / "store"), row_group_bytes=1 << 13, file_rows=5000)
    store.add(rows.where("task_id < 't012000'"))
    store.add(rows)  # those stored before are left alone
    assert store.runs.read(store.runs.manifest(), "tasks").count() == 20_000
    wanted = ["t000003", "t000004", "t007777", "t019999", "absent"]
    found = store.lookup(wanted)
    assert sorted(r.task_id for r in found.collect()) == wanted[:-1]
    assert len(found.inputFiles()) <= 3 * len(wanted) and scanned_rows(found) <= 2000
    assert store.lookup([]).count() == 0
    many = store.lookup([f"t{i:06}" for i in range(100, 140)])
    assert many.count() == 40


def test_the_queue_reads_its_texts_by_index(spark, tmp_path):
    store = TaskStore(spark, str(tmp_path / "store"))
    store.add(t.tasks(spark, SMALL))
    narrow = t.tasks(spark, SMALL, "task_id", "group_id", "seq", "review_status")
    by_index = review_queue.build_review_queue(narrow, t.scores(spark, SMALL), 7, texts=store)
    by_scan = review_queue.build_review_queue(t.tasks(spark, SMALL), t.scores(spark, SMALL), 7)
    assert [tuple(r) for r in by_index.collect()] == [tuple(r) for r in by_scan.collect()]
    assert not any(name.endswith("documents.parquet") for name in by_index.inputFiles())


def test_the_tree_follows_appends_and_removals(spark, tmp_path):
    rng = random.Random(3)
    frame = lambda rows: spark.createDataFrame(rows, "task_id string, text string")
    digest = F.sha2(F.concat("task_id", F.lit(":"), "text"), 256)
    now: list[tuple[str, str]] = []
    tree = FingerprintTree(spark, str(tmp_path / "tree"), fan_in=3, grace_seconds=0)
    assert tree.root() is None
    for step in range(6):
        added = [(f"t{rng.randrange(60)}", rng.choice("ab")) for _ in range(rng.randrange(1, 40))]
        removed = rng.sample(now, rng.randrange(len(now) + 1)) if now else []
        if step == 4:
            removed = list(now)
        for row in removed:
            now.remove(row)
        now += added
        root = tree.apply(digest, frame(added), frame(removed) if removed else None)
        assert root == tree.root() == table_digest(frame(now), digest).first()[0]
    with pytest.raises(ValueError, match="not there"):
        tree.apply(digest, removed=frame([("nobody", "a")]))
    assert tree.apply(digest, removed=frame(now)) is None


def test_trees_name_their_differences_and_open_unequal_buckets_only(spark, tmp_path):
    rows = spark.range(0, 4000).select(F.concat(F.lit("t"), "id").alias("task_id"), F.lit("x").alias("text"))
    digest = F.sha2(F.concat("task_id", "text"), 256)
    mine, theirs = (FingerprintTree(spark, str(tmp_path / name), file_rows=200) for name in ("mine", "theirs"))
    mine.apply(digest, rows)
    theirs.apply(digest, rows)
    assert mine.difference(theirs).count() == 0 and mine.root() == theirs.root()
    mine.apply(digest, rows.where("task_id = 't17'"), rows.where("task_id = 't18'"))
    theirs.apply(digest, rows.where("task_id = 't19'").withColumn("text", F.lit("y")))
    found = mine.difference(theirs)
    assert sorted(map(tuple, found.collect())) == [("t17", 2, 1), ("t18", 0, 1), ("t19", 0, 1)]
    leaves = [name for name in found.inputFiles() if "/leaves/" in name]
    whole = [name for name in mine.runs.read(mine.runs.manifest(), "leaves").inputFiles()]
    assert len(leaves) <= 2 * 3 + 2 < len(whole)


@pytest.mark.parametrize("seed", [1, 2])
def test_scores_do_not_depend_on_the_order_of_arrival(spark, tmp_path, seed):
    """Batches cut at random, references late, a restart in the middle and the last batch delivered again."""
    rng = random.Random(seed)
    keep = "task_id <= 40"
    cases, mutants = (table(spark, SMALL).where(keep).cache() for table in (t.cases, t.mutants))
    columns = ("task_id", "case_id", "program_id", "return_code", "stdout", "timed_out")
    reference = t.reference_runs(spark, SMALL).where(keep).select(*columns, "duration_seconds")
    others = t.mutant_runs(spark, SMALL).where(keep).select(*columns, F.lit(None).cast("double").alias("duration_seconds"))
    runs = [tuple(r) for r in others.unionByName(reference).collect()]
    rng.shuffle(runs)
    schema, place = reference.schema, str(tmp_path / "scores")
    cuts = sorted(rng.sample(range(len(runs)), 3))
    for number, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(runs)])):
        book = SuiteScores(spark, place, cases, mutants, fan_in=2)
        batch = spark.createDataFrame(runs[a:b], schema)
        book.store(batch, f"log-{number}")
    book.store(batch, "log-3")
    want = mutation.suite_scores(cases, mutants, spark.createDataFrame([r for r in runs if r[2] == "reference"], schema), spark.createDataFrame([r for r in runs if r[2] != "reference"], schema))
    assert sorted(map(tuple, book.scores().collect())) == sorted(map(tuple, want.collect())) and want.count() > 5


def test_suites_without_runs_are_scored_as_such(spark, tmp_path):
    cases, mutants = (table(spark, SMALL).where("task_id <= 10") for table in (t.cases, t.mutants))
    book = SuiteScores(spark, str(tmp_path / "scores"), cases, mutants)
    rows = book.scores().collect()
    assert {r.task_id for r in rows} == {r.task_id for r in cases.select("task_id").distinct().collect()}
    assert all(r.missing_reference_count == r.generated_case_count for r in rows)


def test_fingerprint_of_tasks(spark, tmp_path):
    rows = t.tasks(spark, SMALL)
    tree = FingerprintTree(spark, str(tmp_path / "tree"))
    assert tree.apply(curation.task_digest(), rows) == curation.dataset_fingerprint(rows).first()[0]


def test_a_large_batch_shuffles_its_cases_once_and_a_batch_without_references_none(spark, tmp_path, monkeypatch):
    """No join by suite before the scores; what has no reference run is not scored anew, and all scores are as those over all runs."""
    from tasksieve.streaming import scores as module

    monkeypatch.setattr(module, "_LISTED", 1)
    monkeypatch.setattr(module, "_BROADCAST", 1)
    cases = spark.createDataFrame([(t, f"c{c}", "SUM=1") for t in range(7) for c in range(2)], "task_id long, case_id string, expected_stdout string")
    mutants = spark.createDataFrame([(t, f"m{m}") for t in range(7) for m in range(2)], "task_id long, mutant_id string")
    log = lambda tasks, program, out: spark.createDataFrame(
        [(t, f"c{c}", program, 0, out, False) for t in tasks for c in range(2)], "task_id long, case_id string, program_id string, return_code int, stdout string, timed_out boolean"
    )
    book, given = SuiteScores(spark, str(tmp_path / "scores"), cases, mutants), []
    scored = book._scored
    monkeypatch.setattr(book, "_scored", lambda c, m, runs: given.append(c) or scored(c, m, runs))
    book.store(log(range(6), "m0", "SUM=2"), "log-0")
    assert book.runs.read(book.runs.manifest(), "scores").count() == 0
    book.store(log(range(1, 5), "reference", "SUM=1"), "log-1")
    assert "Join" not in given[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert {r.task_id for r in book.runs.read(book.runs.manifest(), "scores").collect()} == {1, 2, 3, 4}
    book.store(log(range(4, 7), "m1", "SUM=1"), "log-2")
    want = mutation.suite_scores(
        cases, mutants, log(range(1, 5), "reference", "SUM=1"), log(range(6), "m0", "SUM=2").unionByName(log(range(4, 7), "m1", "SUM=1"))
    )
    assert sorted(map(tuple, book.scores().collect())) == sorted(map(tuple, want.collect()))


def test_a_large_batch_shuffles_its_runs_for_the_files_and_the_joins_on_cases_only(spark, tmp_path, monkeypatch):
    """No shuffle by suite, no cache, and no mutants' runs while no reference run is there; other suites keep their scores."""
    from tasksieve.streaming import scores as module

    monkeypatch.setattr(module, "_LISTED", 1)
    monkeypatch.setattr(module, "_BROADCAST", 1)
    cases = spark.createDataFrame([(t, f"c{c}", "SUM=1") for t in range(6) for c in range(2)], "task_id long, case_id string, expected_stdout string")
    mutants = spark.createDataFrame([(t, "m0") for t in range(6)], "task_id long, mutant_id string")
    log = lambda tasks, program, out: spark.createDataFrame(
        [(t, f"c{c}", program, 0, out, False) for t in tasks for c in range(2)], "task_id long, case_id string, program_id string, return_code int, stdout string, timed_out boolean"
    )
    book, read = SuiteScores(spark, str(tmp_path / "scores"), cases, mutants), []
    scored = book._scored
    monkeypatch.setattr(book, "_scored", lambda c, m, runs: read.append(runs) or scored(c, m, runs))
    book.store(log(range(5), "m0", "SUM=2"), "log-0")
    assert read[-1].count() == 0
    book.store(log(range(2, 4), "reference", "SUM=1"), "log-1")
    assert read[-1].count() == 14 and "Join" not in read[-1]._jdf.queryExecution().optimizedPlan().toString()
    got = {r.task_id: (r.oracle_valid_count, r.mutants_killed) for r in book.scores().collect()}
    assert got == {t: (2, 1) if t in (2, 3) else (0, 0) for t in range(6)}
    want = mutation.suite_scores(cases, mutants, log(range(2, 4), "reference", "SUM=1"), log(range(5), "m0", "SUM=2"))
    assert sorted(map(tuple, book.scores().collect())) == sorted(map(tuple, want.collect()))
