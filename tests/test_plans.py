"""The four jobs end to end on the smallest tables."""

import json

import pytest

from tasksieve.operators.detector import ReviewDetector
from tasksieve.plans.curate import curate
from tasksieve.plans.evaluate import evaluate
from tasksieve.plans.training import prepare_training
from tasksieve.plans.triage import triage
from tasksieve.sources import jsonl, tables
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def curated(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("curated")
    source = jsonl.write_tasks(tables.tasks(spark, SMALL), str(home / "in"))
    return curate(spark, source, str(home / "out"))


def test_curate(spark, curated):
    tasks = spark.read.parquet(curated["tasks"])
    assert tasks.count() == 200 and spark.read.parquet(curated["quarantine"]).count() == 0
    report = json.loads(spark.read.text(curated["report"]).first()[0])
    assert report["task_count"] == 200
    counted = {r.code: r["count"] for r in spark.read.parquet(curated["issues"]).groupBy("code").count().collect()}
    assert json.loads(report["issues_by_code"]) == counted
    assert spark.read.parquet(curated["manifest"]).where("kind = 'task'").count() == 200
    assert spark.read.parquet(curated["group_leakage"]).count() == 0


def test_triage(spark, curated, tmp_path):
    tasks = spark.read.parquet(curated["tasks"])
    paths = triage(spark, tasks, str(tmp_path), 5, ReviewDetector(num_trees=10).fit(tasks))
    queue = spark.read.json(paths["queue"]).collect()
    assert len(queue) == 5 == len({r.group_id for r in queue})
    assert spark.read.parquet(paths["scores"]).count() == 200


def test_training(spark, curated, tmp_path):
    tasks = spark.read.parquet(curated["tasks"])
    paths = prepare_training(spark, tasks, str(tmp_path))
    n = tasks.where("split = 'train'").count()
    assert spark.read.parquet(paths["batches"]).count() + spark.read.parquet(paths["rejects"]).count() == n
    assert json.loads(spark.read.text(paths["manifest"]).first()[0])["task_count"] == n


def test_evaluate(spark, tmp_path):
    outputs, mutants, runs = (f(spark, SMALL) for f in (tables.model_outputs, tables.mutants, tables.output_runs))
    paths = evaluate(spark, outputs, mutants, runs, str(tmp_path))
    reports = spark.read.json(paths["reports"])
    assert reports.count() == outputs.count()
    assert reports.where("parse_error IS NULL AND oracle_valid_count > 0").count() > 0
    assert reports.where("parse_error IS NOT NULL AND mutation_score IS NOT NULL").count() == 0
