import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from tasksieve.session import build_session

    session = build_session(
        "tests", "local[8]", **{
            "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
            "spark.ui.showConsoleProgress": "false",
        }
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def task():
    """A valid task record; keyword arguments replace fields."""
    def make(task_id="sum-1", **changed):
        record = {
            "task_id": task_id, "group_id": task_id, "title": f"Add up {task_id}",
            "specification": f"{task_id}: numbers come one per line; show what they make together.",
            "program": f"DISPLAY TOTAL OF {task_id}", "reference_program": "DISPLAY TOTAL",
            "reference_tests": [{"case_id": "pair", "stdin": "40\n2\n", "expected_stdout": "SUM=42"}],
            "mutants": [], "source_url": "https://example.com/listing", "license_id": "CC-BY-4.0",
            "review_status": "accepted", "review_notes": "Ran it by hand.",
        }
        record.update(changed)
        return record

    return make


@pytest.fixture
def tasks_of(spark):
    """A task table from records, numbered by ``seq`` in list order."""
    from tasksieve.schema import TASK
    from pyspark.sql import types as T

    schema = T.StructType(TASK.fields + [T.StructField("seq", T.LongType())])

    def make(*records):
        return spark.createDataFrame([{**r, "seq": i} for i, r in enumerate(records)], schema)

    return make
