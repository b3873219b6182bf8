"""Column types and fixed vocabularies of the task record."""

from pyspark.sql import types as T

# Field names, status words and defaults of the record format.
TEXT_FIELDS = (
    "task_id", "group_id", "title", "specification", "program",
    "reference_program", "source_url", "license_id",
)
REQUIRED_FIELDS = (
    "task_id", "group_id", "title", "specification", "program",
    "reference_program", "reference_tests", "mutants", "source_url",
    "license_id", "review_status",
)
TASK_FIELDS = REQUIRED_FIELDS + ("review_notes",)
CASE_FIELDS = ("case_id", "stdin", "expected_stdout")
MUTANT_FIELDS = ("mutant_id", "source")
REVIEW_STATUSES = ("unreviewed", "accepted", "revised", "rejected")
SPLIT_NAMES = ("train", "validation", "test")

CASE = T.StructType([T.StructField(name, T.StringType()) for name in CASE_FIELDS])
MUTANT = T.StructType([T.StructField(name, T.StringType()) for name in MUTANT_FIELDS])


def _task_type(name: str) -> T.DataType:
    if name == "reference_tests":
        return T.ArrayType(CASE)
    if name == "mutants":
        return T.ArrayType(MUTANT)
    return T.StringType()


TASK = T.StructType([T.StructField(name, _task_type(name)) for name in TASK_FIELDS])

RUNS = T.StructType([
    T.StructField("task_id", T.StringType()),
    T.StructField("case_id", T.StringType()),
    T.StructField("program_id", T.StringType()),
    T.StructField("return_code", T.IntegerType()),
    T.StructField("stdout", T.StringType()),
    T.StructField("stderr", T.StringType()),
    T.StructField("timed_out", T.BooleanType()),
    T.StructField("duration_seconds", T.DoubleType()),
])

REVIEW_EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("task_id", T.StringType()),
    T.StructField("reviewer", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("rationale", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])
