"""JSON-lines task files: contract-checked scan with a quarantine, canonical text, sink."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tasksieve.errors import TaskFormatError
from tasksieve.functions.text import json_list, json_object, json_string
from tasksieve.operators.contracts import BLANK_LINE, duplicate_keys, read_records
from tasksieve.schema import TASK_FIELDS
from tasksieve.session import pinned, scratch_path


class LoadedTasks(NamedTuple):
    tasks: DataFrame
    quarantine: DataFrame


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file, folder or glob with ``seq``, an ordering value that follows the order of lines in the files.

    Spark may read the splits of a file in any order, so a row number alone would not do; within one split the row
    number grows by one from line to line. The values differ between two scans with other splits: store them before comparing.
    """
    return spark.read.text(path).select(
        F.col("value").alias("raw"),
        F.col("_metadata.file_path").alias("path"),
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("offset"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("seq"),
    )


def split_starts(lines: DataFrame) -> DataFrame:
    """``(file, offset, first, before)`` for each split of the scanned files: its first row number, and the lines of its file before it.

    ``lines`` must hold every line of the scan, blank ones too. The lines of a split are counted where they lie; what is
    accumulated is one row a split, file by file.
    """
    before = W.partitionBy("file").orderBy("offset").rowsBetween(W.unboundedPreceding, -1)
    return lines.groupBy("seq.file", "seq.offset").agg(F.min("seq.row").alias("first"), F.count(F.lit(1)).alias("n")).select(
        "file", "offset", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")
    )


def with_line_numbers(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """``rows`` with ``line_number``, counted from 1 in the file of each row's ``seq``."""
    named = starts.select(F.struct("file", "offset").alias("_split"), "first", "before")
    number = (F.col("before") + F.col("seq.row") - F.col("first") + 1).alias("line_number")
    return rows.withColumn("_split", F.struct("seq.file", "seq.offset")).join(named, "_split").select(*rows.columns, number)


def load_tasks(spark: SparkSession, path: str, strict: bool = False) -> LoadedTasks:
    """Valid tasks (first row of each task_id, in file order) and the quarantine of everything else: path, line_number, raw, errors,
    first_error.

    The lines are parsed once, into a Parquet table in the shared scratch folder, which gives every row a lasting
    ``seq`` and later steps columns to prune. Finding repeated ids reads ids and order values only. The repeated ones,
    few as a rule, are stored too; with their size known they are broadcast, so that later copies are dropped where
    they are read and no text is shuffled. Line numbers come from the same scan, by counting lines per split. ``strict`` raises on the
    first bad row, or on an empty input.
    """
    stage = scratch_path(spark, "records")
    bad = F.col("first_error").isNotNull()
    # A refused row keeps its raw text and no fields, a sound one its fields and no raw text.
    read_records(scan_lines(spark, path), blank_lines=True).select(
        "path", F.when(bad, F.col("raw")).alias("raw"), *[F.when(~bad, F.col(c)).alias(c) for c in TASK_FIELDS],
        "seq", "errors", "first_error",
    ).write.option("compression", "zstd").parquet(stage)
    lines = spark.read.parquet(stage)
    records = lines.where(~F.coalesce(F.col("first_error") == BLANK_LINE, F.lit(False)))
    repeated = pinned(duplicate_keys(records.where(~bad)).select(F.col("task_id").alias("_id"), "first_seen"))
    valid = records.where(~bad).join(repeated, F.col("task_id") == F.col("_id"), "left")
    later = F.coalesce(F.col("seq") != F.col("first_seen"), F.lit(False))
    tasks = valid.where(~later).select(*TASK_FIELDS, "seq")
    # A sound row keeps no raw text; a repeated one goes to the quarantine as canonical JSON.
    refused = records.where(bad).select("path", "seq", "raw", "errors", "first_error").unionByName(
        valid.where(later).select(
            "path", "seq", task_json().alias("raw"),
            F.array(F.lit("duplicate_task_id")).alias("errors"),
            F.lit("duplicate_task_id").alias("first_error"),
        )
    )
    quarantine = with_line_numbers(refused, pinned(split_starts(lines.select("seq")))).select(
        "path", "line_number", "raw", "errors", "first_error"
    )
    if strict:
        found = quarantine.select("path", "line_number", "first_error").orderBy("path", "line_number").take(1)
        if found:
            raise TaskFormatError(f"{found[0].path}:{found[0].line_number}: {found[0].first_error}")
        if tasks.isEmpty():
            raise TaskFormatError(f"not one valid record under {path}")
    return LoadedTasks(tasks, quarantine)


def write_tasks(tasks: DataFrame, path: str, mode: str = "overwrite", compression: str = "none") -> str:
    """Write tasks as JSON lines, a folder of part files; refuses an empty collection. Compressed files are read by one task each."""
    if tasks.isEmpty():
        raise ValueError("there is no task to write")
    tasks.select(*TASK_FIELDS).write.mode(mode).option("ignoreNullFields", "false").option("compression", compression).json(path)
    return path


def task_json(prefix: str = "") -> Column:
    """Canonical JSON of a task row: sorted keys, non-ASCII kept."""

    def encoded(name: str) -> Column:
        column = F.col(prefix + name)
        if name == "reference_tests":
            return case_list_json(column)
        if name == "mutants":
            return json_list(column, lambda m: json_object(
                [(key, json_string(m[key])) for key in ("mutant_id", "source")]
            ))
        return json_string(column)

    return json_object([(name, encoded(name)) for name in sorted(TASK_FIELDS)])


def case_list_json(cases: Column) -> Column:
    return json_list(cases, lambda c: json_object(
        [(key, json_string(c[key])) for key in ("case_id", "expected_stdout", "stdin")]
    ))
