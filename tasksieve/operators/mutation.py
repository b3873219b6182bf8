"""Mutation scoring of test suites over recorded program runs.

Tables: cases(task_id, case_id, expected_stdout[, case_ord]), mutants(task_id, mutant_id[, mutant_ord]) and run logs
(task_id, case_id, program_id, return_code, stdout, timed_out[, stderr, duration_seconds]). Where several outputs of one
task are scored, cases and both logs carry ``output_id`` too, and so does every result; mutants stay keyed by task. A run
logged more than once counts as one, which is as expected only if every record of it is. Big joins hash on task and case
together, so that a suite with a third of all cases still spreads over all tasks; what is grouped by task alone has been
summed before.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from tasksieve.functions.text import WHITESPACE, WS, WS_INLINE, settled, strip

REFERENCE = "reference"

#: Seconds a run may take by default.
TIMEOUT_SECONDS = 2.0


def suite_key(table: DataFrame) -> list[str]:
    """The columns that name a suite: the task, and the output where several of a task are scored."""
    return [c for c in ("task_id", "output_id") if c in table.columns]


def normalize_output(text: Column, label: str = "SUM=") -> Column:
    """Program output without carriage returns, blank lines, line margins and blanks after a leading label.

    Most outputs are one line, which needs no regular expression. In several lines, a run of white space with a line
    feed in it is exactly what separates two kept lines; the look-behind lets a run be tried only from its start.
    """
    whole = strip(F.replace(text, F.lit("\r"), F.lit("")))
    breaks = rf"(?<![{WS_INLINE}])[{WS_INLINE}]*+\n[{WS}]*+"
    after_label = F.substr(whole, F.lit(len(label) + 1))
    return (
        F.when(F.contains(whole, F.lit("\n")), F.regexp_replace(
            F.regexp_replace(whole, breaks, "\n"), rf"(?md)^({re.escape(label)})[{WS_INLINE}]+", "$1"
        ))
        .when(whole.startswith(label), F.concat(F.lit(label), F.ltrim(after_label, F.lit(WHITESPACE))))
        .otherwise(whole)
    )


def check_timeout(seconds: float | None) -> None:
    if seconds is not None and not 0 < seconds <= 30:
        raise ValueError(f"a run may take more than 0 and up to 30 seconds, not {seconds}")


def _runs_in_time(runs: DataFrame, timeout_seconds: float | None, stdout: Column | None = None) -> DataFrame:
    """Run rows with the parts of a late run emptied; ``stdout`` shapes the output, which else stays as it was printed."""
    check_timeout(timeout_seconds)
    late = F.coalesce(F.col("timed_out"), F.lit(False))
    if timeout_seconds is not None and "duration_seconds" in runs.columns:
        late = late | F.coalesce(F.col("duration_seconds") > timeout_seconds, F.lit(False))
    parts = {
        "return_code": F.when(~late, F.col("return_code")),
        "stdout": F.when(late, "").otherwise(F.col("stdout") if stdout is None else stdout),
        "timed_out": late,
    }
    if "stderr" in runs.columns:
        parts["stderr"] = F.when(late, "timeout").otherwise(F.substring("stderr", 1, 4000))
    return runs.select(*[parts[c].alias(c) if c in parts else F.col(c) for c in runs.columns])


def run_records(runs: DataFrame, timeout_seconds: float | None = TIMEOUT_SECONDS, label: str = "SUM=") -> DataFrame:
    """Run rows in report shape; a run beyond ``timeout_seconds`` counts as timed out."""
    return _runs_in_time(runs, timeout_seconds, stdout=normalize_output(F.col("stdout"), label))


def _as_expected(expected: Column, label: str) -> Column:
    """True for a run that ended well with the expected output; missing parts make it false. The output is normalized
    here, behind the join with the cases, so runs of no case cost nothing."""
    printed = normalize_output(F.col("stdout"), label)
    return F.coalesce(~F.col("timed_out") & (F.col("return_code") == 0) & (printed == expected), F.lit(False))


def oracle_validity(
    cases: DataFrame, reference_runs: DataFrame, timeout_seconds: float | None = TIMEOUT_SECONDS, label: str = "SUM="
) -> DataFrame:
    """The cases with ``expected`` (normalized), ``oracle_valid`` (the reference program gives what they expect) and
    ``reference_run_count``, 0 where the log lacks the run.

    A score reads this table twice, for all cases and for the valid ones. Settling the verdict keeps the filter on it,
    and dropping rows without ids keeps the null checks of later joins, from making two different plans out of the two
    readings; so Spark scans and shuffles cases and reference runs once. Grouping after the join needs no further
    exchange: the rows already lie by task and case.
    """
    key = [*suite_key(cases), "case_id"]
    runs = _runs_in_time(reference_runs, timeout_seconds).select(
        *key, "timed_out", "return_code", "stdout", F.lit(1).alias("_run")
    )
    kept = [*key, *(c for c in ("case_ord",) if c in cases.columns)]
    named = F.lit(True)
    for name in key:
        named = named & F.col(name).isNotNull()
    expected = cases.where(named).select(*kept, normalize_output(F.col("expected_stdout"), label).alias("expected"))
    tally = expected.join(runs, key, "left").groupBy(*kept, "expected").agg(
        F.count("_run").alias("reference_run_count"), F.count_if(_as_expected(F.col("expected"), label)).alias("_good")
    )
    valid = (F.col("reference_run_count") > 0) & (F.col("_good") == F.col("reference_run_count"))
    return tally.select(*kept, "expected", settled(valid).alias("oracle_valid"), "reference_run_count")


def kill_matrix(
    validity: DataFrame, mutant_runs: DataFrame, timeout_seconds: float | None = TIMEOUT_SECONDS, label: str = "SUM="
) -> DataFrame:
    """Recorded runs of mutants on valid cases: the suite, case_id[, case_ord], mutant_id[, mutant_ord], killed and
    ``record_count``, the rows the log holds of the run."""
    key = [*suite_key(validity), "case_id"]
    runs = _runs_in_time(mutant_runs.where(F.col("program_id") != REFERENCE), timeout_seconds)
    kept = [*key, *(c for c in ("case_ord",) if c in validity.columns)]
    mutant = ["program_id", *(c for c in ("mutant_ord",) if c in mutant_runs.columns)]
    tally = (
        validity.where("oracle_valid").select(*kept, "expected").join(runs, key)
        .groupBy(*kept, *mutant).agg(
            F.count(F.lit(1)).alias("record_count"), F.count_if(~_as_expected(F.col("expected"), label)).alias("_off")
        )
    )
    return tally.select(
        *kept, F.col("program_id").alias("mutant_id"), *mutant[1:], (F.col("_off") > 0).alias("killed"), "record_count"
    )


def _mutant_key(matrix: DataFrame, mutants: DataFrame) -> list[str]:
    """The columns that tell mutants of one task apart: the id, and the number where log and mutants have it."""
    numbered = "mutant_ord" in matrix.columns and "mutant_ord" in mutants.columns
    return ["task_id", "mutant_id", "mutant_ord"] if numbered else ["task_id", "mutant_id"]


def mutant_scores(matrix: DataFrame, mutants: DataFrame, suites: DataFrame | None = None) -> DataFrame:
    """Per mutant: killed, kill_count, run_count (cases with a run), repeated_count (records beyond the first), copies,
    ambiguous.

    Two mutants of one task that share an id cannot be told apart in a log without ``mutant_ord``: such an id becomes
    one row marked ambiguous, without a verdict. With ``output_id``, ``suites`` must name the outputs of every task.
    """
    key = _mutant_key(matrix, mutants)
    ids = mutants.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"))
    if "output_id" in matrix.columns:
        if suites is None:
            raise ValueError("scores of several outputs a task need the table of outputs")
        ids = suites.select("task_id", "output_id").distinct().join(ids, "task_id")
        key = [*key, "output_id"]
    tally = matrix.groupBy(*key).agg(
        F.count_if("killed").alias("kill_count"), F.count(F.lit(1)).alias("run_count"),
        F.sum(F.col("record_count") - 1).alias("repeated_count"),
    )
    kills = F.coalesce("kill_count", F.lit(0))
    return ids.join(tally, key, "left").select(
        *key,
        F.when(F.col("copies") == 1, kills > 0).alias("killed"),
        F.when(F.col("copies") == 1, kills).alias("kill_count"),
        F.coalesce("run_count", F.lit(0)).alias("run_count"),
        F.coalesce("repeated_count", F.lit(0)).alias("repeated_count"),
        "copies", (F.col("copies") > 1).alias("ambiguous"),
    )


def killing_cases(matrix: DataFrame) -> DataFrame:
    """The killing cases of every mutant as rows; sort by case_ord within a mutant for suite order."""
    return matrix.where("killed").drop("killed", "record_count")


def suite_scores(
    cases: DataFrame,
    mutants: DataFrame,
    reference_runs: DataFrame,
    mutant_runs: DataFrame,
    timeout_seconds: float | None = TIMEOUT_SECONDS,
    label: str = "SUM=",
) -> DataFrame:
    """One row per suite: case, valid, invalid, mutant and kill counts, the score, and what the logs lack or repeat.

    A case without a reference run is missing, neither valid nor invalid. Mutants that cannot be told apart are counted
    in ``ambiguous_mutant_count`` only. The score is NULL without mutants; mutants of a suite without valid cases still
    count. ``missing_run_count`` speaks of mutants on valid cases, ``repeated_run_count`` of both logs.
    """
    validity = oracle_validity(cases, reference_runs, timeout_seconds, label)
    key = suite_key(cases)
    per_suite = validity.groupBy(*key).agg(
        F.count(F.lit(1)).alias("generated_case_count"), F.count_if("oracle_valid").alias("oracle_valid_count"),
        F.count_if(F.col("reference_run_count") == 0).alias("missing_reference_count"),
        F.sum(F.greatest(F.col("reference_run_count") - 1, F.lit(0))).alias("repeated_references"),
    )
    matrix = kill_matrix(validity, mutant_runs, timeout_seconds, label)
    sound = ~F.col("ambiguous")
    per_task = mutant_scores(matrix, mutants, validity).groupBy(*key).agg(
        F.count_if(sound).alias("mutant_count"), F.count_if(sound & F.col("killed")).alias("mutants_killed"),
        F.sum(F.when(sound, F.col("run_count"))).alias("run_count"),
        F.sum(F.when(sound, F.col("repeated_count"))).alias("repeated_count"),
        F.sum(F.when(~sound, F.col("copies"))).alias("ambiguous_mutant_count"),
    )

    def known(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    valid, mutant_count = F.col("oracle_valid_count"), known("mutant_count")
    return per_suite.join(per_task, key, "left").select(
        *key, "generated_case_count", "oracle_valid_count",
        (F.col("generated_case_count") - valid - F.col("missing_reference_count")).alias("oracle_invalid_count"),
        "missing_reference_count",
        mutant_count.alias("mutant_count"), known("mutants_killed").alias("mutants_killed"),
        (known("mutants_killed") / F.nullif(mutant_count, F.lit(0))).cast("double").alias("mutation_score"),
        (valid * mutant_count - known("run_count")).alias("missing_run_count"),
        (known("repeated_references") + known("repeated_count")).alias("repeated_run_count"),
        known("ambiguous_mutant_count").alias("ambiguous_mutant_count"),
    )


def score_outputs(
    suites: DataFrame,
    cases: DataFrame,
    mutants: DataFrame,
    reference_runs: DataFrame,
    mutant_runs: DataFrame,
    timeout_seconds: float | None = TIMEOUT_SECONDS,
) -> DataFrame:
    """Scores of parsed model outputs; an output that did not parse keeps its error, no valid case and no score."""
    key = suite_key(suites)
    parsed = suites.where("parse_error IS NULL").select("task_id")
    # Mutants of tasks without a suite score nothing. Dealing the rest anew lets a task that holds many be cut up in the join.
    scored = mutants.join(parsed, "task_id", "left_semi").repartition("task_id", "mutant_id")
    scores = suite_scores(cases, scored, reference_runs, mutant_runs, timeout_seconds)
    return suites.select(*key, "parse_error").join(scores, key, "left").withColumn(
        "oracle_valid_count", F.coalesce("oracle_valid_count", F.lit(0))
    )


def mutant_reports(
    suites: DataFrame,
    cases: DataFrame,
    mutants: DataFrame,
    reference_runs: DataFrame,
    mutant_runs: DataFrame,
    timeout_seconds: float | None = TIMEOUT_SECONDS,
) -> DataFrame:
    """Per suite that parsed and mutant of its task: the verdict and ``killed_by_cases``, the killing cases in suite order.

    One row holds at most the case ids of one suite, which were read from one JSON record.
    """
    validity = oracle_validity(cases, reference_runs, timeout_seconds)
    matrix = kill_matrix(validity, mutant_runs, timeout_seconds)
    per_mutant = mutant_scores(matrix, mutants, validity)
    key = suite_key(suites)
    mutant = [*key, *_mutant_key(matrix, mutants)[1:]]
    lists = killing_cases(matrix).groupBy(*mutant).agg(
        F.array_sort(F.collect_list(F.struct("case_ord", "case_id"))).alias("_kills")
    )
    parsed = suites.where("parse_error IS NULL").select(*key).distinct()
    killed_by = F.coalesce(F.transform("_kills", lambda k: k["case_id"]), F.array().cast("array<string>"))
    return per_mutant.join(parsed, key).join(lists, mutant, "left").select(
        *mutant, "killed", "ambiguous", F.when(~F.col("ambiguous"), killed_by).alias("killed_by_cases")
    )


def write_reports(reports: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Reports as JSON lines, NULLs written out."""
    reports.write.mode(mode).option("ignoreNullFields", "false").json(path)
    return path
