"""Query registry: ``entry`` (flagship), ``queries`` (one per operator) and ``oracle_sql`` (the same in DuckDB SQL)."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from types import SimpleNamespace

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

from oracle_queries import PHRASES, ORACLE  # noqa: E402
from tasksieve.operators import (  # noqa: E402
    contracts, curation, detector, features, ledger, mutation, review_queue, sft, splits,
)
from tasksieve.session import scratch_path, tune  # noqa: E402
from tasksieve.sources import jsonl, tables as t  # noqa: E402
from tasksieve.sources.fingerprints import FingerprintTree  # noqa: E402
from tasksieve.sources.task_store import TaskStore  # noqa: E402
from tasksieve.streaming.decisions import DecisionStream  # noqa: E402
from tasksieve.streaming.scores import SuiteScores  # noqa: E402

Query = Callable[[SparkSession, str], DataFrame]


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: mutation scores of all suites over the recorded runs."""
    return _suite_scores(tune(spark), "/root/testdata/sf0.001")


# --- contracts, sources, sinks -------------------------------------------------------------------------------------

def _load_tasks(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "task-lines")
    ordered = t.task_lines(spark, sf, order=lambda documents: documents.orderBy("doc_id"))
    ordered.select("raw").write.option("compression", "gzip").text(path)
    loaded = jsonl.load_tasks(spark, path)
    kept = loaded.tasks.select(
        F.lit("task").alias("kind"), F.col("task_id").alias("id"), F.col("title").alias("detail"),
        F.size("reference_tests").cast("bigint").alias("n"),
    )
    bad = loaded.quarantine.groupBy("first_error").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("quarantine").alias("kind"), F.col("first_error").alias("id"), F.lit("").alias("detail"), "n"
    )
    return kept.unionByName(bad)


def _quarantine_lines(spark: SparkSession, sf: str) -> DataFrame:
    """File and line of each refused record; every fifth record follows a blank line, 500 records lie in a file."""
    path = scratch_path(spark, "task-files")
    file = F.floor(F.col("doc_id") / 500).cast("bigint")
    lines = t.task_lines(spark, sf, order=lambda documents: documents.repartition(file).sortWithinPartitions(file, "doc_id")).select(
        "seq", "raw", F.floor(F.col("seq") / 500).cast("bigint").alias("file")
    )
    spaced = lines.withColumn("raw", F.when(F.col("seq") % 5 == 0, F.concat(F.lit("\n"), "raw")).otherwise(F.col("raw")))
    spaced.select("raw", "file").write.partitionBy("file").option("compression", "gzip").text(path)
    return jsonl.load_tasks(spark, path).quarantine.select(
        F.regexp_extract("path", "file=([0-9]+)", 1).cast("bigint").alias("file"), "line_number", "first_error"
    )


def _write_tasks_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = jsonl.write_tasks(t.tasks(spark, sf), scratch_path(spark, "tasks"), compression="gzip")
    back = jsonl.load_tasks(spark, path).tasks
    return back.select(
        "task_id", "group_id", "title", "specification", "program", "source_url", "license_id", "review_status",
        "review_notes", F.size("reference_tests").alias("n_tests"),
        F.element_at("reference_tests", -1)["expected_stdout"].alias("last_expected"),
        F.size("mutants").alias("n_mutants"),
    )


def _task_json(spark: SparkSession, sf: str) -> DataFrame:
    return t.tasks(spark, sf).select("task_id", jsonl.task_json().alias("task_json"))


def _validate_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.read_records(t.task_lines(spark, sf)).select(
        "seq", F.coalesce("first_error", F.lit("")).alias("first_error"), F.array_join("errors", "|").alias("errors")
    )


def _validate_cases(spark: SparkSession, sf: str) -> DataFrame:
    parsed = contracts.parse_json_strictly(t.task_lines(spark, sf), F.col("raw"), "value")
    listed = parsed.select(
        "seq", F.posexplode(F.try_variant_get("value", "$.reference_tests", "array<variant>")).alias("case_ord", "c")
    )
    return listed.select("seq", "case_ord", F.coalesce(contracts.case_fault(F.col("c")), F.lit("")).alias("fault"))


def _duplicate_task_ids(spark: SparkSession, sf: str) -> DataFrame:
    sound = contracts.read_records(t.task_lines(spark, sf)).where(F.size("errors") == 0)
    return contracts.duplicate_keys(sound)


# --- curation ------------------------------------------------------------------------------------------------------

def _vague_specs(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.tasks(spark, sf, "task_id", "specification")
    return rows.where(curation.is_vague(F.col("specification"), PHRASES)).select("task_id")


def _missing_provenance(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.tasks(spark, sf, "task_id", "source_url")
    return rows.where(curation.lacks_provenance(F.col("source_url")))


def _unknown_license(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.tasks(spark, sf, "task_id", "license_id")
    return rows.where(curation.lacks_license(F.col("license_id")))


def _missing_rationale(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.tasks(spark, sf, "task_id", "review_status", "review_notes")
    return rows.where(curation.lacks_rationale(F.col("review_status"), F.col("review_notes"))).select("task_id")


# --- splits --------------------------------------------------------------------------------------------------------

def _split(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return splits.make_splits(t.tasks(spark, sf, "task_id", "group_id", *columns), strict=False)


# --- review --------------------------------------------------------------------------------------------------------

def _review_risk(spark: SparkSession, sf: str) -> DataFrame:
    rows = detector.measured(t.tasks(spark, sf))
    return detector.ReviewDetector().fit(rows).predict_review_risk(rows)


def _detector_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """A saved and loaded detector gives the same probabilities, all of them between 0 and 1."""
    rows = detector.measured(t.tasks(spark, sf))
    fitted = detector.ReviewDetector(num_trees=20).fit(rows)
    loaded = detector.ReviewDetector.load(fitted.save(scratch_path(spark, "detector")))
    before = fitted.predict_review_risk(rows)
    after = loaded.predict_review_risk(rows).withColumnRenamed("review_risk", "again")
    return before.join(after, "task_id").select(
        "task_id", (F.col("review_risk") == F.col("again")).alias("same"),
        F.col("review_risk").between(0, 1).alias("in_range"),
    )


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.judge_events(t.review_events(spark, sf), t.tasks(spark, sf, "task_id"))


def _ledger_import(spark: SparkSession, sf: str) -> DataFrame:
    stored = t.tasks(spark, sf, "task_id", "review_status").where("review_status <> 'unreviewed'").select("task_id")
    return ledger.new_tasks(t.deliveries(spark, sf), stored)


def _ledger_stream(spark: SparkSession, sf: str) -> DataFrame:
    """All events through the stream, read back from the ledger with their verdicts."""
    home = scratch_path(spark, "ledger")
    book = ledger.ReviewLedger(spark, home)
    book.import_tasks(t.tasks(spark, sf))
    source = t.table(spark, sf, "events")
    decisions = (
        spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
        .transform(t.as_decisions, t.table(spark, sf, "documents").count())
    )
    DecisionStream(book, f"{home}/checkpoint").start(decisions).awaitTermination()
    taken = ledger.review_history(book.events()).select("event_id", "task_id", F.lit("").alias("reject_reason"))
    return taken.unionByName(book.rejects().select("event_id", "task_id", "reject_reason"))


def _review_queue_by_index(spark: SparkSession, sf: str) -> DataFrame:
    """The queue with its texts from a store sorted by id instead of a scan of all tasks."""
    store = TaskStore(spark, scratch_path(spark, "task-store"))
    store.add(t.tasks(spark, sf))
    narrow = t.tasks(spark, sf, "task_id", "group_id", "seq", "review_status")
    return review_queue.build_review_queue(narrow, t.scores(spark, sf), texts=store)


def _fingerprint_tree(spark: SparkSession, sf: str, offset: int = 0) -> FingerprintTree:
    """Two thirds of the tasks, then the others and some wrong ones, which then go again, but for ``offset`` of each hundred."""
    rows, digest = t.tasks(spark, sf), curation.task_digest()
    tree = FingerprintTree(spark, scratch_path(spark, "fingerprints"))
    wrong = rows.where("seq % 10 = 0").withColumn("program", F.concat("program", F.lit("!")))
    tree.apply(digest, added=rows.where("seq % 3 < 2"))
    tree.apply(digest, added=rows.where("seq % 3 = 2").unionByName(wrong))
    tree.apply(digest, removed=wrong.where(F.col("seq") % 100 >= offset))
    return tree


def _fingerprint_root(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(_fingerprint_tree(spark, sf).root(),)], "fingerprint string")


def _fingerprint_difference(spark: SparkSession, sf: str) -> DataFrame:
    return _fingerprint_tree(spark, sf, 50).difference(_fingerprint_tree(spark, sf))


def _suite_scores_stream(spark: SparkSession, sf: str) -> DataFrame:
    """All runs through a stream of files, mutants' runs before their references'. The cases are read for the log of the mutants, by
    each batch and for the scores: they are made once, into a table."""
    home = scratch_path(spark, "scores")
    t.cases(spark, sf).sortWithinPartitions("task_id").write.option("compression", "zstd").parquet(f"{home}/cases")
    cases = spark.read.parquet(f"{home}/cases")
    book = SuiteScores(spark, home, cases, t.mutants(spark, sf))
    columns = ("task_id", "case_id", "program_id", "return_code", "stdout", "timed_out")
    for order, log in enumerate((
        t.mutant_runs(spark, sf, cases).select(*columns, F.lit(None).cast("double").alias("duration_seconds")),
        t.reference_runs(spark, sf).select(*columns, "duration_seconds"),
    )):
        log.write.option("compression", "zstd").parquet(f"{home}/inbox/log={order}")
        arrived = spark.readStream.schema(log.schema).parquet(f"{home}/inbox/log=*")
        book.start(arrived, f"{home}/checkpoint").awaitTermination()
    return book.scores()


# --- fine-tuning examples --------------------------------------------------------------------------------------------

def _sft_rows(spark: SparkSession, sf: str) -> DataFrame:
    return t.tasks(spark, sf, "task_id", "specification", "program", "reference_tests")


def _sft_messages(spark: SparkSession, sf: str) -> DataFrame:
    return sft.sft_messages(_sft_rows(spark, sf)).select(
        "task_id", F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
        F.element_at("messages", 1)["content"].alias("user_content"),
        F.element_at("messages", 2)["content"].alias("assistant_content"),
    )


def _encoded(spark: SparkSession, sf: str) -> DataFrame:
    return sft.encode(sft.chat_tokens(sft.sft_messages(_sft_rows(spark, sf)), max_length=1024), max_length=1024)


def _sft_encode(spark: SparkSession, sf: str) -> DataFrame:
    return sft.usable(_encoded(spark, sf)).select(
        "task_id", "prompt_tokens", F.size("input_ids").alias("n_ids"),
        F.size(F.filter("labels", lambda x: x == sft.IGNORED_LABEL)).alias("n_masked"),
        F.size(F.filter("labels", lambda x: x != sft.IGNORED_LABEL)).alias("n_supervised"),
        F.size(F.filter("attention_mask", lambda x: x == 1)).alias("n_attended"),
    )


def _sft_batches(spark: SparkSession, sf: str) -> DataFrame:
    return sft.collate(sft.usable(_encoded(spark, sf))).select(
        "batch_no", "row_no", "task_id", "width", F.size("input_ids").alias("n_ids"),
        F.size(F.filter("attention_mask", lambda x: x == 0)).alias("n_padding"),
    )


# --- mutation scoring ------------------------------------------------------------------------------------------------

def _normalize_output(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(
        F.lit(" \r\nSUM=  "), F.col("text"), F.lit("\r\n\t\nSUM=  "), F.col("doc_id").cast("string"), F.lit(" \x1f\n")
    )
    return t.table(spark, sf, "documents").select("doc_id", mutation.normalize_output(text).alias("normalized"))


def _run_records(spark: SparkSession, sf: str) -> DataFrame:
    return mutation.run_records(t.reference_runs(spark, sf), timeout_seconds=1.5)


def _oracle_validity(spark: SparkSession, sf: str) -> DataFrame:
    return mutation.oracle_validity(t.cases(spark, sf), t.reference_runs(spark, sf)).select(
        "task_id", "case_id", "oracle_valid"
    )


def _kill_matrix(spark: SparkSession, sf: str) -> DataFrame:
    validity = mutation.oracle_validity(t.cases(spark, sf), t.reference_runs(spark, sf))
    return mutation.kill_matrix(validity, t.mutant_runs(spark, sf))


def _mutant_scores(spark: SparkSession, sf: str) -> DataFrame:
    return mutation.mutant_scores(_kill_matrix(spark, sf), t.mutants(spark, sf))


def _suite_scores(spark: SparkSession, sf: str) -> DataFrame:
    return mutation.suite_scores(
        t.cases(spark, sf), t.mutants(spark, sf), t.reference_runs(spark, sf), t.mutant_runs(spark, sf)
    )


def _parse_suites(spark: SparkSession, sf: str) -> DataFrame:
    return contracts.parse_suites(t.model_outputs(spark, sf)).select(
        "task_id", F.coalesce("parse_error", F.lit("")).alias("parse_error"),
        F.coalesce(F.size("cases"), F.lit(0)).alias("n_cases"),
    )


def _output_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, ...]:
    """The suites are read for their errors and twice for their cases: they are parsed once, into a table."""
    path = scratch_path(spark, "suites")
    contracts.parse_suites(t.model_outputs(spark, sf)).drop("model_output").write.parquet(path)
    suites = spark.read.parquet(path)
    runs = t.output_runs(spark, sf)
    return (
        suites, contracts.suite_cases(suites), t.mutants(spark, sf), runs.where("program_id = 'reference'"),
        runs.where("program_id <> 'reference'"),
    )


def _score_outputs(spark: SparkSession, sf: str) -> DataFrame:
    return mutation.score_outputs(*_output_tables(spark, sf))


def _suite_reports(spark: SparkSession, sf: str) -> DataFrame:
    """Reports written as JSON lines, read back, one row per mutant."""
    reports = mutation.mutant_reports(*_output_tables(spark, sf))
    path = mutation.write_reports(reports, scratch_path(spark, "reports"))
    return spark.read.schema(reports.schema).json(path).withColumn("killed_by_cases", F.array_join("killed_by_cases", ","))


def queries() -> dict[str, Query]:
    tasks = t.tasks
    found: dict[str, Query] = {
        "load_tasks": _load_tasks,
        "quarantine_lines": _quarantine_lines,
        "write_tasks_roundtrip": _write_tasks_roundtrip,
        "task_json": _task_json,
        "validate_tasks": _validate_tasks,
        "validate_cases": _validate_cases,
        "duplicate_task_ids": _duplicate_task_ids,
        "duplicate_programs": lambda s, d: curation.duplicate_programs(tasks(s, d, "task_id", "seq", "program")),
        "vague_specs": _vague_specs,
        "missing_provenance": _missing_provenance,
        "unknown_license": _unknown_license,
        "missing_rationale": _missing_rationale,
        "curation_issues": lambda s, d: curation.curation_issues(tasks(s, d), PHRASES),
        "issues_by_code": lambda s, d: curation.issues_by_code(tasks(s, d), PHRASES),
        "curation_report": lambda s, d: curation.curation_report(tasks(s, d)),
        "dataset_fingerprint": lambda s, d: curation.dataset_fingerprint(tasks(s, d)),
        "group_sizes": lambda s, d: splits.group_sizes(tasks(s, d, "group_id")),
        "make_splits": _split,
        "split_counts": lambda s, d: splits.split_counts(_split(s, d)),
        "split_manifest": lambda s, d: splits.split_manifest(_split(s, d)),
        "group_leakage": lambda s, d: splits.group_leakage(t.per_task_split(s, d)),
        "spec_leakage": lambda s, d: splits.spec_leakage(_split(s, d, "specification")),
        "training_manifest": lambda s, d: sft.training_manifest(_split(s, d)),
        "features": lambda s, d: features.extract_features(tasks(s, d)),
        "detector_labels": lambda s, d: detector.detector_labels(tasks(s, d, "task_id", "review_status")),
        "class_weights": lambda s, d: detector.class_weights(
            detector.detector_labels(tasks(s, d, "task_id", "review_status"))
        ),
        "review_risk": _review_risk,
        "detector_roundtrip": _detector_roundtrip,
        "review_queue": lambda s, d: review_queue.build_review_queue(tasks(s, d), t.scores(s, d)),
        "review_queue_by_index": _review_queue_by_index,
        "fingerprint_tree": _fingerprint_root,
        "fingerprint_difference": _fingerprint_difference,
        "suite_scores_stream": _suite_scores_stream,
        "deficit_splits": lambda s, d: splits.make_splits(tasks(s, d, "task_id", "group_id"), strict=False, in_turn=True),
        "feature_matrix": lambda s, d: features.feature_matrix(tasks(s, d)).select("task_id", F.posexplode("features").alias("place", "value")),
        "ledger_import": _ledger_import,
        "ledger_record": lambda s, d: ledger.accepted_events(_judged(s, d)),
        "ledger_rejects": lambda s, d: ledger.rejected_events(_judged(s, d)).select("event_id", "reject_reason"),
        "review_history": lambda s, d: ledger.review_history(ledger.accepted_events(_judged(s, d))),
        "ledger_stream": _ledger_stream,
        "sft_prompts": lambda s, d: sft.sft_prompts(tasks(s, d, "task_id", "specification", "program")),
        "sft_targets": lambda s, d: sft.sft_targets(tasks(s, d, "task_id", "reference_tests")),
        "sft_messages": _sft_messages,
        "sft_encode": _sft_encode,
        "sft_rejects": lambda s, d: sft.rejects(_encoded(s, d)),
        "sft_batches": _sft_batches,
        "normalize_output": _normalize_output,
        "run_records": _run_records,
        "oracle_validity": _oracle_validity,
        "kill_matrix": _kill_matrix,
        "killing_cases": lambda s, d: mutation.killing_cases(_kill_matrix(s, d)),
        "mutant_scores": _mutant_scores,
        "suite_scores": _suite_scores,
        "parse_suites": _parse_suites,
        "score_outputs": _score_outputs,
        "suite_reports": _suite_reports,
        "task_cases": lambda s, d: contracts.task_cases(tasks(s, d, "task_id", "reference_tests")),
        "task_mutants": lambda s, d: contracts.task_mutants(tasks(s, d, "task_id", "mutants")),
    }
    return {name: _tuned(query) for name, query in found.items()} | _training_text().QUERIES


def _tuned(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(tune(spark), sf_dir)

    return run


def _training_text():
    """The registry of the operators for training text, an empty one where their folder is absent."""
    try:
        import corpus_pipeline
        from tasksieve.llm import queries as registry
    except ModuleNotFoundError as error:
        if (error.name or "").split(".")[-1] not in ("corpus_pipeline", "llm"):
            raise
        return SimpleNamespace(QUERIES={}, ORACLE={})
    pipeline = {"pipeline": corpus_pipeline.run}
    sql = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return SimpleNamespace(QUERIES=registry.QUERIES | pipeline, ORACLE=registry.ORACLE | sql)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE) | _training_text().ORACLE
