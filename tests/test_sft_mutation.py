import json

import pytest
from pyspark.sql import functions as F

from tasksieve.operators import contracts, mutation, sft

RUN = "task_id string, case_id string, program_id string, return_code int, stdout string, stderr string, timed_out boolean, duration_seconds double"
CASE = "task_id string, case_ord int, case_id string, expected_stdout string"


# Outputs and what is left of them.
OUTPUTS = [
    ("SUM=            7\n", "SUM=7"), ("\n\n SUM=\t 7 \r\n\r\n  x SUM=  1\r", "SUM=7\nx SUM=  1"), ("SUM=\nfoo", "SUM=\nfoo"),
    ("SUM=  ", "SUM="), ("", ""), (" \n \t", ""), ("a b\x0bc\n d", "a b\x0bc\nd"), ("a \x1c\n\x1f b\x85", "a\nb"),
    ("one  two", "one  two"), ("a\rb", "ab"), ("SUM= \u3000 5\nSUM=6\n\nsum=  7", "SUM=5\nSUM=6\nsum=  7"),
    (" " * 3000 + "x" + " " * 3000 + "\n" + "y", "x\ny"),
]


def test_normalize_output(spark):
    frame = spark.createDataFrame(OUTPUTS, "s string, want string")
    for row in frame.select("want", mutation.normalize_output(F.col("s")).alias("out")).collect():
        assert row.out == row.want


def test_other_output_label(spark):
    frame = spark.createDataFrame([("T+:  1\nSUM=  2",)], "s string")
    assert frame.select(mutation.normalize_output(F.col("s"), "T+:")).first()[0] == "T+:1\nSUM=  2"


@pytest.fixture
def tables(spark):
    """Suite t has a mutant that loses carries; the one case of suite off expects what the reference does not print."""
    cases = spark.createDataFrame([
        ("t", 0, "small", "SUM=40"), ("t", 1, "carry", "SUM=105"), ("off", 0, "wrong", "SUM=8"), ("none", 0, "x", "SUM=1"),
    ], CASE)
    mutants = spark.createDataFrame([("t", "no-carry", 0), ("off", "m", 0)], "task_id string, mutant_id string, mutant_ord int")
    log = [
        ("t", "small", "reference", 0, "SUM=  40\n"), ("t", "carry", "reference", 0, "\nSUM=\t105"),
        ("off", "wrong", "reference", 0, "SUM=80"), ("none", "x", "reference", 0, "SUM=   1"),
        ("t", "small", "no-carry", 0, "SUM=40"), ("t", "carry", "no-carry", 0, "SUM=95"), ("off", "wrong", "m", 3, ""),
    ]
    runs = spark.createDataFrame([(*r, "", False, 0.25) for r in log], RUN)
    return cases, mutants, runs.where("program_id = 'reference'"), runs.where("program_id <> 'reference'")


def test_a_killed_mutant_and_wrong_expectations_that_kill_nothing(tables):
    scores = {r.task_id: r for r in mutation.suite_scores(*tables).collect()}
    good, off, none = scores["t"], scores["off"], scores["none"]
    assert (good.oracle_valid_count, good.mutants_killed, good.mutation_score, good.missing_run_count) == (2, 1, 1.0, 0)
    assert (off.oracle_invalid_count, off.mutant_count, off.mutants_killed, off.mutation_score) == (1, 1, 0, 0.0)
    assert (none.mutant_count, none.mutation_score, none.oracle_valid_count) == (0, None, 1)


def test_missing_runs_are_counted_and_kill_nothing(tables):
    cases, mutants, ref, log = tables
    scores = {r.task_id: r for r in mutation.suite_scores(cases, mutants, ref, log.where("case_id <> 'carry'")).collect()}
    assert (scores["t"].mutants_killed, scores["t"].missing_run_count) == (0, 1)
    gone = {r.task_id: r for r in mutation.suite_scores(cases, mutants, ref.where("case_id <> 'small'"), log).collect()}["t"]
    assert (gone.oracle_valid_count, gone.oracle_invalid_count, gone.missing_reference_count, gone.mutants_killed) == (1, 0, 1, 1)


def test_runs_logged_twice_count_once(tables):
    cases, mutants, ref, log = tables
    once = {r.task_id: r.asDict() for r in mutation.suite_scores(cases, mutants, ref, log).collect()}
    twice = {r.task_id: r.asDict() for r in mutation.suite_scores(cases, mutants, ref.unionByName(ref), log.unionByName(log)).collect()}
    assert {t: r.pop("repeated_run_count") for t, r in once.items()} == {"t": 0, "off": 0, "none": 0}
    assert {t: r.pop("repeated_run_count") for t, r in twice.items()} == {"t": 4, "off": 1, "none": 1}
    assert once == twice
    # A record that differs: the reference no longer vouches for the case.
    torn = ref.unionByName(ref.where("case_id = 'carry'").withColumn("stdout", F.lit("SUM=0")))
    assert {r.task_id: r.oracle_valid_count for r in mutation.suite_scores(cases, mutants, torn, log).collect()}["t"] == 1


def test_several_outputs_of_a_task_are_scored_apart(tables):
    cases, mutants, ref, log = tables
    def both(frame, first, second):
        return frame.where(first).withColumn("output_id", F.lit(1)).unionByName(frame.where(second).withColumn("output_id", F.lit(2)))
    small, all_ = "task_id = 't' AND case_id = 'small'", "task_id = 't'"
    parts = both(cases, small, all_), mutants, both(ref, small, all_), both(log, small, all_)
    scores = {r.output_id: r for r in mutation.suite_scores(*parts).collect()}
    assert {o: (r.generated_case_count, r.mutant_count, r.mutants_killed, r.missing_run_count) for o, r in scores.items()} == {
        1: (1, 1, 0, 0), 2: (2, 1, 1, 0),
    }


@pytest.mark.parametrize("change, killed", [
    ("timed_out = true", 1), ("return_code = 9", 1), ("return_code = CAST(NULL AS int)", 1),
    ("stdout = ' sum=40'", 1), ("stdout = '\\nSUM=   40 '", 0),
])
def test_what_kills(tables, change, killed):
    cases, mutants, ref, log = tables
    one = cases.where("case_id = 'small'")
    name, value = change.split(" = ")
    scores = mutation.suite_scores(one, mutants, ref, log.withColumn(name, F.expr(value)))
    assert scores.first().mutants_killed == killed


def test_timeout_bound(tables):
    cases, mutants, ref, log = tables
    for bad in (0, -1, 30.5):
        with pytest.raises(ValueError):
            mutation.suite_scores(cases, mutants, ref, log, timeout_seconds=bad)
    slow = log.withColumn("duration_seconds", F.lit(3.0))
    scores = {r.task_id: r.mutants_killed for r in mutation.suite_scores(cases, mutants, ref, slow, 2.0).collect()}
    assert scores["t"] == 1
    record = mutation.run_records(slow.withColumn("stderr", F.lit("e" * 5000)), 2.0).first()
    assert (record.return_code, record.stdout, record.stderr, record.timed_out) == (None, "", "timeout", True)
    record = mutation.run_records(slow.withColumn("stderr", F.lit("e" * 5000)), None).first()
    assert len(record.stderr) == 4000 and record.timed_out is False


def test_equal_mutant_ids_are_ambiguous_unless_numbered(spark, tables):
    cases, mutants, ref, log = tables
    twice = mutants.unionByName(mutants.withColumn("mutant_ord", F.lit(1)))
    scores = {r.task_id: r for r in mutation.suite_scores(cases, twice, ref, log).collect()}
    assert (scores["t"].mutant_count, scores["t"].mutation_score, scores["t"].ambiguous_mutant_count) == (0, None, 2)
    matrix = mutation.kill_matrix(mutation.oracle_validity(cases, ref), log)
    assert {r.ambiguous for r in mutation.mutant_scores(matrix, twice).collect()} == {True}
    numbered = log.withColumn("mutant_ord", F.lit(0)).unionByName(
        log.withColumns({"mutant_ord": F.lit(1), "stdout": F.lit("SUM=40")}).where("case_id = 'small'")
    )
    scores = {r.task_id: r for r in mutation.suite_scores(cases, twice, ref, numbered).collect()}
    assert (scores["t"].mutant_count, scores["t"].mutants_killed, scores["t"].missing_run_count) == (2, 1, 1)


def test_reports_from_model_output(spark, tables, tmp_path):
    _, mutants, ref, log = tables
    suite = json.dumps({"cases": [
        {"case_id": "small", "stdin": "15\n25\n", "expected_stdout": "SUM=40"},
        {"case_id": "carry", "stdin": "99\n6\n", "expected_stdout": "SUM=105"},
    ]})
    outputs = spark.createDataFrame([("t", f"Here: {suite}."), ("u", "not JSON")], "task_id string, model_output string")
    suites = contracts.parse_suites(outputs)
    # Two mutants of one id, told apart by their number: only the first is killed.
    twice = mutants.unionByName(mutants.withColumn("mutant_ord", F.lit(1)))
    numbered = log.withColumn("mutant_ord", F.lit(0)).unionByName(
        log.withColumns({"mutant_ord": F.lit(1), "stdout": F.when(F.col("case_id") == "small", "SUM=40").otherwise("SUM=105")})
    )
    inputs = suites, contracts.suite_cases(suites), twice, ref, numbered
    path = mutation.write_reports(mutation.mutant_reports(*inputs), str(tmp_path / "m"))
    back = {(r["task_id"], r["mutant_ord"]): r for r in map(json.loads, (x.value for x in spark.read.text(path).collect()))}
    assert {k: (r["killed"], r["killed_by_cases"]) for k, r in back.items()} == {("t", 0): (True, ["carry"]), ("t", 1): (False, [])}
    path = mutation.write_reports(mutation.score_outputs(*inputs), str(tmp_path / "r"))
    back = {r["task_id"]: r for r in map(json.loads, (x.value for x in spark.read.text(path).collect()))}
    assert back["t"]["parse_error"] is None and back["t"]["mutation_score"] == 0.5
    assert back["u"]["parse_error"] == contracts.NO_OBJECT and back["u"]["oracle_valid_count"] == 0
    assert back["u"]["mutation_score"] is None and back["u"]["generated_case_count"] is None


def test_outputs_are_normalized_behind_the_join_and_mutants_without_a_suite_stay_out(spark, tables):
    cases, mutants, ref, log = tables
    suites = spark.createDataFrame([("t", None), ("off", contracts.NOT_JSON), ("none", None), ("none", None), (None, None)],
                                   "task_id string, parse_error string")
    kept = cases.join(suites.where("parse_error IS NULL").distinct(), "task_id").drop("parse_error")
    lost = mutants.unionByName(spark.createDataFrame([("off", "m9", 0), (None, "m9", 0), ("off", "m9", 0)], mutants.schema))
    scored = mutation.score_outputs(suites, kept, lost, ref, log)
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan
    for joined in (mutation.oracle_validity(cases, ref), mutation.kill_matrix(cases.selectExpr(
        "task_id", "case_id", "expected_stdout AS expected", "true AS oracle_valid"), log)):
        above, below = joined._jdf.queryExecution().optimizedPlan().toString().split(" Join ", 1)
        assert "replace(stdout#" in above and "replace(stdout#" not in below
    alone = {r.task_id: r.asDict() for r in mutation.suite_scores(kept, mutants, ref, log).collect()}
    found = scored.collect()
    assert len(found) == 5
    for row in found:
        want = alone.get(row.task_id) or {"oracle_valid_count": 0}
        assert {k: v for k, v in row.asDict().items() if v is not None and k not in ("task_id", "parse_error")} == {
            k: v for k, v in want.items() if v is not None and k != "task_id"
        }


def test_target_and_prompt_text(spark, task, tasks_of):
    record = task(reference_tests=[{"case_id": "é", "stdin": "1\n\"\x1f", "expected_stdout": "SUM=3"}])
    row = sft.sft_messages(tasks_of(record)).first()
    assert [m.role for m in row.messages] == ["user", "assistant"]
    assert row.messages[0].content.endswith(
        f"\n\nSpecification:\n{record['specification']}\n\nCOBOL program:\n{record['program']}"
    )
    assert row.messages[1].content == json.dumps({"cases": record["reference_tests"]}, ensure_ascii=False, sort_keys=True)


def encoded(spark, rows, max_length):
    frame = spark.createDataFrame(rows, "task_id string, prefix_ids array<int>, full_ids array<int>")
    return {r.task_id: r for r in sft.encode(frame, max_length).collect()}


def test_encode_masks_truncates_and_rejects(spark):
    out = encoded(spark, [
        ("ok", [1, 2], [1, 2, 3, 4, 5, 6]), ("short", [1], [1, 2]), ("mismatch", [1, 9], [1, 2, 3]),
        ("long", [1, 2, 3, 4], [1, 2, 3, 4, 5]), ("all", [1, 2], [1, 2]),
    ], 4)
    assert out["ok"].input_ids == [1, 2, 3, 4] and out["ok"].labels == [-100, -100, 3, 4]
    assert out["ok"].attention_mask == [1] * 4 and out["ok"].reject_reason is None
    assert out["short"].labels == [-100, 2]
    assert out["all"].labels == [-100, -100]
    assert out["mismatch"].reject_reason == "prompt_prefix_mismatch"
    assert out["long"].reject_reason == "prompt_exceeds_max_length"


def test_default_tokens_make_the_prompt_a_prefix(spark, task, tasks_of):
    rows = sft.encode(sft.chat_tokens(sft.sft_messages(tasks_of(task("a"), task("b", specification="x" * 50)))))
    for r in rows.collect():
        assert r.reject_reason is None and r.labels[: r.prompt_tokens] == [-100] * r.prompt_tokens
        assert r.labels[r.prompt_tokens:] == r.input_ids[r.prompt_tokens:] != []


def test_batches_are_padded_to_their_longest_row(spark):
    rows = [(f"t{i}", i % 5, [1] * (i % 7 + 1), [1] * (i % 7 + 1)) for i in range(100)]
    frame = spark.createDataFrame(rows, "task_id string, prompt_tokens int, input_ids array<int>, attention_mask array<int>")
    seen = []
    for digits in (0, 1, 3):
        batches = {}
        for r in sft.collate(frame, batch_size=8, pad_id=0, digits=digits).collect():
            batches.setdefault(r.batch_no, []).append(r)
        assert sorted(r.task_id for b in batches.values() for r in b) == sorted(r[0] for r in rows)
        assert [len(batches[i]) for i in range(13)] == [8] * 12 + [4]
        for batch in batches.values():
            real = [sum(r.attention_mask) for r in batch]
            assert sorted(r.row_no for r in batch) == list(range(len(batch))) and {r.width for r in batch} == {max(real)}
            for r, n in zip(batch, real):
                assert len(r.input_ids) == len(r.labels) == len(r.attention_mask) == max(real)
                masked = min(int(r.task_id[1:]) % 5, n)
                assert r.input_ids[n:] == [0] * (max(real) - n)
                assert r.labels == [-100] * masked + [1] * (n - masked) + [-100] * (max(real) - n)
        seen.append({(r.batch_no, r.row_no, r.task_id) for b in batches.values() for r in b})
    # The number of buckets is layout only.
    assert seen[0] == seen[1] == seen[2]


def test_training_set_guards(spark, task, tasks_of):
    with pytest.raises(ValueError, match="no task"):
        sft.check_training_set(tasks_of(task()).limit(0))
    with pytest.raises(ValueError, match="twice"):
        sft.check_training_set(tasks_of(task(), task()))
    sft.check_training_set(tasks_of(task("a"), task("b")))


def test_prompts_too_long_are_counted_without_ids(spark):
    chats = spark.createDataFrame(
        [("short", [("user", " a  b\n"), ("assistant", "c")]), ("edge", [("user", "a b c d"), ("assistant", "c")]), ("long", [("user", "a " * 50), ("assistant", "c")])],
        "task_id string, messages array<struct<role string, content string>>",
    )
    whole, counted = sft.encode(sft.chat_tokens(chats), 7), sft.chat_tokens(chats, max_length=7)
    assert {r.task_id for r in counted.where("full_ids IS NULL").collect()} == {"edge", "long"}
    again = sft.encode(counted, 7)
    assert sorted(map(tuple, sft.rejects(again).collect())) == sorted(map(tuple, sft.rejects(whole).collect())) and sft.rejects(again).count() == 2
    assert [r.asDict() for r in sft.usable(again).collect()] == [r.asDict() for r in sft.usable(whole).collect()]
