import json

import pytest

from tasksieve.errors import TaskFormatError
from tasksieve.operators import contracts
from tasksieve.schema import TASK_FIELDS
from tasksieve.sources import jsonl


def judge(spark, *lines):
    rows = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "seq long, raw string")
    return [r.errors for r in contracts.read_records(rows).orderBy("seq").collect()]


def without(record, *names):
    return {k: v for k, v in record.items() if k not in names}


def test_sound_record_and_optional_notes(spark, task):
    assert judge(spark, json.dumps(task()), json.dumps(without(task(), "review_notes"))) == [[], []]


BROKEN = [
    ({"license_id": ""}, "blank:license_id"),
    ({"title": "   "}, "blank:title"),
    ({"title": 5}, "not_string:title"),
    ({"title": None}, "not_string:title"),
    ({"review_status": "done"}, "bad_status"),
    ({"review_status": 3}, "bad_status"),
    ({"review_notes": 3}, "not_string:review_notes"),
    ({"reference_tests": []}, "no_tests"),
    ({"reference_tests": "x"}, "tests_not_list"),
    ({"reference_tests": [{"case_id": "", "stdin": "", "expected_stdout": ""}]}, "case_blank"),
    ({"reference_tests": [{"case_id": 1, "stdin": "", "expected_stdout": "x"}]}, "case_not_strings"),
    ({"reference_tests": [{"case_id": "a", "stdin": ""}]}, "case_missing_fields"),
    ({"reference_tests": [5]}, "case_missing_fields"),
    ({"mutants": {"a": 1}}, "mutants_not_list"),
    ({"mutants": [{"mutant_id": "m", "source": ""}]}, "mutant_fields"),
    ({"mutants": [{"mutant_id": "m"}]}, "mutant_fields"),
    ({"mutants": [7]}, "mutant_fields"),
]


def test_broken_rules(spark, task):
    found = judge(spark, *[json.dumps(task(**changed)) for changed, _ in BROKEN])
    assert found == [[code] for _, code in BROKEN]


def test_repeated_case_ids(spark, task):
    case = {"case_id": "x", "stdin": "", "expected_stdout": "y"}
    assert judge(spark, json.dumps(task(reference_tests=[case, case]))) == [["duplicate_case_ids"]]


def test_equal_mutant_ids_and_empty_stdin_are_fine(spark, task):
    mutant = {"mutant_id": "0", "source": "S", "note": "more"}
    case = {"case_id": "x", "stdin": "", "expected_stdout": "y", "extra": [1]}
    assert judge(spark, json.dumps(task(mutants=[mutant, mutant], reference_tests=[case]))) == [[]]


def test_all_codes_are_listed_and_the_first_follows_the_precedence(spark, task):
    record = task(title="", review_status="no", reference_tests=[
        {"case_id": "a", "stdin": 1, "expected_stdout": "x"}, {"case_id": "a"},
    ])
    assert judge(spark, json.dumps(record)) == [
        ["case_not_strings", "case_missing_fields", "bad_status", "blank:title", "duplicate_case_ids"]
    ]


def test_missing_fields_are_sorted_and_hide_the_rest(spark, task):
    assert judge(spark, json.dumps(without(task(title=""), "program", "mutants"))) == [["missing_fields:mutants,program"]]


def test_json_shapes(spark, task):
    good = json.dumps(task())
    lines = [
        "[1]", '"text"', "null", "{", good + " tail", good + "}", good + ',"x"] tail', "[" + good + "]",
        '{"title": "first", ' + good[1:],
    ]
    assert judge(spark, *lines) == [
        ["not_object"], ["not_object"], ["not_object"], ["json_decode"], ["json_decode"], ["json_decode"],
        ["json_decode"], ["not_object"], [],
    ]


def test_load_keeps_the_first_of_equal_ids_and_skips_blank_lines(spark, task, tmp_path):
    lines = [json.dumps(task("a", title="first"), ensure_ascii=False), "", "  ", json.dumps(task("b")),
             json.dumps(task("a", title="second")), "oops"]
    path = tmp_path / "in" / "tasks.jsonl"
    path.parent.mkdir()
    path.write_bytes(("\n".join(lines) + "\n").encode() + b"\xff\xfe{}\n")
    loaded = jsonl.load_tasks(spark, str(path))
    assert sorted((r.task_id, r.title) for r in loaded.tasks.collect()) == [("a", "first"), ("b", "Add up b")]
    assert sorted(r.first_error for r in loaded.quarantine.collect()) == ["bad_encoding", "duplicate_task_id", "json_decode"]
    with pytest.raises(TaskFormatError, match="tasks.jsonl"):
        jsonl.load_tasks(spark, str(path), strict=True)


def test_first_of_equal_ids_over_many_splits(spark, task, tmp_path):
    lines = [json.dumps(task(f"t{i % 40}", title=f"n{i:04}")) for i in range(400)]
    path = tmp_path / "many.jsonl"
    path.write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        loaded = jsonl.load_tasks(spark, str(path))
        assert loaded.tasks.rdd.getNumPartitions() > 1
        titles = sorted(r.title for r in loaded.tasks.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert titles == [f"n{i:04}" for i in range(40)]
    assert loaded.quarantine.count() == 360


def test_line_numbers_equal_a_sequential_count(spark, task, tmp_path):
    """Several files of several splits, blank lines and all line ends, against reading them one after the other."""
    folder = tmp_path / "files"
    folder.mkdir()
    expected = set()
    for k, end in enumerate(("\n", "\r\n", "\n", "\r")):
        lines = []
        for i in range(150):
            lines += [[json.dumps(task(f"f{k}-{i}"))], ["oops"], ["", "[]"], [" \t", "", "{}"], [""]][(7 * i + k) % 5]
        if k == 2:
            lines = ["", "", "", *lines]
        (folder / f"part-{k}.jsonl").write_bytes((end.join(lines) + (end if k % 2 else "")).encode())
        for number, line in enumerate(open(folder / f"part-{k}.jsonl", encoding="utf-8"), 1):
            if line.strip() in ("oops", "[]", "{}"):
                expected.add((f"part-{k}.jsonl", number, line.strip()))
    conf = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "100"}
    old = {key: spark.conf.get(key) for key in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        loaded = jsonl.load_tasks(spark, str(folder))
        assert jsonl.split_starts(jsonl.scan_lines(spark, str(folder))).count() > 12
        found = {(r.path.rsplit("/", 1)[1], r.line_number, r.raw) for r in loaded.quarantine.collect()}
        with pytest.raises(TaskFormatError, match=f"part-0.jsonl:{min(n for p, n, _ in expected if p == 'part-0.jsonl')}: json_decode"):
            jsonl.load_tasks(spark, str(folder), strict=True)
    finally:
        for key, value in old.items():
            spark.conf.set(key, value)
    assert found == expected and loaded.tasks.count() > 100


def test_strict_load_refuses_an_empty_file(spark, tmp_path):
    path = tmp_path / "none.jsonl"
    path.write_text("\n\n")
    with pytest.raises(TaskFormatError, match="not one valid"):
        jsonl.load_tasks(spark, str(path), strict=True)


def test_write_and_load_round_trip(spark, task, tasks_of, tmp_path):
    records = [task("a", program="line 1\n\ttab   \x1f \"quoted\" \\ ß ﬁ"), task("b", mutants=[{"mutant_id": "m", "source": "S"}])]
    out = jsonl.write_tasks(tasks_of(*records), str(tmp_path / "out"))
    back = jsonl.load_tasks(spark, out, strict=True).tasks.select(*TASK_FIELDS)
    assert sorted(json.dumps(r.asDict(True), sort_keys=True) for r in back.collect()) == sorted(
        json.dumps(r, sort_keys=True) for r in records
    )
    with pytest.raises(ValueError, match="no task"):
        jsonl.write_tasks(tasks_of(task()).limit(0), str(tmp_path / "none"))


def test_task_json_is_what_python_writes(spark, task, tasks_of):
    nasty = "".join(map(chr, range(0x20))) + "\x7f\"\\/ \\u001F \\\x1f\x1f\\\\\x0b é 漢 😀  "
    record = task(program=nasty, mutants=[{"mutant_id": "m", "source": nasty}], reference_tests=[
        {"case_id": "a", "stdin": nasty, "expected_stdout": "x"}, {"case_id": "b", "stdin": "", "expected_stdout": "y"},
    ])
    text = tasks_of(record).select(jsonl.task_json()).first()[0]
    assert text == json.dumps(record, sort_keys=True, ensure_ascii=False)


SUITES = [
    ('{"cases": [{"case_id": "e", "stdin": "0\\n", "expected_stdout": "SUM=0"}]}', None),
    ('x {"cases": [{"case_id": "e", "stdin": "", "expected_stdout": "1"}], "more": {"a": 1}} y', None),
    ("not JSON", contracts.NO_OBJECT),
    ("} {", contracts.NO_OBJECT),
    ("{", contracts.NO_OBJECT),
    ("{a}", contracts.NOT_JSON),
    ('{"cases": []} and {}', contracts.NOT_JSON),
    ("{}", contracts.NO_CASE_LIST),
    ('{"cases": {"a": 1}}', contracts.NO_CASE_LIST),
    ('{"cases": null}', contracts.NO_CASE_LIST),
    ('{"cases": []}', contracts.NO_CASES),
    ('{"cases": [[5]]}', "case missing fields: ['case_id', 'stdin', 'expected_stdout']"),
    ('{"cases": [{"case_id": "a", "expected_stdout": "x"}]}', "case missing fields: ['stdin']"),
    ('{"cases": [{"case_id": "a", "stdin": null, "expected_stdout": "x"}]}', contracts.CASE_NOT_STRINGS),
    ('{"cases": [{"case_id": " ", "stdin": "", "expected_stdout": "x"}]}', contracts.CASE_BLANK),
    ('{"cases": [{"case_id": "x", "stdin": "", "expected_stdout": "1"}, {"case_id": "x", "stdin": "2", "expected_stdout": "1"}]}',
     contracts.REPEATED_CASE),
]


def test_suites(spark):
    rows = spark.createDataFrame([(str(i), s) for i, (s, _) in enumerate(SUITES)], "task_id string, model_output string")
    suites = contracts.parse_suites(rows)
    found = {int(r.task_id): r for r in suites.collect()}
    for i, (_, error) in enumerate(SUITES):
        assert found[i].parse_error == error, SUITES[i]
        assert (found[i].cases is None) == (error is not None)
    cases = contracts.suite_cases(suites).collect()
    assert {(c.task_id, c.case_ord, c.case_id, c.stdin) for c in cases} == {("0", 0, "e", "0\n"), ("1", 0, "e", "")}


def test_texts_are_hashed_and_parsed_once_and_scores_read_stored_suites(spark):
    import __spark_entry__ as registry
    from tests.conftest import SMALL

    rows = spark.createDataFrame([("t", SUITES[0][0])], "task_id string, model_output string")
    plan = contracts.parse_suites(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("parseJson"), plan.count("md5(")) == (1, 1)
    assert "parseJson" not in registry.queries()["score_outputs"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()


def test_only_strings_are_texts_of_a_case_and_cases_are_read_at_once(spark):
    others = ["1", "-0.5", "1e300", "123456789012345678901234567890", "1.25e-9", "true", "null", "{}", "[]", '["x"]', '{"x": "y"}']
    texts = ['""', '" "', '"1"', '"true"', '"null"', '"2026-01-01"', '"\\u00e9\\n"']
    odd = [f'{{"cases": [{{"case_id": "a", "stdin": {v}, "expected_stdout": "1", "more": [1]}}]}}' for v in (*others, *texts)]
    rows = spark.createDataFrame(list(enumerate(odd)), "task_id int, model_output string")
    suites = contracts.parse_suites(rows)
    found = suites.orderBy("task_id").collect()
    assert [r.parse_error for r in found] == [contracts.CASE_NOT_STRINGS] * len(others) + [None] * len(texts)
    assert [r.cases[0].stdin for r in found[len(others):]] == [json.loads(v) for v in texts]
    # One list of fields and one of messages is made of the cases, the latter for faulty ones only.
    assert suites._jdf.queryExecution().optimizedPlan().toString().count("transform(") == 1


def test_lines_are_checked_once_and_decoded_whole_only_if_their_head_tells_nothing(spark, task):
    from tasksieve.functions.text import is_blank
    from tasksieve.sources import tables as t
    from tests.conftest import SMALL

    rows = spark.createDataFrame([(0, "{}")], "seq long, raw string")
    plan = contracts.read_records(rows).select("seq", "errors")._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count(".isValid()"), plan.count("parseJson"), plan.count("md5(")) == (1, 1, 1)
    plan = t.task_lines(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StructsToJsonEvaluator") == 12
    good = json.dumps(task(), ensure_ascii=False)
    lines = [" " * 200 + good, "\n" * 64 + "[" + good + "]", " " * 63 + "é" + good, " " * 100, "\u3000" * 40, "\u3000" * 40 + "x", "\u2003" * 22, "é" * 99]
    assert judge(spark, *lines) == [[], ["not_object"], ["json_decode"], ["json_decode"], ["json_decode"]]
    texts = [*lines, "", "\ufffd", " " * 63 + "\u3000", " " * 63 + "é", "漢", None]
    seen = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", is_blank(contracts.F.col("s")).alias("blank")).orderBy("i")
    assert [r.blank for r in seen.collect()] == [None if s is None else not s.strip() for s in texts]


def test_odd_cases_and_braces(spark):
    good = '{"case_id": "a", "stdin": "", "expected_stdout": "1"}'
    absent = "case missing fields: ['case_id', 'stdin', 'expected_stdout']"
    odd = [
        (f'{{"cases": [null, {good}]}}', absent), (f'{{"cases": [{good}, 7]}}', absent),
        (f'{{"cases": [{good}, {{"case_id": "b", "stdin": {{}}, "expected_stdout": "x"}}, 7]}}', contracts.CASE_NOT_STRINGS),
        (f'}} é {{"cases": [{good}]}} é', None), (None, contracts.NO_OBJECT), ("}é{", contracts.NO_OBJECT),
    ]
    rows = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(odd)], "task_id int, model_output string")
    found = contracts.parse_suites(rows).orderBy("task_id").collect()
    assert [r.parse_error for r in found] == [error for _, error in odd]
    assert [tuple(c) for c in found[3].cases] == [("a", "", "1")]


def test_refused_rows_are_stored_without_fields_and_compressed_files_load(spark, tasks_of, task, tmp_path):
    from tasksieve.sources import jsonl

    rows = tasks_of(task("a"), task("b", title=" "), task("a"))
    loaded = jsonl.load_tasks(spark, jsonl.write_tasks(rows.coalesce(1), str(tmp_path / "out"), compression="gzip"))
    assert [r.task_id for r in loaded.tasks.collect()] == ["a"]
    assert sorted((r.line_number, r.first_error) for r in loaded.quarantine.collect()) == [(2, "blank:title"), (3, "duplicate_task_id")]
    stage = spark.read.parquet(*loaded.tasks.inputFiles())
    assert stage.where("first_error IS NOT NULL").select("task_id", "program", "reference_tests").distinct().collect() == [(None, None, None)]
    assert any(name.endswith(".gz") for name in spark.read.text(str(tmp_path / "out")).inputFiles())


def test_lines_in_order_move_each_text_once(spark):
    from tasksieve.sources import tables as t
    from tests.conftest import SMALL

    seen = t.task_lines(spark, SMALL, order=lambda documents: documents.orderBy("doc_id"))
    assert [r.seq for r in seen.select("seq").collect()] == sorted(r.seq for r in t.task_lines(spark, SMALL).select("seq").collect())
    plan = seen._jdf.queryExecution().optimizedPlan().toString()
    assert "raw" not in plan[plan.index("Sort ["):] and "to_json" not in plan[plan.index("Sort ["):]
