"""The record contract: raw JSON lines and generated suites in, typed rows plus error codes out.

JSON is parsed into VARIANT, because a typed read would turn the number 1 into the string "1" unseen. Every rule is a
column expression; nothing raises on bad data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tasksieve.functions.text import head, is_blank, settled
from tasksieve.schema import (
    CASE_FIELDS, MUTANT_FIELDS, REQUIRED_FIELDS, REVIEW_STATUSES, TASK_FIELDS, TEXT_FIELDS,
)


def parse_json_strictly(rows: DataFrame, text: Column, name: str) -> DataFrame:
    """``rows`` with ``name``, the VARIANT of a text that is exactly one JSON value, else NULL.

    Spark's parser stops at the end of the first value and ignores what follows. Parsing the text as the first of two
    list elements, the second being its own digest, leaves no room for a tail: only then is element 1 the digest. Digest
    and pair are columns of their own, so each text is hashed once and parsed once.
    """
    return _sealed(rows, text).select(
        *[F.col(c) for c in rows.columns], settled(F.when(_is_whole(), F.try_variant_get("_pair", "$[0]", "variant"))).alias(name)
    )


def _sealed(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` with ``_seal``, the digest of a text, and ``_pair``, the VARIANT of a list of text and digest."""
    sealed = rows.select("*", settled(F.md5(text)).alias("_seal"))
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), F.col("_seal"), F.lit('"]')))
    return sealed.select("*", settled(pair).alias("_pair"))


def _is_whole() -> Column:
    """True where the first element of ``_pair`` is the whole text; NULL where there is no pair."""
    return F.try_variant_get("_pair", "$[1]", "string") == F.col("_seal")


def _field(value: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{name}", kind)


def _is_string(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def _list_of(names: tuple[str, ...], kind: str = "variant") -> str:
    return f"array<struct<{', '.join(f'{n}: {kind}' for n in names)}>>"


#: The objects of a list by one look-up: of each its fields as VARIANTs, NULL where a field is absent or the element no object.
_CASE_LIST, _MUTANT_LIST = _list_of(CASE_FIELDS), _list_of(MUTANT_FIELDS)

#: The same with the bytes of texts: of all JSON values only a string can be read as BINARY, the others give NULL.
_CASE_TEXTS = _list_of(CASE_FIELDS, "binary")


def _string(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _case_rules(case: Column) -> list[Column]:
    """Conditions that break a test case, given its fields as VARIANTs: missing keys, then types, then blanks."""
    absent, other, blank = F.lit(False), F.lit(False), F.lit(False)
    for n in CASE_FIELDS:
        absent, other = absent | case[n].isNull(), other | ~_is_string(case[n])
    for n in ("case_id", "expected_stdout"):
        blank = blank | is_blank(_string(case[n]))
    return [absent, other, blank]


def _case_fault(case: Column) -> Column:
    absent, other, blank = _case_rules(case)
    return F.when(absent, "case_missing_fields").when(other, "case_not_strings").when(blank, "case_blank")


def case_fault(value: Column) -> Column:
    """First broken rule of one test case: missing keys, then types, then blanks; NULL if sound."""
    return _case_fault(F.struct(*[_field(value, n).alias(n) for n in CASE_FIELDS]))


def _to_case(case: Column) -> Column:
    return F.struct(*[_string(case[n]).alias(n) for n in CASE_FIELDS])


def _typed(name: str, value: Column) -> Column:
    if name == "reference_tests":
        return F.transform(F.try_variant_get(value, "$", _CASE_LIST), _to_case)
    if name == "mutants":
        return F.transform(
            F.try_variant_get(value, "$", _MUTANT_LIST),
            lambda m: F.struct(*[_string(m[n]).alias(n) for n in MUTANT_FIELDS]),
        )
    text = F.try_variant_get(value, "$", "string")
    return F.coalesce(text, F.lit("")) if name == "review_notes" else text


def _is_empty(value: Column) -> Column:
    """Absent, or an empty string, list or object, zero, false or null."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(_is_string(value), text == "").otherwise(text.isin("", "0", "0.0", "-0.0", "false", "[]", "{}"))


def _faults(fields: Column, lists: Column) -> Column:
    """All broken rules of an object, given its fields as VARIANTs, in the order in which they are looked at.

    ``lists`` has its ``tests`` and ``mutants`` as lists, NULL where the field is none, and the ``ids`` of the tests.
    """
    missing = F.array_compact(F.array(*[F.when(fields[n].isNull(), F.lit(n)) for n in REQUIRED_FIELDS]))
    tests, mutants, ids = lists["tests"], lists["mutants"], lists["ids"]

    def fault(condition: Column, code: str) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), F.lit(code))

    tail = [
        fault(mutants.isNull(), "mutants_not_list"),
        fault(
            ~(_is_string(fields["review_status"])
              & F.try_variant_get(fields["review_status"], "$", "string").isin(*REVIEW_STATUSES)),
            "bad_status",
        ),
    ]
    for name in TEXT_FIELDS:
        blank = is_blank(F.try_variant_get(fields[name], "$", "string"))
        tail.append(F.when(~_is_string(fields[name]), f"not_string:{name}").when(blank, f"blank:{name}"))
    tail += [
        fault(F.size(tests) == 0, "no_tests"),
        fault(F.size(ids) != F.size(F.array_distinct(ids)), "duplicate_case_ids"),
        fault(
            F.exists(mutants, lambda m: _is_empty(m["mutant_id"]) | _is_empty(m["source"])),
            "mutant_fields",
        ),
        fault(
            fields["review_notes"].isNotNull() & ~F.schema_of_variant(fields["review_notes"]).isin("STRING", "VOID"),
            "not_string:review_notes",
        ),
    ]
    no_codes = F.array().cast("array<string>")
    complete = F.concat(
        F.array(fault(tests.isNull(), "tests_not_list")),
        F.coalesce(F.array_distinct(F.array_compact(F.transform(tests, _case_fault))), no_codes),
        F.array(*tail),
    )
    return F.when(
        F.size(missing) > 0, F.array(F.concat(F.lit("missing_fields:"), F.array_join(F.array_sort(missing), ",")))
    ).otherwise(F.array_compact(complete))


BLANK_LINE = "blank_line"


def _opening(text: Column) -> Column:
    """The first bytes of a text, the whole text if they are white space: a pattern that looks at its first visible character
    then need not have all of it decoded."""
    first = head(text)
    return F.when(first.rlike(r"[^ \t\r\n]"), first).otherwise(text)


def read_records(lines: DataFrame, raw: str = "raw", blank_lines: bool = False) -> DataFrame:
    """Add the typed task fields, ``errors`` (all codes) and ``first_error`` to a table of JSON texts.

    Blank lines are skipped, or, where ``blank_lines`` asks for them, kept with the one code ``BLANK_LINE``. A row whose ``errors`` is empty satisfies the contract. Each line is checked and parsed once, each
    field and list looked up once; the typed fields are a plain projection on top, so unused ones are never built.
    """
    kept = [F.col(name) for name in lines.columns]
    lines.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    text = F.col(raw)
    # What the text alone tells. A parsed value is an object if its text opens with a brace.
    shape = (
        F.when(is_blank(text), BLANK_LINE).when(~F.is_valid_utf8(text), "bad_encoding")
        .when(~_opening(text).rlike(r"^[ \t\r\n]*\{"), "not_object")
    )
    shaped = lines.select(*kept, settled(shape).alias("_shape"))
    if not blank_lines:
        shaped = shaped.where(text.isNotNull() & ~F.equal_null("_shape", F.lit(BLANK_LINE)))
    hopeless = F.col("_shape").isin(BLANK_LINE, "bad_encoding")
    parsed = parse_json_strictly(shaped, F.when(~F.coalesce(hopeless, F.lit(False)), text), "_value")
    value = F.col("_value")
    state = F.when(hopeless, F.col("_shape")).when(value.isNull(), "json_decode").otherwise(F.col("_shape"))
    split = parsed.select(
        *kept,
        settled(F.struct(state.alias("state"), *[_field(value, n).alias(n) for n in TASK_FIELDS])).alias("_fields"),
    )
    fields = F.col("_fields")
    listed = split.select(*kept, "_fields", settled(F.struct(
        F.try_variant_get(fields["reference_tests"], "$", _CASE_LIST).alias("tests"),
        F.try_variant_get(fields["mutants"], "$", _MUTANT_LIST).alias("mutants"),
    )).alias("_found"))
    found = F.col("_found")
    lists = listed.select(*kept, "_fields", settled(F.struct(
        found["tests"].alias("tests"), found["mutants"].alias("mutants"),
        F.transform(found["tests"], lambda c: _string(c["case_id"])).alias("ids"),
    )).alias("_lists"))
    judged = lists.select(
        *kept, "_fields",
        settled(
            F.when(fields["state"].isNotNull(), F.array(fields["state"])).otherwise(_faults(fields, F.col("_lists")))
        ).alias("errors"),
    )
    return judged.select(
        *kept, *[_typed(n, fields[n]).alias(n) for n in TASK_FIELDS], "errors",
        F.get("errors", F.lit(0)).alias("first_error"),
    )


def duplicate_keys(rows: DataFrame, key: str = "task_id", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Keys seen more than once, with the order value of the row to keep and the row count."""
    first = F.min(F.struct(*order)) if len(order) > 1 else F.min(order[0])
    return (
        rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), first.alias("first_seen"))
        .where("n_rows > 1")
    )


def suite_slice(output: Column) -> Column:
    """From the first opening to the last closing brace of free text; NULL without such a span."""
    start = F.instr(output, "{")
    end = F.length(output) - F.length(F.substring_index(output, "}", -1))
    return F.when((start > 0) & (end > start), F.substr(output, start, end - start + 1))


# Messages of the suite report.
NO_OBJECT = "model output did not contain a JSON object"
NOT_JSON = "invalid JSON"
NO_CASE_LIST = "generated suite must be a JSON object with a cases list"
CASE_NOT_STRINGS = "case_id, stdin, and expected_stdout must be strings"
CASE_BLANK = "case_id and expected_stdout cannot be empty"
NO_CASES = "generated suite must include at least one test case"
REPEATED_CASE = "generated case IDs must be unique"


def _case_message(case: Column) -> Column:
    absent, other, blank = _case_rules(case)
    names = F.array_join(F.array_compact(F.array(*[F.when(case[n].isNull(), f"'{n}'") for n in CASE_FIELDS])), ", ")
    return (
        F.when(absent, F.concat(F.lit("case missing fields: ["), names, F.lit("]")))
        .when(other, CASE_NOT_STRINGS).when(blank, CASE_BLANK)
    )


def _is_sound(case: Column) -> Column:
    """True for a case whose fields are all there as texts, id and expected output visible; never NULL."""
    given = F.lit(True)
    for n in CASE_FIELDS:
        given = given & case[n].isNotNull()
    return given & ~is_blank(case["case_id"]) & ~is_blank(case["expected_stdout"])


def parse_suites(outputs: DataFrame, column: str = "model_output") -> DataFrame:
    """Generated suites out of free text: adds ``cases`` and ``parse_error`` (exactly one of them is NULL).

    Each output is parsed once and its cases are read at once as texts. Only where one of them is missing or blank are
    they looked at one by one for the message. Whoever reads the suites more than once should store them.
    """
    outputs.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    kept = [F.col(name) for name in outputs.columns]
    sliced = outputs.select(*kept, settled(suite_slice(F.col(column))).alias("_slice"))
    texts = F.try_variant_get("_pair", "$[0].cases", _CASE_TEXTS).cast(_list_of(CASE_FIELDS, "string"))
    read = _sealed(sliced, F.col("_slice")).select(*kept, "_slice", "_pair", settled(F.struct(
        F.coalesce(_is_whole(), F.lit(False)).alias("whole"), texts.alias("cases")
    )).alias("_read"))
    cases = F.col("_read")["cases"]
    messages = F.transform(F.try_variant_get("_pair", "$[0].cases", _CASE_LIST), _case_message)
    error = (
        F.when(F.col("_slice").isNull(), NO_OBJECT).when(~F.col("_read")["whole"], NOT_JSON)
        .when(cases.isNull(), NO_CASE_LIST).when(F.size(cases) == 0, NO_CASES)
        .when(~F.forall(cases, _is_sound), F.get(F.array_compact(messages), F.lit(0)))
        .when(F.size(cases["case_id"]) != F.size(F.array_distinct(cases["case_id"])), REPEATED_CASE)
    )
    judged = read.select(*kept, "_read", settled(error).alias("parse_error"))
    return judged.select(*kept, F.when(F.col("parse_error").isNull(), cases).alias("cases"), "parse_error")


def suite_cases(suites: DataFrame) -> DataFrame:
    """One row per case of the suites that parsed, numbered in suite order, with ``output_id`` where suites have it."""
    key = [c for c in ("task_id", "output_id") if c in suites.columns]
    return suites.where("parse_error IS NULL").select(
        *key, F.posexplode("cases").alias("case_ord", "_case")
    ).select(*key, "case_ord", "_case.*")


def task_cases(tasks: DataFrame) -> DataFrame:
    """The reference tests of loaded tasks as rows: task_id, case_ord, case_id, stdin, expected_stdout."""
    return tasks.select("task_id", F.posexplode("reference_tests").alias("case_ord", "_case")).select(
        "task_id", "case_ord", "_case.*"
    )


def task_mutants(tasks: DataFrame) -> DataFrame:
    """The mutants of loaded tasks as rows: task_id, mutant_ord, mutant_id, source."""
    return tasks.select("task_id", F.posexplode("mutants").alias("mutant_ord", "_mutant")).select(
        "task_id", "mutant_ord", "_mutant.mutant_id", "_mutant.source"
    )
