"""Task, suite, run-log and decision tables derived from a folder of Parquet tables.

Each adapter reads only the tables its requested columns need. Tests and mutants of a task come from its own row, so
building them gathers nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tasksieve.functions.text import settled


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_PLAIN = {
    "task_id": "concat('t', cast(doc_id AS string))",
    "group_id": "concat(source, '-', lang)",
    "title": "concat('doc ', cast(doc_id AS string))",
    "specification": "text",
    "program": "text",
    "reference_program": "text",
    "seq": "doc_id",
    "license_id": """
        CASE WHEN text LIKE '%Apache License%' THEN 'Apache-2.0' WHEN text LIKE '%MIT License%' THEN 'MIT'
             WHEN text LIKE '%GNU General Public%' THEN 'GPL-3.0' WHEN text LIKE '%CC BY-NC%' THEN 'CC-BY-NC-4.0'
             ELSE 'unknown' END""",
    # One test per visible line of the specification, numbered from 1.
    "reference_tests": r"""
        transform(filter(split(text, '\n'), l -> trim(l) <> ''),
                  (l, i) -> named_struct('case_id', concat('c', cast(i + 1 AS string)), 'stdin', l,
                                         'expected_stdout', concat('SUM=', cast(length(l) AS string))))""",
    # Up to three mutants, named by their position.
    "mutants": """
        transform(filter(array(0, 1, 2), k -> k < doc_id % 4),
                  k -> named_struct('mutant_id', concat('m', cast(k AS string)),
                                    'source', concat('MUTANT ', cast(k AS string), ' OF ', cast(doc_id AS string))))""",
}
_FROM_PAGES = {"source_url": "coalesce(url, 'n/a')"}
_FROM_LABELS = {
    "review_status": """
        CASE WHEN quality IS NULL THEN 'unreviewed' WHEN quality = 0 THEN 'rejected'
             WHEN toxic = 1 THEN 'revised' ELSE 'accepted' END""",
    "review_notes": "CASE WHEN quality IS NULL OR doc_id % 3 = 0 THEN '' ELSE 'label present' END",
}
TASK_COLUMNS = (*_PLAIN, *_FROM_PAGES, *_FROM_LABELS)


def tasks(spark: SparkSession, folder: str, *columns: str, order: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``order`` deals or sorts the documents by doc_id, joined and before the columns are made: a text then moves once, not once for
    each column that holds it."""
    wanted = columns or TASK_COLUMNS
    rows = table(spark, folder, "documents")
    if set(wanted) & set(_FROM_PAGES):
        pages = table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), "url")
        rows = rows.join(pages, "doc_id", "left")
    if set(wanted) & set(_FROM_LABELS):
        rows = rows.join(table(spark, folder, "labels"), "doc_id", "left")
    source = {**_PLAIN, **_FROM_PAGES, **_FROM_LABELS}
    if order:
        rows = order(rows)
    return rows.select(*[F.expr(source[c]).alias(c) for c in wanted])


def _case_id() -> Column:
    return F.concat_ws("-", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))


_CASE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def cases(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").groupBy(*_CASE_KEY).agg(F.min("l_quantity").alias("q")).select(
        F.col("l_orderkey").alias("task_id"), _case_id().alias("case_id"),
        F.col("l_linenumber").alias("case_ord"),
        F.concat(F.lit("SUM="), F.col("q").cast("bigint").cast("string")).alias("expected_stdout"),
    )


def _first(numbers: tuple[int, ...], n: Column) -> Column:
    """The first n numbers, none where n is NULL or negative."""
    return F.slice(F.array(*map(F.lit, numbers)), F.lit(1), F.greatest(n, F.lit(0)).cast("int"))


def mutants(spark: SparkSession, folder: str) -> DataFrame:
    """Up to three mutants per order; a quarter of the suites has none."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("task_id"),
        F.explode(_first((0, 1, 2), F.col("o_custkey") % 4)).alias("mutant_ord"),
    ).select("task_id", F.concat(F.lit("m"), F.col("mutant_ord").cast("string")).alias("mutant_id"), "mutant_ord")


def reference_runs(spark: SparkSession, folder: str) -> DataFrame:
    """A log that lacks some runs and holds others twice."""
    facts = table(spark, folder, "lineitem").groupBy(*_CASE_KEY).agg(
        F.min("l_quantity").alias("q"), F.max("l_discount").alias("d"), F.max("l_tax").alias("t"),
        F.chr(F.max(F.ascii("l_returnflag"))).alias("r"), F.max("l_extendedprice").alias("p"),
    )
    late = F.col("d") >= 0.1
    kept = facts.where("NOT (l_orderkey % 11 = 3 AND l_linenumber = 1)").withColumn(
        "_copy", F.explode(F.expr("sequence(1, CASE WHEN l_orderkey % 13 = 5 THEN 2 ELSE 1 END)"))
    )
    return kept.select(
        F.col("l_orderkey").alias("task_id"), _case_id().alias("case_id"), F.lit("reference").alias("program_id"),
        F.when(~late, F.when(F.col("r") == "R", 1).otherwise(0)).alias("return_code"),
        F.when(F.col("t") >= 0.08, "SUM=   -1")
        .otherwise(F.concat(F.lit("SUM=   "), F.col("q").cast("bigint").cast("string"))).alias("stdout"),
        F.concat(F.lit("warning "), F.col("r")).alias("stderr"),
        late.alias("timed_out"),
        (F.col("p") / 50000).alias("duration_seconds"),
    )


def mutant_runs(spark: SparkSession, folder: str, stored: DataFrame | None = None) -> DataFrame:
    """Each mutant run on each case of its suite, once or twice; the join is on the suite, a log elsewhere. ``stored`` are the cases where a table holds them."""
    runs = (cases(spark, folder) if stored is None else stored).join(mutants(spark, folder), "task_id").withColumn(
        "_copy", F.explode(F.expr("sequence(1, CASE WHEN task_id % 17 = 2 THEN 2 ELSE 1 END)"))
    )
    return runs.select(
        "task_id", "case_id", F.col("mutant_id").alias("program_id"),
        F.when(F.length("case_id") % 7 == F.col("mutant_ord"), 1).otherwise(0).alias("return_code"),
        F.when((F.length("expected_stdout") == 5) & (F.col("mutant_ord") == 1), "SUM=  0")
        .otherwise(F.col("expected_stdout")).alias("stdout"),
        F.lit(False).alias("timed_out"),
    )


def review_events(spark: SparkSession, folder: str) -> DataFrame:
    return as_decisions(table(spark, folder, "events"), table(spark, folder, "documents").count())


def as_decisions(events: DataFrame, n_tasks: int) -> DataFrame:
    """Raw events, a table or a stream, as review decisions on all tasks; a fifth of the ids named does not exist."""
    return events.select(
        "event_id", F.expr(f"concat('t', cast(event_id % {n_tasks + n_tasks // 4 + 1} AS string))").alias("task_id"),
        F.expr("CASE WHEN user_id % 10 = 0 THEN ' ' ELSE concat('r', cast(user_id AS string)) END").alias("reviewer"),
        F.expr("""CASE event_type WHEN 'purchase' THEN 'accepted' WHEN 'click' THEN 'revised'
                  WHEN 'error' THEN 'rejected' WHEN 'view' THEN 'unreviewed' ELSE 'other' END""").alias("status"),
        F.col("props").alias("rationale"), F.col("ts").alias("created_at"),
    )


_SUITE = """CASE o_orderkey % 8
  WHEN 0 THEN 'not JSON'
  WHEN 1 THEN '{"cases":[]}'
  WHEN 2 THEN '{"cases":[{"case_id":"a","stdin":"","expected_stdout":"SUM=1"},{"case_id":"a","stdin":"","expected_stdout":"SUM=2"}]}'
  WHEN 3 THEN '{"cases":[{"case_id":1,"stdin":"","expected_stdout":"SUM=1"}]}'
  WHEN 4 THEN '{"cases":{}}'
  WHEN 5 THEN concat('{"cases":[{"case_id":"a","stdin":"', cast(o_custkey AS string), '"}]} {"tail":1}')
  WHEN 6 THEN '{"cases":[{"case_id":"a"}]}'
  ELSE concat('Sure: {"cases":[{"case_id":"a","stdin":"1","expected_stdout":"SUM=', cast(o_custkey AS string),
              '"},{"case_id":"b","stdin":"2","expected_stdout":"SUM= 7\\n"}]} done') END"""


def model_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """One generator output per order: one kind in eight is good, with the cases a and b."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("task_id"), F.expr(_SUITE.replace("\\", "\\\\")).alias("model_output")
    )


def output_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Log of the programs run on the cases a and b: the reference program (k = -1) and mutants 0 to 2.

    The reference prints the expected number except for orders with status P; mutant 0 fails on b, mutant 1 prints a
    wrong number on a and has no recorded run on b, mutant 2 behaves like the reference.
    """
    grid = table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.explode(_first((-1, 0, 1, 2), F.col("o_custkey") % 4 + 1)).alias("k"),
    ).select("*", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("case_id"))
    return grid.where("NOT (k = 1 AND case_id = 'b')").select(
        F.col("o_orderkey").alias("task_id"), "case_id",
        F.expr("CASE WHEN k < 0 THEN 'reference' ELSE concat('m', cast(k AS string)) END").alias("program_id"),
        F.expr("CASE WHEN k = 0 AND case_id = 'b' THEN 1 ELSE 0 END").alias("return_code"),
        F.expr("""concat('SUM=   ', CASE WHEN k < 0 AND o_orderstatus = 'P' AND case_id = 'a' THEN '-1'
                  WHEN k = 1 THEN '-2' WHEN case_id = 'a' THEN cast(o_custkey AS string) ELSE '7' END)""").alias("stdout"),
        F.lit(False).alias("timed_out"),
    )


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """A prediction table that any engine can compute: task_id, review_risk from the text length."""
    return table(spark, folder, "documents").select(
        F.expr(_PLAIN["task_id"]).alias("task_id"), ((F.col("n_chars") * 37 % 1001) / 1000).alias("review_risk")
    )


def per_task_split(spark: SparkSession, folder: str) -> DataFrame:
    """A careless split by task instead of by group, for the leakage checks to find fault with."""
    head = F.substring(F.md5("task_id"), 1, 1)
    return tasks(spark, folder, "task_id", "group_id", "specification").withColumn(
        "split", F.when(head < "b", "train").when(head < "d", "validation").otherwise("test")
    )


def deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """All tasks delivered twice, the second time under another title."""
    first = tasks(spark, folder)
    again = first.withColumn("title", F.lit("again")).withColumn("seq", F.col("seq") + 1_000_000_000_000)
    return first.unionByName(again)


def task_lines(spark: SparkSession, folder: str, order: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One JSON text per task (seq, raw), of which about two in three break the contract, each kind in its own way."""
    rows = tasks(spark, folder, order=order)
    kind = F.col("seq") % 17
    names = (
        "task_id", "group_id", "title", "specification", "program", "reference_program", "reference_tests", "mutants",
        "source_url", "license_id", "review_status", "review_notes",
    )

    def line(**changed: Column | None) -> Column:
        columns = {n: changed.get(n, F.col(n)) for n in names}
        return F.to_json(F.struct(*[c.alias(n) for n, c in columns.items() if c is not None]))

    def one_case(**fields: Column) -> Column:
        return F.array(F.struct(*[c.alias(n) for n, c in fields.items()]))

    kinds = {
        0: line(license_id=None, mutants=None),
        1: line(license_id=F.lit(5), program=F.lit("  \t")),
        2: line(title=F.lit(" ")),
        3: line(review_status=F.lit("pending")),
        4: line(reference_tests=F.concat("reference_tests", "reference_tests")),
        5: line(reference_tests=one_case(case_id=F.lit(1), stdin=F.lit(""), expected_stdout=F.lit("SUM=1"))),
        6: line(mutants=F.array(F.struct(F.lit("m0").alias("mutant_id"), F.lit("").alias("source")))),
        10: line(task_id=F.concat(F.lit("t"), (F.col("seq") + 1).cast("string"))),
        12: line(reference_tests=one_case(case_id=F.lit("c1"), stdin=F.lit(""), expected_stdout=F.lit(" "))),
        13: line(reference_tests=one_case(case_id=F.lit("c1"))),
        15: line(reference_tests=F.array().cast("array<string>")),
    }
    sound = F.col("_line")
    spoilt = {
        7: F.substring(sound, F.lit(1), F.length(sound) - 1),
        8: F.concat(F.lit("["), sound, F.lit("]")),
        9: F.concat(sound, F.lit(" x")),
        14: F.concat(F.lit('{"title":"first",'), F.substring(sound, F.lit(2), F.length(sound))),
    }

    def chosen(texts: dict[int, Column], rest: Column) -> Column:
        found = F
        for number, text in texts.items():
            found = found.when(kind == number, text)
        return settled(found.otherwise(rest))

    written = rows.select("seq", chosen(kinds, line()).alias("_line"))
    return written.select("seq", chosen(spoilt, sound).alias("raw"))
