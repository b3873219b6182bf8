"""Audit of a task table: duplicate programs, vague wording, provenance, license, review rationale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tasksieve.functions.digests import row_digest, skew_ready, table_digest
from tasksieve.functions.text import WORD_EDGE, digest_keys, fold_ascii_word, folded_digest, is_blank, settled

# Default vague phrases (as patterns), license words without meaning, issue texts.
VAGUE_PHRASES = (r"etc\.?", "as appropriate", "some cases", "and so on")
UNKNOWN_LICENSES = ("unknown", "unspecified", "n/a")
ISSUES = (
    ("duplicate_program", "review", "program duplicates task "),
    ("possible_ambiguity", "review", "specification contains a configured vague phrase"),
    ("missing_provenance_url", "error", "source_url must identify a reviewable source"),
    ("unknown_license", "error", "license must be identified before redistribution or training"),
    ("missing_review_rationale", "warning", "accepted tasks should record why they passed review"),
)


def is_vague(specification: Column, phrases: tuple[str, ...] = VAGUE_PHRASES) -> Column:
    return specification.rlike(f"(?iu){WORD_EDGE}(?:{'|'.join(phrases)}){WORD_EDGE}")


def lacks_provenance(source_url: Column) -> Column:
    return ~(source_url.startswith("https://") | source_url.startswith("http://"))


def lacks_license(license_id: Column) -> Column:
    return fold_ascii_word(license_id).isin(*UNKNOWN_LICENSES)


def lacks_rationale(status: Column, notes: Column) -> Column:
    return (status == "accepted") & is_blank(notes)


def _row_checks(phrases: tuple[str, ...]) -> list[Column]:
    """The four checks that look at one row, in report order."""
    return [
        is_vague(F.col("specification"), phrases),
        lacks_provenance(F.col("source_url")),
        lacks_license(F.col("license_id")),
        lacks_rationale(F.col("review_status"), F.col("review_notes")),
    ]


def duplicate_programs(tasks: DataFrame, native: bool = False) -> DataFrame:
    """Tasks whose program equals an earlier one's up to case and white space: task_id, seq, canonical_id.

    The aggregation combines before its shuffle, so a digest shared by a third of all tasks stays one row per map
    task; in the join back only its narrow rows meet on one key, which skew splitting cuts up.
    """
    keys = digest_keys(tasks, folded_digest(F.col("program"), native=native), "seq")
    first = (
        keys.groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("seq", "task_id")).alias("first"))
        .where("n > 1")
        .select("digest", F.col("first.task_id").alias("canonical_id"))
    )
    return (
        keys.join(skew_ready(first, "digest"), "digest").where(F.col("task_id") != F.col("canonical_id"))
        .select("task_id", "seq", "canonical_id")
    )


def curation_issues(
    tasks: DataFrame, phrases: tuple[str, ...] = VAGUE_PHRASES, native: bool = False
) -> DataFrame:
    """All findings: task_id, code, severity, detail, plus ``seq`` and ``check_ord`` to sort them by."""
    code, severity, lead = ISSUES[0]
    copies = duplicate_programs(tasks, native).select(
        "task_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"),
        F.concat(F.lit(lead), "canonical_id").alias("detail"), "seq", F.lit(1).alias("check_ord"),
    )
    found = F.array_compact(F.array(*[
        F.when(check, F.struct(
            F.lit(issue[0]).alias("code"), F.lit(issue[1]).alias("severity"), F.lit(issue[2]).alias("detail"),
            F.lit(order).alias("check_ord"),
        ))
        for order, (check, issue) in enumerate(zip(_row_checks(phrases), ISSUES[1:]), start=2)
    ]))
    rows = tasks.select("task_id", "seq", F.explode(found).alias("issue")).select(
        "task_id", "issue.code", "issue.severity", "issue.detail", "seq", "issue.check_ord"
    )
    return copies.unionByName(rows)


_COUNTS = ("task_count", "accepted_count", "revised_count", "rejected_count", "unreviewed_count")


def _tally(tasks: DataFrame, phrases: tuple[str, ...], native: bool) -> DataFrame:
    """One row with the status counts and one count per issue code, from one scan and one shuffle.

    The shuffle carries one row of counters per distinct program digest and map task; all but the first task of a
    digest are duplicates, so no join is needed to count them.
    """
    status = F.col("review_status")
    checks = dict(zip([issue[0] for issue in ISSUES[1:]], _row_checks(phrases)))
    flags = {
        "accepted_count": status == "accepted", "revised_count": status == "revised",
        "rejected_count": status == "rejected", "unreviewed_count": status == "unreviewed", **checks,
    }
    by_program = (
        tasks.select(
            settled(folded_digest(F.col("program"), native=native)).alias("digest"),
            *[flag.alias(name) for name, flag in flags.items()],
        )
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("task_count"), *[F.count_if(F.col(n)).alias(n) for n in flags])
    )
    total = [F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in (*_COUNTS, *checks)]
    return by_program.agg(
        *total, F.coalesce(F.sum(F.col("task_count") - 1), F.lit(0)).alias("duplicate_program")
    )


def issues_by_code(
    tasks: DataFrame, phrases: tuple[str, ...] = VAGUE_PHRASES, native: bool = False
) -> DataFrame:
    codes = sorted(issue[0] for issue in ISSUES)
    counters = F.array(*[F.struct(F.lit(c).alias("code"), F.col(c).alias("n")) for c in codes])
    return _tally(tasks, phrases, native).select(F.inline(counters)).where("n > 0")


def curation_report(
    tasks: DataFrame, phrases: tuple[str, ...] = VAGUE_PHRASES, native: bool = False
) -> DataFrame:
    """One row: task and status counts and ``issues_by_code`` as sorted JSON; the issues stay a table."""
    codes = sorted(issue[0] for issue in ISSUES)
    listed = F.array_compact(F.array(*[
        F.when(F.col(c) > 0, F.concat(F.lit(f'"{c}":'), F.col(c).cast("string"))) for c in codes
    ]))
    return _tally(tasks, phrases, native).select(
        *_COUNTS, F.concat(F.lit("{"), F.array_join(listed, ","), F.lit("}")).alias("issues_by_code")
    )


def task_digest() -> Column:
    """What identifies a task in a fingerprint: id, program, reference program and specification."""
    return row_digest(*[F.col(c) for c in ("task_id", "program", "reference_program", "specification")])


def dataset_fingerprint(tasks: DataFrame) -> DataFrame:
    """One row identifying the task set, over all rows; ``sources.fingerprints`` keeps it up to date."""
    return table_digest(tasks, task_digest())
