"""Structural features of program sources: one projection, no shuffle, no Python."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from tasksieve.functions.text import WORD, settled, visible_line_count, word_count

# Statement verbs that are counted as whole tokens.
VERBS = (
    "ACCEPT", "ADD", "CALL", "COMPUTE", "DISPLAY", "DIVIDE", "EVALUATE", "IF", "MOVE", "MULTIPLY",
    "PERFORM", "READ", "SEARCH", "STOP", "WRITE",
)
# Feature names.
FEATURES = (
    "program_chars", "program_lines", "token_count", "unique_token_ratio", "verb_count", "copybook_count",
    "section_count", "paragraph_count", "spec_words", "reference_case_count", "mutant_count", "has_source_url",
    "has_known_license",
)


def extract_features(tasks: DataFrame, *keep: str) -> DataFrame:
    """task_id, the columns named in ``keep`` and the 13 features as doubles.

    The upper-cased source and the token list are each built once per row, though many features read them.
    """
    kept = ("task_id", *keep, "program", "specification", "reference_tests", "mutants", "source_url", "license_id")
    with_source = tasks.select(*kept, settled(F.upper("program")).alias("_source"))
    source = F.col("_source")
    tokenized = with_source.select(
        *kept, "_source", settled(F.regexp_extract_all(source, F.lit("[A-Z][A-Z0-9-]*"), F.lit(0))).alias("_tokens")
    )
    tokens = F.col("_tokens")

    def occurrences(pattern: str):
        return F.regexp_count(source, F.lit(pattern))

    values = {
        "program_chars": F.length("program"),
        "program_lines": visible_line_count(source),
        "token_count": F.size(tokens),
        "unique_token_ratio": F.size(F.array_distinct(tokens)) / F.greatest(F.lit(1), F.size(tokens)),
        "verb_count": F.size(F.filter(tokens, lambda t: t.isin(*VERBS))),
        # The letters first, then what may not stand next to them.
        "copybook_count": occurrences(f"COPY(?<!{WORD}COPY)(?!{WORD})"),
        "section_count": occurrences(rf"SECTION\.(?<!{WORD}SECTION\.)"),
        # (?d): only a line feed ends a line.
        "paragraph_count": occurrences(r"(?md)^[A-Z0-9-]+\.$"),
        "spec_words": word_count(F.col("specification")),
        "reference_case_count": F.size("reference_tests"),
        "mutant_count": F.size("mutants"),
        "has_source_url": F.col("source_url").startswith("http"),
        "has_known_license": ~F.lower("license_id").isin("unknown", "unspecified"),
    }
    return tokenized.select("task_id", *keep, *[values[n].cast("double").alias(n) for n in FEATURES])


def feature_matrix(tasks: DataFrame) -> DataFrame:
    """``(task_id, features)``: the features as a list in sorted name order; no tasks, no rows."""
    return extract_features(tasks).select("task_id", F.array(*[F.col(n) for n in sorted(FEATURES)]).alias("features"))


def feature_assembler(output: str = "features") -> VectorAssembler:
    """Feature vector in sorted name order."""
    return VectorAssembler(inputCols=sorted(FEATURES), outputCol=output)
