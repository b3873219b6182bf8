"""Supervised fine-tuning examples: prompts, targets, token rows, padded batches, manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tasksieve.functions.digests import table_digest
from tasksieve.functions.text import VISIBLE, json_object, settled
from tasksieve.session import scratch_path
from tasksieve.sources.jsonl import case_list_json

# The wording of the instruction.
PROMPT_HEAD = (
    "Generate a JSON test suite for this COBOL program. Use only observable behavior from the specification. "
    "Return JSON with a 'cases' array; each case has 'case_id', 'stdin', and 'expected_stdout'. Include boundary "
    "and error cases when specified. Do not include markdown.\n\nSpecification:\n"
)
PROMPT_JOIN = "\n\nCOBOL program:\n"
IGNORED_LABEL = -100


def generation_prompt(specification: Column, program: Column) -> Column:
    return F.concat(F.lit(PROMPT_HEAD), specification, F.lit(PROMPT_JOIN), program)


def sft_prompts(tasks: DataFrame) -> DataFrame:
    return tasks.select("task_id", generation_prompt(F.col("specification"), F.col("program")).alias("prompt"))


def target_json(tests: Column) -> Column:
    return json_object([("cases", case_list_json(tests))])


def sft_targets(tasks: DataFrame) -> DataFrame:
    return tasks.select("task_id", target_json(F.col("reference_tests")).alias("target"))


def sft_messages(tasks: DataFrame) -> DataFrame:
    """task_id, messages: the user prompt and the assistant's answer."""
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return tasks.select("task_id", F.array(
        message("user", generation_prompt(F.col("specification"), F.col("program"))),
        message("assistant", target_json(F.col("reference_tests"))),
    ).alias("messages"))


def _ids(words: Column, vocabulary: int) -> Column:
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(vocabulary)).cast("int"))


def chat_tokens(chats: DataFrame, vocabulary: int = 50_000, max_length: int | None = None) -> DataFrame:
    """Default token source: role marks and white-space words, each hashed to an id.

    ``prefix_ids`` covers all messages but the last plus the mark that opens the answer, ``full_ids`` everything. Any
    other tokenizer can supply these two columns instead. Where ``max_length`` says what ``encode`` refuses, prompts of so many
    tokens are counted only, in a third column ``prompt_tokens``, and have no ids.
    """
    def turns(messages: Column) -> Column:
        return F.flatten(F.transform(messages, lambda m: F.concat(
            F.array(F.concat(F.lit("<|"), m["role"], F.lit("|>"))),
            F.regexp_extract_all(m["content"], F.lit(f"[{VISIBLE}]+"), F.lit(0)),
            F.array(F.lit("<|end|>")),
        )))

    kept = [F.col(c) for c in chats.columns if c != "messages"]
    messages = F.col("messages")
    before = F.slice(messages, F.lit(1), F.greatest(F.lit(0), F.size(messages) - 1))
    opening = F.array(F.concat(F.lit("<|"), F.element_at(messages, -1)["role"], F.lit("|>")))
    words = F.struct(
        turns(before).alias("before"), opening.alias("open"),
        turns(F.slice(messages, F.size(messages), F.lit(1))).alias("answer"),
    )
    if max_length is not None:
        counted = F.aggregate(before, F.lit(1), lambda n, m: n + 2 + F.regexp_count(m["content"], F.lit(f"[{VISIBLE}]+")))
        chats = chats.select(*kept, "messages", settled(counted).alias("prompt_tokens"))
        words = F.when(~F.coalesce(F.col("prompt_tokens") >= max_length, F.lit(False)), words)
        kept = [*kept, F.col("prompt_tokens")]
    hashed = chats.select(*kept, settled(words).alias("_words")).select(
        *kept, settled(F.struct(*[_ids(F.col(f"_words.{c}"), vocabulary).alias(c) for c in ("before", "open", "answer")]))
        .alias("_ids")
    )
    return hashed.select(
        *kept, F.concat("_ids.before", "_ids.open").alias("prefix_ids"),
        F.concat("_ids.before", "_ids.answer").alias("full_ids"),
    )


def encode(tokens: DataFrame, max_length: int = 1024) -> DataFrame:
    """input_ids, attention_mask, labels (prompt masked) and ``reject_reason`` for rows that cannot be used; ``prompt_tokens``, where the
    tokens come with it, is the number of prompt tokens."""
    kept = [F.col(c) for c in tokens.columns if c not in ("prefix_ids", "full_ids", "prompt_tokens")]
    prefix, full = F.col("prefix_ids"), F.col("full_ids")
    n = F.col("prompt_tokens") if "prompt_tokens" in tokens.columns else F.size(prefix)
    reason = (
        F.when(F.slice(full, F.lit(1), n) != prefix, "prompt_prefix_mismatch")
        .when(n >= max_length, "prompt_exceeds_max_length")
    )
    cut = tokens.select(*kept, settled(F.struct(
        n.alias("prompt_tokens"), F.slice(full, 1, max_length).alias("input_ids"), reason.alias("reject_reason")
    )).alias("_cut")).select(*kept, "_cut.*")
    ids, masked = F.col("input_ids"), F.least(F.col("prompt_tokens"), F.size("input_ids"))
    return cut.select(
        *kept, "prompt_tokens", "input_ids",
        F.array_repeat(F.lit(1), F.size(ids)).alias("attention_mask"),
        F.concat(
            F.array_repeat(F.lit(IGNORED_LABEL), masked), F.slice(ids, masked + 1, F.size(ids))
        ).alias("labels"),
        "reject_reason",
    )


def usable(encoded: DataFrame) -> DataFrame:
    return encoded.where("reject_reason IS NULL").drop("reject_reason")


def rejects(encoded: DataFrame) -> DataFrame:
    return encoded.where("reject_reason IS NOT NULL").select("task_id", "prompt_tokens", "reject_reason")


def collate(
    encoded: DataFrame, batch_size: int = 8, pad_id: int = 0, seed: int = 2026, digits: int = 3
) -> DataFrame:
    """Shuffled batches, each padded to its longest row: batch_no, row_no, task_id, width and the padded lists.

    Rows have one global position in the order of the shuffle key: the total of the buckets before (16^digits of them at
    most, so the table of totals is small) plus the place inside the bucket. Batches are cut from it, so only the very
    last one can be short and ``digits`` changes nothing but the layout. The ids are stored once, for counting and placing; of the
    lists only they are shuffled, mask and labels follow from the ids' number and ``prompt_tokens``.
    """
    if not 0 <= digits <= 4:
        raise ValueError(f"0 to 4 hex digits, not {digits}")
    session, path = encoded.sparkSession, scratch_path(encoded.sparkSession, "encoded")
    encoded.select(
        "task_id", "prompt_tokens", "input_ids", F.md5(F.concat(F.lit(f"{seed}:"), "task_id")).alias("_key")
    ).withColumn("_bucket", F.substring("_key", 1, digits)).write.parquet(path)
    keyed = session.read.parquet(path)
    before = W.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows")).select(
        "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    inside = F.row_number().over(W.partitionBy("_bucket").orderBy("_key", "task_id")) - 1
    placed = keyed.join(F.broadcast(offsets), "_bucket").withColumn("_pos", F.col("_offset") + inside).select(  # at most 65,536 rows
        F.floor(F.col("_pos") / batch_size).alias("batch_no"), (F.col("_pos") % batch_size).cast("int").alias("row_no"),
        "task_id", "prompt_tokens", "input_ids",
    )
    wide = placed.withColumn("width", F.max(F.size("input_ids")).over(W.partitionBy("batch_no")))
    n, width = F.size("input_ids"), F.col("width")
    masked = F.least(F.col("prompt_tokens"), n)

    def repeated(value: int, times: Column) -> Column:
        return F.array_repeat(F.lit(value), times)

    return wide.select(
        "batch_no", "row_no", "task_id", "width",
        F.concat("input_ids", repeated(pad_id, width - n)).alias("input_ids"),
        F.concat(repeated(1, n), repeated(0, width - n)).alias("attention_mask"),
        F.concat(
            repeated(IGNORED_LABEL, masked), F.slice("input_ids", masked + 1, n), repeated(IGNORED_LABEL, width - n)
        ).alias("labels"),
    )


def check_training_set(tasks: DataFrame) -> None:
    if tasks.isEmpty():
        raise ValueError("no task to train on")
    if tasks.groupBy("task_id").count().where("count > 1").take(1):
        raise ValueError("a task_id occurs twice among the tasks to train on")


def training_manifest(split_tasks: DataFrame, seed: int = 2026) -> DataFrame:
    """One row about the training split: size, id fingerprint, seed, flags. The ids themselves stay a table."""
    train = split_tasks.where("split = 'train'").select("task_id")
    size = train.agg(F.count(F.lit(1))).scalar()
    return table_digest(train, F.sha2("task_id", 256), "task_id_fingerprint").select(
        F.lit("train").alias("split"), F.lit(seed).alias("seed"), size.alias("task_count"), "task_id_fingerprint",
        F.lit(False).alias("validation_used_for_updates"), F.lit(False).alias("test_accessed"),
    )
