"""From split tasks to padded training batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tasksieve.operators import sft, splits


def prepare_training(
    spark: SparkSession,
    split_tasks: DataFrame,
    target: str,
    seed: int = 2026,
    max_length: int = 1024,
    batch_size: int = 8,
    pad_id: int = 0,
    tokenize: Callable[[DataFrame], DataFrame] = sft.chat_tokens,
) -> dict[str, str]:
    """Encode the train split; write ``encoded``, ``rejects``, ``batches`` and ``manifest`` under ``target``.

    ``tokenize`` turns (task_id, messages) into (task_id, prefix_ids, full_ids).
    """
    train = splits.get_split(split_tasks, "train")
    sft.check_training_set(train)
    paths = {name: f"{target.rstrip('/')}/{name}" for name in ("encoded", "rejects", "batches", "manifest")}
    sft.encode(tokenize(sft.sft_messages(train)), max_length).write.mode("overwrite").parquet(paths["encoded"])
    encoded = spark.read.parquet(paths["encoded"])
    sft.rejects(encoded).write.mode("overwrite").parquet(paths["rejects"])
    sft.collate(sft.usable(encoded), batch_size, pad_id, seed).write.mode("overwrite").parquet(paths["batches"])
    sft.training_manifest(split_tasks, seed).write.mode("overwrite").json(paths["manifest"])
    return paths
