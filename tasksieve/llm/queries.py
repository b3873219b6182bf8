"""Registered queries of this subpackage: each operator over its whole table, with the columns its contract names."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tasksieve.llm import (
    byte_bpe, chat_repair, chat_snapshots, decontaminate, embedding_ego, html_template, minhash, oracle, pivot_search, quality_ftrl, substring_chain,
    token_counts, url_links, whitening_feast,
)

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _page_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_template.main_text(table(spark, folder, "pages"))


def _repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return substring_chain.repeated_passages(table(spark, folder, "documents"))


def quality_weights(documents: DataFrame, labels: DataFrame, op: quality_ftrl.QualityModel):
    """Learnt from the rows that are not held out."""
    return quality_ftrl.fit(documents, labels.where(~quality_ftrl.held_out()).select("doc_id", F.col("quality").alias("label")), op)


def _text_quality(spark: SparkSession, folder: str) -> DataFrame:
    op = quality_ftrl.QualityModel()
    documents = table(spark, folder, "documents")
    scored = quality_ftrl.score(documents, quality_weights(documents, table(spark, folder, "labels"), op), op)
    return scored.select("doc_id", quality_ftrl.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _token_counts(spark: SparkSession, folder: str) -> DataFrame:
    op = token_counts.TokenCounts(public_tokenizers.path("word_bpe_49k.json"))
    return token_counts.count_tokens(table(spark, folder, "documents"), op).withColumn("over_limit", F.col("n_tokens") > 2048)


def _near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), minhash.NearDedup(shingle=3, percent=85))


def _benchmark_overlap(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_benchmark(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def _maximal_chats(spark: SparkSession, folder: str) -> DataFrame:
    return chat_snapshots.maximal_chats(table(spark, folder, "conversations"))


RULES = (
    url_links.Rule("net", "/", "block"), url_links.Rule("example.net", "/en/", "allow"),
    url_links.Rule("example.com", "/de/", "block"), url_links.Rule("org", "/fr/", "allow"),
)


def _url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return url_links.judge_urls(table(spark, folder, "pages"), url_links.UrlFilter(RULES))


def byte_bpe_op() -> byte_bpe.ByteBpe:
    return byte_bpe.ByteBpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def _byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    op = byte_bpe_op()
    return byte_bpe.digests(byte_bpe.encode(table(spark, folder, "documents"), op), op)


def _near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_ego.near_duplicate_vectors(table(spark, folder, "embeddings"), embedding_ego.EgoJoin(cosine=0.9))


def _whitened_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return whitening_feast.whitened(table(spark, folder, "embeddings"), whitening_feast.Whitening(components=4, scale=256))


def _repaired_chats(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    found = chat_repair.repair(chat_repair.damaged(conversations))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    digests = chat_repair.repaired_digests(found.parts).withColumnRenamed("conv_id", "_d")
    audits = found.audits.withColumnRenamed("conv_id", "_a")
    every = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    named = every.join(audits, F.col("conv_id").eqNullSafe(F.col("_a")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("_d")), "left")
    return named.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def _top_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return pivot_search.top_products(table(spark, folder, "embeddings"), "vec_id % 50 = 0", pivot_search.PivotSearch(k=5, scale=256))


QUERIES: dict[str, Query] = {
    "op1_page_text": _page_text,
    "op2_repeated_passages": _repeated_passages,
    "op3_text_quality": _text_quality,
    "op4_token_counts": _token_counts,
    "op5_near_duplicates": _near_duplicates,
    "op6_benchmark_overlap": _benchmark_overlap,
    "op7_maximal_chats": _maximal_chats,
    "op8_url_verdicts": _url_verdicts,
    "op9_byte_bpe": _byte_bpe,
    "op10_near_vectors": _near_vectors,
    "op11_whitened_vectors": _whitened_vectors,
    "op12_repaired_chats": _repaired_chats,
    "op13_top_vectors": _top_vectors,
}

ORACLE: dict[str, str] = {
    "op5_near_duplicates": oracle.NEAR_DUPLICATES,
    "op6_benchmark_overlap": oracle.BENCHMARK_OVERLAP,
    "op7_maximal_chats": oracle.MAXIMAL_CHATS,
    "op10_near_vectors": oracle.NEAR_VECTORS,
    "op12_repaired_chats": oracle.REPAIRED_CHATS,
    "op13_top_vectors": oracle.TOP_VECTORS,
}
