"""Logged conversations that are prefixes of longer ones are dropped; the others are rendered with a chat template.

Every turn gets its place in its conversation and a hash of all turns up to it: the exclusive-or of the 128-bit hashes of (place, role, text).
Places and hashes are running values over blocks of a conversation's turns, then over the blocks' totals. Blocks are cut by rank, from a
range partitioning over all turns, so that one huge conversation is spread over many tasks however its turns are numbered. A conversation is kept if no longer one has its last hash at the same place (an anti-join against the
distinct hashes before a last turn); of equal conversations the one with the smallest id is kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tasksieve.llm.stored import stored


@dataclass(frozen=True)
class ChatFormat:
    """Strings around a turn; turns a rendered part holds; ranges all turns are cut into (0: the session's number of shuffle partitions)."""

    before_role: str = "<|im_start|>"
    after_role: str = "\n"
    after_text: str = "<|im_end|>\n"
    part_turns: int = 256
    ranges: int = 0


def _halves(*columns: str) -> tuple[Column, Column]:
    """Two 64-bit halves of the MD5 of the columns; null and empty differ."""
    digest = F.md5(F.to_json(F.struct(*columns)))
    return tuple(F.conv(F.substring(digest, at, 16), 16, -10).cast("bigint") for at in (1, 17))


def placed_turns(conversations: DataFrame, op: ChatFormat = ChatFormat()) -> DataFrame:
    """``(conv_id, key, pos, n, role, text, h1, h2)``: place from 1, number of turns, hash of all turns up to this one.

    Turns are ordered by (turn, role, text), nulls first. Rows repeated in all four columns are one turn.
    """
    rows = conversations.select(
        "conv_id", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")).alias("key"),
        F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    ).distinct()
    # Distinct turns differ in some column, so a range can end anywhere in a conversation. Null turns come first.
    order = ("key", "turn", "role", "text")
    ranged = rows.repartitionByRange(op.ranges, *order) if op.ranges else rows.repartitionByRange(*order)
    rows = stored(ranged.withColumn("block", F.spark_partition_id()), "ranged-turns")
    local = Window.partitionBy("key", "block").orderBy("turn", "role", "text")
    sizes = rows.groupBy("key", "block").agg(F.count(F.lit(1)).alias("size"))
    earlier = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "key", "block", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"), F.sum("size").over(Window.partitionBy("key")).alias("n")
    )
    placed = rows.withColumn("r", F.row_number().over(local)).join(starts, ["key", "block"]).withColumn("pos", F.col("before") + F.col("r"))
    h1, h2 = _halves("pos", "role", "text")
    hashed = stored(placed.select("conv_id", "key", "block", "pos", "n", "role", "text", h1.alias("a1"), h2.alias("a2")), "turns")
    running = Window.partitionBy("key", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    totals = hashed.groupBy("key", "block").agg(F.bit_xor("a1").alias("t1"), F.bit_xor("a2").alias("t2")).select(
        "key", "block", *[F.coalesce(F.bit_xor(f"t{i}").over(earlier), F.lit(0)).alias(f"p{i}") for i in (1, 2)]
    )
    own = hashed.select("*", *[F.bit_xor(f"a{i}").over(running).alias(f"w{i}") for i in (1, 2)])
    return own.join(totals, ["key", "block"]).select(
        "conv_id", "key", "pos", "n", "role", "text", *[F.col(f"w{i}").bitwiseXOR(F.col(f"p{i}")).alias(f"h{i}") for i in (1, 2)]
    )


def maximal_keys(turns: DataFrame) -> DataFrame:
    """``(key, copies)`` of the conversations that no longer one begins with, once for equal ones, and how many are equal."""
    last = turns.where("pos = n").groupBy("pos", "h1", "h2").agg(
        F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("copies")
    )
    inner = turns.where("pos < n").select("pos", "h1", "h2").distinct()
    return last.join(inner, ["pos", "h1", "h2"], "left_anti").select(
        F.coalesce(F.concat(F.lit("c"), F.col("least").cast("string")), F.lit("n")).alias("key"), "copies"
    )


def rendered(op: ChatFormat, role: str = "role", text: str = "text") -> Column:
    empty = F.lit("")
    return F.concat(F.lit(op.before_role), F.coalesce(role, empty), F.lit(op.after_role), F.coalesce(text, empty), F.lit(op.after_text))


def maximal_chats(conversations: DataFrame, op: ChatFormat = ChatFormat()) -> DataFrame:
    """``(conv_id, part, n_parts, n_turns, copies, text)`` of the kept conversations, in parts of ``part_turns`` turns.

    The parts of a conversation in order are its rendering, so no conversation has to fit one row. ``n_turns`` counts the
    conversation's turns, ``copies`` the equal conversations it stands for. Rows of (conv_id, turn, role, text); all rows with a null
    conv_id are one conversation, which a named equal one stands for. Null roles and texts render as empty.
    """
    turns = stored(placed_turns(conversations, op), "hashed-turns")
    kept = turns.join(maximal_keys(turns), "key")
    part = F.floor((F.col("pos") - 1) / op.part_turns).cast("bigint")
    parts = kept.groupBy("key", part.alias("part")).agg(
        F.min("conv_id").alias("conv_id"), F.max("n").alias("n_turns"), F.max("copies").alias("copies"),
        F.array_sort(F.collect_list(F.struct("pos", rendered(op).alias("turn")))).alias("turns"),
    )
    n_parts = F.ceil(F.col("n_turns") / op.part_turns).cast("bigint")
    return parts.select("conv_id", "part", n_parts.alias("n_parts"), "n_turns", "copies", F.array_join("turns.turn", "").alias("text"))
