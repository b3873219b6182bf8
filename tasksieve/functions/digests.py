"""Order-free fingerprints of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Hex digits of the row digest kept at each level of the tree, leaves first. A node has at most 16^4 children, and a
# leaf bucket of 16^8 stays small up to 10^12 rows, so no task ever holds more than a few megabytes.
_LEVELS = (8, 4, 0)


def row_digest(*columns: Column) -> Column:
    """SHA-256 over length-prefixed fields, so that moving text between fields changes it."""
    parts = []
    for column in columns:
        text = F.coalesce(column.cast("string"), F.lit(""))
        parts += [F.length(text).cast("string"), F.lit(":"), text]
    return F.sha2(F.concat(*parts), 256)


def tree_over_nodes() -> Column:
    """The digest of a node from those of its children, an aggregate of the column ``node``."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list("node")), ","), 256).alias("tree")


def table_digest(rows: DataFrame, digest: Column, name: str = "fingerprint") -> DataFrame:
    """One row: the root of a hash tree over the digests, the same for any order and partitioning.

    Equal digests are counted before anything is gathered, so copies cannot swell a bucket.
    """
    nodes = (
        rows.select(digest.alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("d").alias("key"), F.concat_ws(":", "d", F.col("n").cast("string")).alias("node"))
    )
    for digits in _LEVELS:
        nodes = (
            nodes.select(F.substring("key", 1, digits).alias("key"), "node")
            .groupBy("key")
            .agg(tree_over_nodes()).select("key", F.concat_ws(":", "key", "tree").alias("node"), "tree")
        )
    return nodes.select(F.col("tree").alias(name))


def skew_ready(rows: DataFrame, key: str) -> DataFrame:
    """A table aggregated by ``key``, moved by one more exchange before it is joined with rows that may be hot on it.

    Adaptive execution cuts up a hot partition only if both join inputs come straight from an exchange. An aggregate's
    own exchange lies below the aggregate and would be taken for the join as it is.
    """
    return rows.repartition(F.xxhash64(key))
