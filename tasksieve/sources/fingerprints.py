"""The hash tree of a table kept up to date: changes touch their own leaves and the nodes above them, and two trees name their differences.

The tree is that of ``digests.table_digest``, so its root equals the digest of the whole table. Three kinds of rows are stored, each sorted
by the first four hex digits of the row digests (``prefix``): signed numbers of row digests with the id of their row, and the nodes over
eight and over four digits in versions, the last of which holds. A change reads the files of the prefixes it touches; only the root
reads all nodes over four digits, 65,536 at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tasksieve.functions.digests import tree_over_nodes
from tasksieve.session import scratch_path
from tasksieve.sources.runs import Kind, Manifest, SortedRuns

_NODE = "prefix int, key string, tree string, version bigint"


def _summed(leaves: DataFrame) -> DataFrame:
    return leaves.groupBy("prefix", "d", "task_id").agg(F.sum("n").alias("n")).where("n <> 0")


def _latest(nodes: DataFrame) -> DataFrame:
    """The last version of each node; a node without rows has no tree."""
    return nodes.groupBy("prefix", "key").agg(F.max_by("tree", "version").alias("tree"), F.max("version").alias("version"))


def _node(left: str, right: str) -> Column:
    return F.concat_ws(":", F.col(left), F.col(right).cast("string")).alias("node")


class FingerprintTree:
    """Settings are those of ``SortedRuns``."""

    def __init__(self, spark: SparkSession, path: str, **run_settings: float) -> None:
        self.spark = spark
        self.runs = SortedRuns(spark, path, {
            "leaves": Kind("prefix int, d string, task_id string, n bigint", ("prefix", "d"), _summed),
            "nodes": Kind(_NODE, ("prefix", "key"), _latest),
            "tops": Kind(_NODE, ("prefix", "key"), _latest),
        }, **run_settings)

    def root(self) -> str | None:
        """The fingerprint; None of an empty table."""
        return self.runs.manifest().marks.get("root")

    def apply(self, digest: Column, added: DataFrame | None = None, removed: DataFrame | None = None) -> str | None:
        """Adds and removes rows (task_id and what ``digest`` reads) and returns the new root. What is removed must be there."""
        self.runs.compact()
        base = self.runs.manifest()
        signed = [rows.select(digest.alias("d"), "task_id", F.lit(n).cast("bigint").alias("n")) for rows, n in ((added, 1), (removed, -1)) if rows is not None]
        rows = signed[0] if len(signed) == 1 else signed[0].unionByName(signed[1])
        prefix = F.conv(F.substring("d", 1, 4), 16, 10).cast("int").alias("prefix")
        path = scratch_path(self.spark, "changes")
        rows.select(prefix, "d", "task_id", "n").groupBy("prefix", "d", "task_id").agg(F.sum("n").alias("n")).where("n <> 0").write.parquet(path)
        changes = self.spark.read.parquet(path)
        seen = changes.agg(F.count(F.lit(1)).alias("n"), F.collect_set("prefix").alias("prefixes")).first()  # 65,536 numbers at most
        if not seen.n:
            return self.root()
        run = self.runs.new_run()
        touched = changes.select("prefix", F.substring("d", 1, 8).alias("key")).distinct()
        known = self.runs.read(base, "leaves", keys=seen.prefixes).withColumn("key", F.substring("d", 1, 8))
        own = known.join(touched, ["prefix", "key"], "left_semi").select("prefix", "d", "task_id", "n").unionByName(changes)
        counts = own.groupBy("prefix", F.substring("d", 1, 8).alias("key"), "d").agg(F.sum("n").alias("n"))
        if counts.where("n < 0").take(1):
            raise ValueError("a row to be removed is not there")
        trees = counts.where("n > 0").select("prefix", "key", _node("d", "n")).groupBy("prefix", "key").agg(tree_over_nodes())
        files = math.ceil(seen.n / self.runs.file_rows)
        version = F.lit(base.version + 1).cast("bigint").alias("version")
        self.runs.add_files(run, "leaves", changes, files)
        self.runs.add_files(run, "nodes", touched.join(trees, ["prefix", "key"], "left").select("prefix", "key", "tree", version), files)
        self.runs.add_files(run, "tops", self._tops(base, run, seen.prefixes, version), 1)
        after = Manifest(base.version, [*base.runs, run])
        tops = _latest(self.runs.read(after, "tops")).where("tree IS NOT NULL")
        root = tops.select(_node("key", "tree")).groupBy().agg(F.count(F.lit(1)).alias("n"), tree_over_nodes()).first()
        marks = {"root": root.tree} if root.n else {}
        self.runs.commit(base, after.runs, marks, base.retired)
        return marks.get("root")

    def _tops(self, base: Manifest, run: dict, prefixes: list[int], version: Column) -> DataFrame:
        """The nodes over four digits of the prefixes touched."""
        fresh = self.runs.read(base, "nodes", runs=[run])
        ours = fresh.select("prefix").distinct()
        nodes = _latest(self.runs.read(base, "nodes", keys=prefixes).join(ours, "prefix", "left_semi").unionByName(fresh))
        trees = nodes.where("tree IS NOT NULL").select("prefix", _node("key", "tree")).groupBy("prefix").agg(tree_over_nodes())
        key = F.lower(F.lpad(F.hex(F.col("prefix").cast("bigint")), 4, "0")).alias("key")
        return ours.join(trees, "prefix", "left").select("prefix", key, "tree", version)

    def _unequal(self, other: "FingerprintTree", kind: str, prefixes: list[int] | None) -> DataFrame:
        """(prefix, key) of the nodes that differ, among the files of some prefixes."""
        mine, theirs = (_latest(t.runs.read(t.runs.manifest(), kind, keys=prefixes)).where("tree IS NOT NULL") for t in (self, other))
        both = mine.select("prefix", "key", F.col("tree").alias("a")).join(theirs.select("prefix", "key", F.col("tree").alias("b")), ["prefix", "key"], "full")
        return both.where(~F.col("a").eqNullSafe(F.col("b"))).select("prefix", "key")

    def difference(self, other: "FingerprintTree") -> DataFrame:
        """``(task_id, mine, theirs)``: rows that the two tables hold unequally often, by how often each does.

        Walked from the top: nodes that are equal are not entered, and files without an unequal prefix are not opened.
        """
        prefixes = [row.prefix for row in self._unequal(other, "tops", None).collect()]  # 65,536 at most
        keys = self._unequal(other, "nodes", prefixes)
        mine, theirs = (
            t.runs.read(t.runs.manifest(), "leaves", keys=prefixes).withColumn("key", F.substring("d", 1, 8)).join(keys, ["prefix", "key"], "left_semi")
            .groupBy("d", "task_id").agg(F.sum("n").alias("n")) for t in (self, other)
        )
        zero = F.lit(0).cast("bigint")
        both = mine.withColumnRenamed("n", "a").join(theirs.withColumnRenamed("n", "b"), ["d", "task_id"], "full").select(
            "task_id", F.coalesce("a", zero).alias("mine"), F.coalesce("b", zero).alias("theirs")
        )
        return both.where("mine <> theirs")
