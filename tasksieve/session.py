"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Programs can be long: small Arrow batches keep the Python workers' memory flat.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # Duplicate JSON keys: the last one wins instead of the row failing to parse.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def build_session(app: str = "tasksieve", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on to a session made elsewhere.

    Where nobody chose a number of shuffle partitions it follows the cores of the cluster; adaptive execution merges
    what turns out small.
    """
    given = spark.sparkContext.getConf()
    for key, value in _DEFAULTS.items():
        if not given.contains(key):
            spark.conf.set(key, value)
    chosen = given.contains("spark.sql.shuffle.partitions") or spark.conf.get("spark.sql.shuffle.partitions") != "200"
    if not chosen:
        spark.conf.set("spark.sql.shuffle.partitions", str(3 * spark.sparkContext.defaultParallelism))
    return spark


BROADCAST_BYTES = 32 * 1024 * 1024


def pinned(rows: DataFrame) -> DataFrame:
    """The rows computed once into the shared checkpoint folder, marked for broadcast if they measure small enough.

    For small by-products of an expensive scan that several later steps join with. A result above the bound is left to
    a shuffle join with skew splitting.
    """
    spark = rows.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(scratch_path(spark, "checkpoints"))
    stored = rows.checkpoint()
    size = stored.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 64), F.lit(0))).first()[0]
    return F.broadcast(stored) if size <= BROADCAST_BYTES else stored


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the cluster's shared checkpoint folder.

    Only a local-mode session without that setting falls back to a temporary folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
