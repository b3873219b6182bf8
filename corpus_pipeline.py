"""From raw documents to token ids: quality filter, near and passage de-duplication, decontamination, encoding.

``STAGES`` are (name, function) pairs. Each function takes (spark, docs, sf_dir), the rows its predecessor kept, and returns a
DataFrame; ``run`` writes each result to the shared folder and reads it again as the next one's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tasksieve.llm import byte_bpe, decontaminate, minhash, quality_ftrl, substring_chain
from tasksieve.llm.queries import byte_bpe_op, quality_weights, table
from tasksieve.llm.stored import stored


#: The column of row keys; documents have none of this name.
KEY = "__row_key"


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``KEY``: the doc_id, or a number of the row's own below all ids where the id is null or stands in several rows.

    The rows without an id of their own are stored, so that their numbers last; they should be few.
    """
    repeated = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id IS NULL OR n > 1").select(F.col("doc_id").alias(f"{KEY}_id"))
    several = stored(repeated, "shared-ids")
    if not several.head(1):
        return docs.withColumn(KEY, F.col("doc_id").cast("bigint"))
    same = F.col("doc_id").eqNullSafe(F.col(f"{KEY}_id"))
    rest = docs.join(several, same, "left_semi").withColumn(KEY, F.monotonically_increasing_id() - (1 << 62))
    own = docs.join(several, same, "left_anti").withColumn(KEY, F.col("doc_id").cast("bigint"))
    return own.unionByName(stored(rest, "rows-of-shared-ids"))


def _named(keyed: DataFrame) -> DataFrame:
    """What the operators read: each row under a doc_id of its own."""
    return keyed.select(F.col(KEY).alias("doc_id"), "text")


def _without(keyed: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rows of ``keyed`` but those whose key is a rejected doc_id."""
    return keyed.join(rejected.select(F.col("doc_id").alias(KEY)).distinct(), KEY, "left_anti").drop(KEY)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5 go."""
    op, keyed = quality_ftrl.QualityModel(), _keyed(docs)
    scores = quality_ftrl.score(_named(keyed), quality_weights(docs, table(spark, sf_dir, "labels"), op), op)
    return _without(keyed, stored(scores.where("score < 0.5").select("doc_id"), "low-quality")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: five-word shingles, similarity of at least 0.8.

    At 0.8, 40 bands of 5 coordinates miss a pair with a chance of 1e-7.
    """
    keyed = _keyed(docs)
    found = minhash.near_duplicates(_named(keyed), minhash.NearDedup(shingle=5, percent=80, bands=40, rows=5))
    return _without(keyed, stored(found.where("NOT kept").select("doc_id"), "near-copies")).select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller doc_id has too are cut out of ``text``; every document stays."""
    keyed = _keyed(docs)
    found = stored(substring_chain.repeated_passages(_named(keyed)), "passages")
    spans = found.withColumnRenamed("doc_id", KEY)
    cut = substring_chain.without_passages(keyed, spans, key=KEY)
    left = cut.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("bigint"))
    return left.select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more lies in benchmark windows go."""
    keyed = _keyed(docs)
    found = decontaminate.find_benchmark(_named(keyed), table(spark, sf_dir, "benchmark"))
    return _without(keyed, stored(found.where("contaminated").select("doc_id"), "contaminated")).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256, ids)``: the token ids of every text and the digest of what they decode to."""
    op = byte_bpe_op()
    return byte_bpe.digests(byte_bpe.encode(docs, op), op, keep_ids=True)


STAGES = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("passages", passages), ("decontaminated", decontaminated), ("encoded", encoded),
]

#: SQL cannot train the classifier or align passages: a test holds the run against naive stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
