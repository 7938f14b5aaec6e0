"""What the operators of this package share: stored intermediates, bounded samples, connected components, task state.

A table of documents has an integer ``doc_id`` and a ``text``; other columns are allowed and ignored. Every operator
takes only the columns it needs before it adds its own, so further columns may have any name.
"""

from __future__ import annotations

import sys
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyproof.session import shared_dir

#: Arrow batches stay below this size, so a task holds few texts at a time however long they are.
BATCH_BYTES = 8 << 20
#: Hash space of the samples.
SLOTS = 1 << 30


def new_path(spark: SparkSession, name: str) -> str:
    """A place of its own in the folder that all executors share."""
    return f"{shared_dir(spark)}/tallyproof-llm/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here and lost executors cost nothing."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, unless the session has set a bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b") or 0) >= (1 << 30):
        spark.conf.set(key, str(BATCH_BYTES))


def id_and_text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sample(df: DataFrame, rows: int, key: Column | None = None) -> DataFrame:
    """At most ``rows`` rows of ``df``, the same ones in every run: those with the smallest hash of ``key``.

    Rows are counted first and only about twice as many as needed leave the tasks, so the sample costs the same
    at any size of ``df``. It serves only to fit models and dictionaries; nothing else is sampled.
    """
    h = F.pmod(F.xxhash64(F.col("doc_id") if key is None else key), F.lit(SLOTS))
    n = df.count()
    share = min(1.0, (2 * rows + 50) / n) if n else 1.0
    return (df.withColumn("_h", h).where(F.col("_h") < int(share * SLOTS) + (share == 1.0))
            .orderBy("_h", "doc_id").limit(rows).drop("_h"))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(id, root)`` with ``root`` the smallest id reachable from ``id`` over the edges ``(a, b)``.

    Alternates large-star and small-star steps until no edge changes. A step groups by one end, which combines in
    the tasks, and joins the minima back, a join that Spark splits for hub nodes. Each state is a table in the
    shared folder.
    """
    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), name)
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return e.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before = now
        both = e.union(e.select("b", "a"))
        low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .where("a <> b").distinct()
        e = stored(e, name)
        low = e.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        e = e.join(low, F.col("a") == F.col("u"))
        e = e.select(F.col("b").alias("a"), F.col("m").alias("b")).union(e.select(F.col("a"), F.col("m").alias("b"))) \
            .where("a <> b").distinct()
        e = stored(e, name)


def worker_store() -> dict:
    """State that one Python worker keeps over its tasks (caches of pure functions only)."""
    return sys.modules.setdefault("_tallyproof_worker", types.ModuleType("_tallyproof_worker")).__dict__


def keep(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id and text are among ``chosen`` ``(doc_id, row)``, one of each, with all columns.

    ``row`` is xxhash64 of the text, null as empty. Always a shuffled join: its cost follows the input alike at every size.
    """
    none = F.lit(-(1 << 63))
    left = docs.withColumns({"_k_id": F.coalesce(F.col("doc_id").cast("bigint"), none), "_k_row": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    right = chosen.select(F.coalesce("doc_id", none).alias("_k_id"), F.col("row").alias("_k_row"))
    return left.join(right.hint("merge"), ["_k_id", "_k_row"], "left_semi").dropDuplicates(["_k_id", "_k_row"]).select(*docs.columns)
